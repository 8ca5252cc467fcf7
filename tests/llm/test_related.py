import random
from collections import Counter, defaultdict

import pytest

from graphmill.llm import related

SCHEMA = "row_id long, id string, metadata map<string,string>, split_type string, doc long, group_id long, author string, v long"


def table(spark, rows):
    return spark.createDataFrame([(i, d, None if a == "no map" else {"author": a} if a != "no key" else {"x": "y"}, s, 0, 0, "x", 0) for i, d, a, s in rows], SCHEMA).repartition(3)


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, d, a, _ in rows:
        links = [("row", i)]
        if d is not None:
            links.append(("doc", d.rsplit(".", 1)[0]))
        key = (a or "").strip().lower()
        key = key[1:].strip() if key.startswith("@") else key
        if a not in ("no map", "no key") and key not in related.NOBODY:
            links.append(("author", key))
        for x in links[1:]:
            parent[find(x)] = find(links[0])
    groups = defaultdict(list)
    for i, *_ in rows:
        groups[find(("row", i))].append(i)
    return {i: min(g) for g in groups.values() for i in g}


@pytest.mark.parametrize("seed", range(3))
def test_groups_against_union_find(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        author = rng.choice([None, "", " - ", "n/a", "Unknown", "@anonymous", "no map", "no key"] + [rng.choice(["@u%d", " U%d ", "u%d", "@ u%d"]) % rng.randrange(120) for _ in range(6)])
        doc = None if rng.random() < 0.05 else f"D{rng.randrange(150)}.x.{i}" if rng.random() < 0.9 else f"alone{i}"
        rows.append((i, doc, author, rng.choice(["train", "training", "dev", "validation", "test"])))
    df = table(spark, rows)
    want = brute(rows)
    fold = {"training": "train", "dev": "validation"}
    splits = defaultdict(set)
    for i, _, _, s in rows:
        splits[want[i]].add(fold.get(s, s))
    assert {(r["group_id"], r["row_id"]) for r in related.torn(df).collect()} == {(g, i) for i, g in want.items() if len(splits[g]) > 1}
    new = related.assign_splits(df).collect()
    assert {r["row_id"]: r["group_id"] for r in new} == want
    by = defaultdict(set)
    for r in new:
        by[r["group_id"]].add(r["new_split"])
    assert all(len(s) == 1 for s in by.values())


def test_long_chain(spark):
    """Components as long as a chain of 400 documents settle in a few rounds."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(1000, 1001), (1001, 1002), (1000, 1002)], "u long, v long").repartition(4)
    got = {r["node"]: r["root"] for r in related.hash_to_min(edges).collect()}
    assert got == {**{i: 0 for i in range(401)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_shares_with_a_document_of_a_third(spark):
    rows = [(i, "big.%d" % i if i < 1000 else f"d{i // 3}.{i}", None, "train") for i in range(3000)]
    n = Counter(r["new_split"] for r in related.assign_splits(table(spark, rows)).collect())
    assert abs(n["train"] / 3000 - 0.8) < 0.04 and abs(n["validation"] / 3000 - 0.1) < 0.04 and abs(n["test"] / 3000 - 0.1) < 0.04


def test_empty_and_repeated(spark):
    rows = [(1, "a.1", None, "train"), (1, "a.1", None, "test"), (2, None, None, None)]
    assert related.torn(table(spark, rows).limit(0)).count() == 0
    assert related.assign_splits(table(spark, rows).limit(0)).count() == 0
    assert sorted(map(tuple, related.torn(table(spark, rows)).collect())) == [(1, 1), (1, 1)]


def test_rendezvous_moves_little(spark):
    df = spark.range(4000)
    a = {r[0]: r[1] for r in df.select("id", related.rendezvous(df["id"], [("x", 0.5), ("y", 0.5)]).alias("s")).collect()}
    b = {r[0]: r[1] for r in df.select("id", related.rendezvous(df["id"], [("x", 0.5), ("y", 0.4)]).alias("s")).collect()}
    assert 0.45 < Counter(a.values())["x"] / 4000 < 0.55
    assert all(b[k] == "x" for k in a if a[k] == "x")
