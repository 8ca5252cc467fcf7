import itertools
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphmill.llm import copies, overlap
from graphmill.llm.canon import canonical_graph

SCHEMA = "row_id long, id string, snt string, metadata map<string,string>, sentence string, penmanstr string, split_type string, src_lang_idx int, loaded_at timestamp, key string, copies int, w string, n_copies int, gram int"
G = "(a / go-01 :ARG0 (b / boy :mod (c / tall)) :op1 \"New York\")"
G2 = "(A/GO-01 :op1 \"new york\"\n :ARG0 (b / boy\n :mod (c / tall)))"
G3 = "(x / go-01 :ARG0 (y / boy :mod (z / tall)) :op1 \"New York\")"


def table(spark, rows):
    full = [(i, f"d.{i}", s, {"id": "x"}, s, g, split, lang, datetime(2024, 1, 1), "k", 1, "w", 2, 3) for i, s, g, split, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def test_canonical_graph():
    assert canonical_graph(G) == canonical_graph(G2) != canonical_graph(G3)
    assert canonical_graph(G, True) == canonical_graph(G2, True) == canonical_graph(G3, True)
    re_a = "(a / see :ARG0 (b / boy) :ARG1 (c / boy) :ARG2 b)"
    assert canonical_graph(re_a, True) == canonical_graph("(q / see :ARG2 z :ARG1 (y / boy) :ARG0 (z / boy))", True)
    assert canonical_graph(re_a, True) != canonical_graph("(a / see :ARG0 (b / boy) :ARG1 (c / boy) :ARG2 (d / boy))", True)
    assert canonical_graph("not a graph )") == "notagraph)"
    assert canonical_graph(None) == canonical_graph("") == ""
    deep = "(a / b :c " * 5000 + "(a / b)" + ")" * 5000
    assert canonical_graph(deep).count("(") == 5001


def test_copies_cases(spark):
    rows = [
        (5, "A cat, sits.", G, "train", 0), (3, "a CAT sits!", G2, "dev", 0), (9, "a cat sits", G, "test", 0), (4, "a cat sits", G, "test", 1), (6, "a cat sits", G3, "test", 0),
        (10, None, G, "train", 0), (11, None, G2, "train", 0), (12, "", G, "train", 0), (13, " ", G, "train", 0), (14, "a", None, "train", None), (15, "a", None, "train", None),
        (16, "word " * 50_000, G, "train", 0), (17, "Word, " * 50_000, G2, "train", 0), (9, "a cat sits", G, "test", 0),
    ]
    keys = copies.keyed(table(spark, rows))
    assert sorted(map(tuple, copies.copy_links(keys).collect())) == [(3, 5), (3, 9), (3, 9), (10, 11), (12, 13), (14, 15), (16, 17)]
    groups = copies.collapse(keys).collect()
    assert sum(r["copies"] for r in groups) == len(rows)
    assert not any(r["collided"] for r in groups)
    kept = copies.deduplicated(table(spark, rows))
    assert {r["row_id"]: r["n_copies"] for r in kept.collect()}[3] == 4
    assert copies.copy_links(copies.keyed(table(spark, rows).limit(0))).count() == 0


def test_colliding_hashes_stay_apart(spark):
    keys = spark.createDataFrame([(1, b"k", 7), (2, b"k", 8), (3, b"k", 7)], "row_id long, key binary, chk long")
    got = sorted((r["keep_id"], r["copies"], r["collided"]) for r in copies.collapse(keys).collect())
    assert got == [(1, 2, True), (2, 1, True)]


def brute_pairs(rows):
    fold = {"train": "t", "training": "t", "dev": "e", "validation": "e", "test": "e"}
    out = set()
    words = lambda s: set(re.findall(r"[^\W_]+", (s or "").lower()))
    for a, b in itertools.combinations(rows, 2):
        if a[0] == b[0] or {fold.get(a[3]), fold.get(b[3])} != {"t", "e"}:
            continue
        x, y = words(a[1]), words(b[1])
        near = x and y and 10 * len(x & y) >= 7 * len(x | y)
        same = a[2] and b[2] and canonical_graph(a[2], True) == canonical_graph(b[2], True)
        if near or same:
            out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_overlap_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(words)) if words else 0
                words[k : k + rng.randrange(2)] = [rng.choice("abcdefghijklmnop")] if rng.random() < 0.7 else []
        else:
            words = [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice(["", "x"]) for _ in range(rng.choice([1, 2, 3, 5, 12, 30]))]
        graph = f"(v{i} / c{rng.randrange(60)})" if rng.random() < 0.8 else rng.choice(["", None, "broken"])
        rows.append((i, " ".join(words), graph, rng.choice(["train", "training", "dev", "validation", "test", "other"]), rng.choice([0, 1, None])))
    got = [tuple(r) for r in overlap.overlap_pairs(table(spark, rows)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(rows)


def test_overlap_cases(spark):
    rows = [(1, None, None, "train", 0), (2, None, None, "test", 0), (3, "", "", "train", 0), (4, "", "", "test", 0), (5, "!!", None, "test", 0), (6, "!!", None, "train", 0), (7, None, G, "train", 0), (8, "other words here", G3, "dev", 2), (9, "a b c d e f g", None, "train", 0), (10, "g f e d c b a", None, "test", 3), (11, "long " + " ".join(map(str, range(5000))), None, "train", 0), (12, " ".join(map(str, range(5000))), None, "test", 0)]
    df = table(spark, rows)
    assert sorted(map(tuple, overlap.overlap_pairs(df).collect())) == [(7, 8), (9, 10), (11, 12)]
    got = {(r["eval_id"], r["train_id"]): r for r in overlap.overlaps(df).collect()}
    assert got[10, 9]["containment"] == 1.0 and got[10, 9]["by_words"] and not got[10, 9]["by_graph"]
    assert got[8, 7]["containment"] is None and got[8, 7]["by_graph"]
    sources = spark.createDataFrame([("news", "d", "x", 1.0, 1)], "source string, id_prefix string, domain string, target_share double, max_repeat int")
    report = {(r["split"], r["source"]): (r["records"], r["overlapping"], r["pairs"]) for r in overlap.overlap_report(df, sources).collect()}
    assert report == {("test", "news"): (5, 2, 2), ("validation", "news"): (1, 1, 1)}
    assert overlap.overlaps(df.limit(0)).count() == 0


def test_a_class_of_many_copies(spark):
    """A third of all rows are copies of one sentence: each meets each once, nothing is lost."""
    hot = spark.range(600).select(F.col("id").alias("row_id"), F.lit("d.1").alias("id"), F.lit("the same words again and again").alias("sentence"), F.lit(None).cast("string").alias("penmanstr"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split_type"))
    assert overlap.overlap_pairs(hot).count() == 200 * 400


def test_long_records(spark, monkeypatch):
    """Beyond LONG words single words find the pairs, and pairs across the bound are not lost."""
    rng = random.Random(9)
    rows = []
    for i in range(60):
        base = [f"w{(i // 4) * 500 + k}" for k in range(rng.choice([170, 200, 250, 256, 257, 300, 360]))]
        for k in rng.sample(range(len(base)), rng.randrange(len(base) // 9)):
            base[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(base), None, rng.choice(["train", "test"]), 0))
    rows += [(100, " ".join(f"v{k}" for k in range(40_000)), None, "train", 0), (101, " ".join(f"v{k}" for k in range(4_000, 40_000)), None, "test", 0)]
    monkeypatch.setattr(overlap, "FLUSH", 20_000)
    got = {tuple(r) for r in overlap.overlap_pairs(table(spark, rows)).collect()}
    assert (100, 101) in got and len(got) > 8
    assert got == brute_pairs(rows)
