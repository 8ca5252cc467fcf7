"""Splits that keep related records together: hash-to-min components, weighted rendezvous hashing of components.

The graph that is clustered has documents as nodes (named by their smallest row_id) and, for each author, a star from the
author's smallest document to the others: rows are aggregated before any edge exists, so neither a document with a tenth
of the rows nor an author of many rows makes a large group. Each round is one aggregation with map-side combining and one
join against one row a node, checkpointed to the shared folder.

A null id is a document of its own; null, empty and stand-in authors relate nothing; repeated rows are rows like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .overlap import folded_split

#: Handles that name nobody, in the forms they take in metadata of corpora.
NOBODY = ("", "-", "--", "?", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "anonymous", "anon", "anonym", "anonymus", "anoniem", "anonimo", "anónimo", "unknown", "unbekannt", "onbekend", "desconocido", "unnamed", "nobody", "no author", "not available", "not given", "various", "guest", "tbd", "xxx", "<unknown>", "[deleted]", "deleted", "unspecified")
#: Components with more than this part of all rows are placed one by one (there are fewer than 1 / HEAVY of them).
HEAVY = 0.005
SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def author_key(c: Column) -> Column:
    """The handle without letter case, blanks around it and a leading @; null where it names nobody."""
    blank = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
    low = F.lower(F.regexp_replace(c, blank, ""))
    low = F.regexp_replace(F.regexp_replace(low, "^@", ""), blank, "")
    return F.when(~low.isin(*NOBODY), low)


def document_of(c: Column) -> Column:
    """The id before its last dot, the whole id where it has none."""
    return F.regexp_replace(c, r"(?s)\.[^.]*\z", "")


def document_rows(df: DataFrame) -> DataFrame:
    """row_id, split (folded), author and doc (the smallest row_id of the row's document)."""
    own = df.select(df["row_id"].cast("long").alias("row_id"), folded_split(df["split_type"]).alias("split"), F.unhex(F.md5(document_of(df["id"]))).alias("_d"), F.unhex(F.md5(author_key(df["metadata"]["author"]))).alias("author"))
    own = cut(own)
    docs = own.filter("_d is not null").groupBy("_d").agg(F.min("row_id").alias("doc"))
    return own.join(docs, "_d", "left").select("row_id", "split", "author", F.coalesce("doc", "row_id").alias("doc"))


def hash_to_min(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root (the smallest node of its component) of an undirected graph (u, v); only nodes with edges come out.

    State: rows (v, u), u in the cluster of v. Each round every node sends its cluster to its smallest member and that
    member to its cluster. It is done when every node but the roots knows its root and itself only.
    """
    state = edges.select(F.col("u").alias("v"), F.col("v").alias("u")).unionByName(edges.select("v", "u"))
    state = cut(state.unionByName(state.select("v", F.col("v").alias("u"))).distinct())
    for _ in range(most_rounds):
        known = state.join(state.groupBy("v").agg(F.min("u").alias("m")), "v")
        nxt = cut(known.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.v", "x.u").distinct())
        least = nxt.groupBy("v").agg(F.min("u").alias("m"), F.max("u").alias("last"), F.count(F.lit(1)).alias("k"))
        # a node that is not a root may hold its root, and itself, only
        if least.filter((F.col("m") != F.col("v")) & ((F.col("last") != F.col("m")) & (F.col("last") != F.col("v")) | (F.col("k") > 2))).isEmpty():
            return least.select(F.col("v").alias("node"), F.col("m").alias("root"))
        state = nxt
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def components(rows: DataFrame) -> DataFrame:
    """document_rows() with group_id, the smallest row_id of the row's component."""
    stars = rows.filter("author is not null").select("author", "doc").distinct()
    least = stars.groupBy("author").agg(F.min("doc").alias("u"))
    edges = stars.join(least, "author").filter("u <> doc").select("u", F.col("doc").alias("v")).distinct()
    roots = hash_to_min(edges)
    return rows.join(roots, rows["doc"] == roots["node"], "left").select("row_id", "split", "doc", F.coalesce("root", "doc").alias("group_id"))


def torn(df: DataFrame) -> DataFrame:
    """group_id, row_id of every row of a group whose rows lie in more than one split."""
    rows = cut(components(document_rows(df)))
    groups = rows.groupBy("group_id").agg((F.min("split") != F.max("split")).alias("torn")).filter("torn")
    return rows.join(groups.select("group_id"), "group_id").select("group_id", "row_id")


def _draw(group: Column, split: str) -> Column:
    """A number in (0, 1) from the hash of group and split."""
    return (F.xxhash64(group, F.lit(split)).bitwiseAND((1 << 53) - 1).cast("double") + 0.5) / float(1 << 53)


def rendezvous(group: Column, weights: list[tuple[str, float]]) -> Column:
    """The split whose weighted score of this group is highest: each gets its weight's part of groups, and a changed weight moves only what must."""
    scores = [F.struct((F.lit(-w) / F.log(_draw(group, s))).alias("score"), F.lit(s).alias("split")) for s, w in weights if w > 0]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["split"]


def assign_splits(df: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS) -> DataFrame:
    """row_id, group_id, split (as it was, folded), new_split. No group lies in two new splits.

    Heavy components (above HEAVY of all rows, so fewer than 1 / HEAVY) are placed largest first where most is missing;
    all others by weighted rendezvous hashing with what each split then still lacks. Empty tables give no rows.
    """
    rows = cut(components(document_rows(df)))
    sizes = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("k"))
    total = rows.count()
    heavy = sizes.filter(F.col("k") > HEAVY * total).orderBy(F.desc("k"), "group_id").collect()
    lack = {s: share * total for s, share in splits}
    placed: list[tuple[int, str]] = []
    for g, k in heavy:
        best = max(lack, key=lambda s: (lack[s], s))
        lack[best] -= k
        placed.append((g, best))
    weights = [(s, max(0.0, lack[s])) for s, _ in splits]
    if not any(w for _, w in weights):
        weights = list(splits)
    new = rendezvous(F.col("group_id"), weights)
    for g, s in placed:
        new = F.when(F.col("group_id") == g, s).otherwise(new)
    return rows.select("row_id", "group_id", "split", new.alias("new_split"))
