"""Mixing sources to target weights: a low-discrepancy schedule of the sources, joined with shuffled blocks of equal tokens.

Each source's documents are shuffled by a hash and laid end to end in tokens, as often as the source may repeat. The run of
tokens is cut into blocks of equal size. Slots of the schedule are the points i x golden ratio mod 1, mapped through the
cumulative weights of the sources; the k-th slot of a source is its k-th block. So every stretch of the mix has the target
shares, not only the whole. Running totals are taken within buckets of a source's hash order and then over the buckets, so
a source that holds most rows is still many tasks.

Documents of no known source, and sources without share, are left out. Empty texts have no tokens and add none; they are
left out too; so are sources that may be repeated 0 times (null is once). Null texts count as empty. Repeated doc_ids are documents each.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .tokens import VOCABULARY, count_tokens

#: 2**31 / golden ratio, odd: the step of the golden-ratio sequence in whole numbers.
GOLDEN, TURN = 1327217885, 1 << 31
BLOCK_TOKENS = 4096
#: Documents of a source in one bucket of its hash order, about; slots in one bucket of the schedule.
BUCKET_DOCS, BUCKET_SLOTS = 20_000, 1 << 15
MOST_SOURCES = 10_000


def sized(docs: DataFrame, sources: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens (exact, of the tokenizer) of the documents that can be mixed."""
    known = F.broadcast(sources.select("source").where("source is not null").distinct().limit(MOST_SOURCES))
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"], docs["text"]).join(known, "source", "left_semi")
    return cut(count_tokens(own, "text", ("doc_id", "source"), path).filter("merged_tokens > 0").select("doc_id", "source", F.col("merged_tokens").alias("tokens")))


def quotas(rows: DataFrame, sources: DataFrame, total: int | None = None) -> dict[str, tuple[float, int, int, int]]:
    """Of each source: share, tokens it has, tokens it shall give, most repeats. A row a source, at most MOST_SOURCES.

    The total, unless given, is the largest that all sources with documents can reach with their repeats; a larger one is
    met as far as the repeats allow.
    """
    have = {r["source"]: (int(r["t"]), int(r["n"])) for r in rows.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    wanted = {r["source"]: (float(r["target_share"] or 0.0), 1 if r["max_repeat"] is None else int(r["max_repeat"])) for r in sources.filter("source is not null").limit(MOST_SOURCES + 1).collect()}
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    wanted = {s: w for s, w in wanted.items() if w[0] > 0 and w[1] > 0 and have.get(s, (0, 0))[0] > 0}
    whole = sum(share for share, _ in wanted.values())
    if total is None:
        total = math.floor(min((repeat * have[s][0] * whole / share for s, (share, repeat) in wanted.items()), default=0))
    return {s: (share / whole, have[s][0], min(math.floor(total * share / whole), repeat * have[s][0]), repeat) for s, (share, repeat) in sorted(wanted.items())}


def _per_source(quota, k: int):
    """A number of each source as an expression; the sources are few and known."""
    out = F.lit(None).cast("double" if k == 0 else "long")
    for s, q in quota.items():
        out = F.when(F.col("source") == s, F.lit(q[k])).otherwise(out)
    return out


def _running(df: DataFrame, group: str, bucket: str, order: list, value, name: str) -> DataFrame:
    """df with the sum of ``value`` over the earlier rows of the group, by bucket and order."""
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_in"))
    before = sums.select(group, bucket, F.coalesce(F.sum("_in").over(outer), F.lit(0)).alias("_before"))
    rows = df.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(before, [group, bucket]).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before")


def placed(rows: DataFrame, quota, seed: int = 1) -> DataFrame:
    """doc_id, source, tokens, start: the shuffled documents of each source laid end to end; only those of its quota's sources."""
    most = max(1, math.ceil(rows.count() / BUCKET_DOCS))
    mixed = F.xxhash64(F.lit(seed), "doc_id")
    own = rows.filter(F.col("source").isin(*quota) if quota else F.lit(False)).select("doc_id", "source", "tokens", mixed.alias("_h"))
    own = own.withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(most)))
    return _running(own, "source", "_b", ["_h", "doc_id", "tokens"], F.col("tokens"), "start").select("doc_id", "source", "tokens", "start")


def chosen(rows: DataFrame, quota, seed: int = 1) -> DataFrame:
    """doc_id, source, tokens, start, repeats of the documents taken; none is taken more often than its source may repeat."""
    own = placed(rows, quota, seed)
    left = _per_source(quota, 2) - F.col("start")
    return own.withColumn("repeats", F.when(left > 0, F.ceil(left / _per_source(quota, 1))).otherwise(0).cast("int")).filter("repeats > 0")


def slots(spark, quota, block: int = BLOCK_TOKENS) -> DataFrame:
    """slot, source, k: the golden-ratio schedule, long enough for every block of every source.

    Its length is measured, not guessed: the slots of each source are counted, and it grows until none is short.
    """
    need = {s: -(-q[2] // block) for s, q in quota.items()}
    x = F.pmod(F.pmod(F.col("id"), F.lit(TURN)) * F.lit(GOLDEN), F.lit(TURN)) / F.lit(float(TURN))
    source, edge = F.lit(None).cast("string"), 1.0
    for s in reversed(list(quota)):
        source = F.when(F.col("x") < edge + 1e-12, F.lit(s)).otherwise(source)
        edge -= quota[s][0]

    def schedule(n: int) -> DataFrame:
        return spark.range(n).select(F.col("id").alias("slot"), x.alias("x")).select("slot", source.alias("source"), F.expr(f"slot div {BUCKET_SLOTS}").alias("_b"))

    count = math.ceil(max((n / quota[s][0] for s, n in need.items()), default=0)) + 64 * max(1, len(quota))
    while need:
        found = {r["source"]: r["n"] for r in schedule(count).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [(n - found.get(s, 0)) / quota[s][0] for s, n in need.items() if found.get(s, 0) < n]
        if not short:
            break
        count += math.ceil(max(short)) + 64
    return _running(schedule(count), "source", "_b", ["slot"], F.lit(1), "k").select("slot", "source", "k")


def mix(docs: DataFrame, sources: DataFrame, total: int | None = None, block: int = BLOCK_TOKENS, path: str = VOCABULARY, seed: int = 1) -> DataFrame:
    """slot, source, doc_id, pass, tokens: one row for each time a document is taken; the mix is the order (slot, position)."""
    rows = sized(docs, sources, path)
    quota = quotas(rows, sources, total)
    taken = chosen(rows, quota, seed).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    position = F.col("start") + F.col("pass") * _per_source(quota, 1)
    taken = taken.select("doc_id", "source", "tokens", "pass", position.alias("position"), F.floor(position / block).cast("long").alias("k"))
    return taken.join(slots(docs.sparkSession, quota, block), ["source", "k"]).select("slot", "position", "source", "doc_id", "pass", "tokens")


def shares(docs: DataFrame, sources: DataFrame, total: int | None = None, path: str = VOCABULARY, seed: int = 1) -> DataFrame:
    """Of each source: target_share (of those that have documents), tokens in the mix, actual_share, documents, most_repeats."""
    rows = sized(docs, sources, path)
    quota = quotas(rows, sources, total)
    by = chosen(rows, quota, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    return by.select("source", _per_source(quota, 0).alias("target_share"), "tokens", (F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(0)))).alias("actual_share"), "documents", "most_repeats")
