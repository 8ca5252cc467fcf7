"""Batches of rows: of one language and like lengths, and packed under a token budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ranking import grouped_rank


def hashed(seed: int, c: Column) -> Column:
    """A shuffle key that is the same in every engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string")))


def language_batches(df: DataFrame, size: int = 8, seed: int = 0, group_by_length: bool = True, keep_incomplete: bool = False, shuffle: bool = True) -> DataFrame:
    """idx, lang, batch (place of the batch), place (of the row in it). df: idx, lang, in_len, out_len.

    Batches hold rows of one language, by output length falling (ties shuffled by a hash). Full batches come first, by mean
    input length falling where shuffled, else by language and place; incomplete ones last, if kept at all. A null language
    is a language of its own. Rows without any output length are only predicted for: their order is kept, all are kept.
    """
    rows = df.select("idx", "lang", "in_len", "out_len")
    if rows.filter("out_len is not null").isEmpty():
        group_by_length, keep_incomplete, shuffle = False, True, False
    order = [F.desc_nulls_last("out_len")] if group_by_length else []
    order += [hashed(seed, F.col("idx"))] if shuffle else []
    ranked = grouped_rank(rows, ["lang"], [*order, F.col("idx")], "_r")
    ranked = ranked.withColumn("_b", F.floor(F.col("_r") / size).cast("long")).withColumn("place", F.col("_r") % size)
    batches = ranked.groupBy("lang", "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("in_len").alias("_s"))
    batches = batches.withColumn("_full", F.col("_n") == size)
    if not keep_incomplete:
        batches = batches.filter("_full")
    mean = F.when(F.col("_full"), F.col("_s")).otherwise(0) if shuffle and group_by_length else F.lit(0)
    batches = grouped_rank(batches.withColumn("_mean", mean), [], [F.desc("_full"), F.desc("_mean"), F.asc_nulls_first("lang"), F.col("_b")], "batch")
    batches = batches.select(F.col("lang").alias("_lang"), F.col("_b").alias("_bb"), "batch")
    return ranked.join(batches, ranked["lang"].eqNullSafe(batches["_lang"]) & (ranked["_b"] == batches["_bb"])).select("idx", "lang", "batch", "place")


def mixed_batches(df: DataFrame) -> DataFrame:
    """batch, languages of the batches with more than one language. df: batch, lang."""
    n = F.countDistinct(F.coalesce(F.col("lang").cast("string"), F.lit("none")))
    return df.groupBy("batch").agg(n.alias("languages")).filter("languages > 1")


def main_language(df: DataFrame) -> DataFrame:
    """batch, lang: each batch's most frequent language, of equals the one seen first. df: batch, lang, pos."""
    counts = df.groupBy("batch", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return counts.groupBy("batch").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("first"))).alias("lang"))


#: Rows of one task of packing; a batch is never longer than the budget, so that is all a task reads beyond its rows.
CHUNK = 100_000


def _next(lengths, start: int, budget: int) -> int:
    """The row after the batch that begins at ``start``: rows join while longest x number stays within the budget."""
    longest, k = lengths[start], 1
    if longest > budget:
        return start + 1
    while start + k < len(lengths) and max(longest, lengths[start + k]) * (k + 1) <= budget:
        longest = max(longest, lengths[start + k])
        k += 1
    return start + k


def budget_batches(df: DataFrame, budget: int = 500, chunk: int = CHUNK) -> DataFrame:
    """group, idx, batch (from 0 in its group): rows of a group packed greedily in order of idx. df: group, idx, length.

    A batch takes rows while its longest times its number stays within the budget; a row beyond it is a batch of its own.
    The packing is sequential, its parts are not: a chunk of rows is packed from each place at which a batch may enter it,
    the chunks' entries are then chained (one small row a chunk and entry), and each chunk is packed once more from its own.
    Lengths of null or 0 count as 1.
    """
    budget = max(1, budget)
    rows = grouped_rank(df.select("group", "idx", F.greatest(F.coalesce("length", F.lit(1)), F.lit(1)).cast("long").alias("length")), ["group"], [F.col("idx")], "r")
    rows = cut(rows.withColumn("c", F.floor(F.col("r") / chunk).cast("long")))
    # a batch that begins in a chunk may end up to `budget` rows later
    ahead = rows.filter((F.col("r") % chunk < budget) & (F.col("c") > 0)).withColumn("c", F.col("c") - 1)
    both = rows.unionByName(ahead)

    def exits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        lengths, own = pdf["length"].tolist(), int((pdf["r"] // chunk == key[1]).sum())
        out, count = [0] * (own + 1), [0] * (own + 1)
        for i in range(own - 1, -1, -1):
            j = _next(lengths, i, budget)
            out[i], count[i] = (j - own, 1) if j >= own else (out[j], count[j] + 1)
        k = min(own, budget)
        return pd.DataFrame({"group": [key[0]] * k, "c": [key[1]] * k, "entry": range(k), "exit": out[:k], "batches": count[:k], "rows": [own] * k})

    table = both.groupBy("group", "c").applyInPandas(exits, "group string, c long, entry long, exit long, batches long, rows long")

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Entry and first batch of each chunk of a group, from its few rows."""
        by = {(c, e): (x, b) for c, e, x, b in zip(pdf["c"], pdf["entry"], pdf["exit"], pdf["batches"])}
        rows_of = dict(zip(pdf["c"], pdf["rows"]))
        entry, first, out = 0, 0, []
        for c in sorted(rows_of):
            out.append((key[0], c, entry, first))
            if entry >= rows_of[c]:
                entry -= rows_of[c]
                continue
            x, b = by[c, entry]
            entry, first = x, first + b
        return pd.DataFrame(out, columns=["group", "c", "entry", "first"])

    starts = table.groupBy("group").applyInPandas(chain, "group string, c long, entry long, first long")
    starts = starts.select(F.col("group").alias("g2"), F.col("c").alias("c2"), "entry", "first")
    placed = both.join(starts, both["group"].eqNullSafe(starts["g2"]) & (both["c"] == starts["c2"])).drop("g2", "c2")

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r").reset_index(drop=True)
        lengths, own = pdf["length"].tolist(), int((pdf["r"] // chunk == key[1]).sum())
        i, b = int(pdf["entry"].iloc[0]), int(pdf["first"].iloc[0])
        batch = [-1] * len(pdf)
        while i < own:
            j = _next(lengths, i, budget)
            for k in range(i, j):
                batch[k] = b
            i, b = j, b + 1
        pdf["batch"] = batch
        return pdf.loc[pdf["batch"] >= 0, ["group", "idx", "batch"]]

    return placed.groupBy("group", "c").applyInPandas(pack, "group string, idx long, batch long")


def chunks(df: DataFrame, size: int, order: str) -> DataFrame:
    """df with chunk, the number of its run of ``size`` rows in order, and pos in it."""
    ranked = grouped_rank(df, [], [F.col(order)], "_r")
    return ranked.withColumn("chunk", F.floor(F.col("_r") / size).cast("long")).withColumn("pos", F.col("_r") % size).drop("_r")


