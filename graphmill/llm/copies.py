"""Duplicates hidden by formatting: canonical form, 128-bit hash, map-side combined counts, collision check.

Nulls: two null sentences are alike and differ from an empty one; a null graph counts as an empty one; a null language is
a language of its own. Empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .canon import canonical_graph, plain_sentence


@F.pandas_udf(T.StringType())
def graph_form(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: canonical_graph(t) if t is not None else "")


def keyed(df: DataFrame, id_col: str = "row_id", group_cols: tuple[str, ...] = ("src_lang_idx",), text_col: str = "sentence", graph_col: str = "penmanstr") -> DataFrame:
    """row_id, a 128-bit key of the canonical record (binary) and an independent 64-bit check. 24 bytes leave a row, whatever its length."""
    own = df.select(df[id_col].cast("long").alias("row_id"), *(df[c].alias(f"_g{i}") for i, c in enumerate(group_cols)), plain_sentence(df[text_col]).alias("_s"), graph_form(df[graph_col]).alias("_p"))
    parts = [*(F.col(f"_g{i}").cast("string") for i in range(len(group_cols))), F.col("_s")]
    record = F.concat(*(F.concat(F.coalesce(F.length(p).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts), F.lit("|"), F.col("_p"))
    return own.select("row_id", record.alias("_r")).select("row_id", F.unhex(F.md5("_r")).alias("key"), F.xxhash64("_r").alias("chk"))


def collapse(keys: DataFrame) -> DataFrame:
    """One row a group: keep_id (its smallest row_id), copies, and collided (whether its 128-bit key holds another record too).

    The check is part of the grouping key, so two records with one 128-bit hash never merge; they are only reported.
    A group of any size is one row a task before the shuffle.
    """
    groups = keys.groupBy("key", "chk").agg(F.min("row_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    return groups.groupBy("key").agg(F.collect_list(F.struct("chk", "keep_id", "copies")).alias("g")).select("key", (F.size("g") > 1).alias("collided"), F.explode("g").alias("g")).select("key", "g.chk", "g.keep_id", "g.copies", "collided")


def copy_links(keys: DataFrame) -> DataFrame:
    """keep_id, copy_id of every copy. Rows join their group's one row; a hot key is the streamed side, which AQE splits."""
    keys = cut(keys)
    many = keys.groupBy("key", "chk").agg(F.min("row_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return keys.join(many, ["key", "chk"]).filter("row_id > keep_id").select("keep_id", F.col("row_id").alias("copy_id"))


def deduplicated(df: DataFrame) -> DataFrame:
    """The kept record of each group, all its columns, with its number of copies as n_copies (a column of that name is replaced)."""
    groups = collapse(keyed(df)).select("keep_id", "copies")
    own = df.drop("n_copies")
    kept = own.join(groups, own["row_id"] == groups["keep_id"])
    return kept.select(*(own[c] for c in own.columns), groups["copies"].alias("n_copies"))
