"""Corpus preparation: repeated sentences, languages assigned evenly over lengths, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .ranking import first_values, grouped_rank, keep_first


def _scan_order() -> list:
    """Language (rows without one last), split."""
    return [F.coalesce("src_lang_idx", F.lit(2**31 - 1)), X.split_place(F.col("split"))]


def first_of_sentence(rows: DataFrame) -> DataFrame:
    """Of each sentence the first row in scan order: language, split, row. Empty sentences are one sentence."""
    return keep_first(rows, F.unhex(F.md5("s")), _scan_order(), "row_id")


def first_of_sentence_values(rows: DataFrame, *carry: str) -> DataFrame:
    """The same rows, of which only some narrow columns are wanted; so the rows are not joined back."""
    return first_values(rows, F.unhex(F.md5("s")), [*_scan_order(), F.col("row_id")], list(carry))


def assigned_languages(rows: DataFrame, languages: int, lead: int = 0) -> DataFrame:
    """row_id, id, split, assigned: rows of the lead language in order of their graph's length, dealt to the languages in turn."""
    own = rows.filter(F.col("src_lang_idx") == lead).select("row_id", "id", "split", F.length("penmanstr").alias("_len"))
    ranked = grouped_rank(own, ["split"], [F.col("_len"), F.col("row_id")], "_r")
    return ranked.select("row_id", "id", "split", (F.col("_r") % languages).cast("int").alias("assigned"))


def rows_of_assigned(rows: DataFrame, languages: int, lead: int = 0) -> DataFrame:
    """The rows whose language is the one their graph was dealt to; a graph is its id and split, its first lead row counts."""
    dealt = assigned_languages(rows, languages, lead).groupBy("id", "split").agg(F.min_by("assigned", "row_id").alias("assigned"))
    return rows.join(dealt, ["id", "split"]).filter(F.col("src_lang_idx") == F.col("assigned"))
