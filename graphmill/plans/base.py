"""What the queries share: tables and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import table

#: Blanks of any script, for engines whose class of blanks is ASCII only.
BLANKS = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
PUNCT = r"!-/:-@\[-`{-~"


def squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{BLANKS}', ' ', 'g'))"


def words(c: str) -> str:
    return f"(CASE WHEN {squeezed(c)} = '' THEN 0 ELSE len(string_split({squeezed(c)}, ' ')) END)"


SPLIT = "(CASE WHEN split_type IN ('train', 'training') THEN 'train' WHEN split_type IN ('validation', 'dev') THEN 'validation' WHEN split_type = 'test' THEN 'test' END)"
PLACE = "(CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END)"
#: Prepared rows in SQL: s0 normalised, s1 without texts in punctuation, s2 without repeated sentences.
PREPARED = f"""
s0 AS (SELECT row_id, id, src_lang_idx, {SPLIT} AS split, {squeezed('sentence')} AS s, penmanstr FROM prepare_dataset WHERE sentence IS NOT NULL AND {SPLIT} IS NOT NULL),
s1 AS (SELECT * FROM s0 WHERE NOT (regexp_matches(s, '^[{PUNCT}]') AND regexp_matches(s, '[{PUNCT}]$'))),
s2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY coalesce(src_lang_idx, 2147483647), {PLACE}, row_id) AS rn FROM s1) WHERE rn = 1)"""


def normalised(spark: SparkSession, d: str) -> DataFrame:
    """row_id, id, src_lang_idx, split, s (the sentence, blanks collapsed), penmanstr; rows without sentence or known split go."""
    rows = table(spark, d, "prepare_dataset").filter("sentence is not null")
    out = rows.select("row_id", "id", "src_lang_idx", X.split_name(F.col("split_type")).alias("split"), X.collapse_blanks(F.col("sentence")).alias("s"), "penmanstr")
    return out.filter("split is not null")


def unwrapped(rows: DataFrame) -> DataFrame:
    return rows.filter(~X.punct_wrapped(F.col("s")))
