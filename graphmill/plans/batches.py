"""Queries on batches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import batching
from ..session import table
from .base import words

QUERIES, SQL = {}, {}
SIZE, CHUNK, BUDGET = 8, 32, 500


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "prepare_dataset")
    return rows.select(F.col("row_id").alias("idx"), F.coalesce("src_lang_idx", F.lit(-1)).alias("lang"), F.coalesce(X.word_count(F.col("sentence")), F.lit(0)).alias("in_len"), X.word_count(F.col("penmanstr")).alias("out_len"))


_ROWS = f"r0 AS (SELECT row_id AS idx, coalesce(src_lang_idx, -1) AS lang, coalesce({words('sentence')}, 0)::bigint AS in_len, {words('penmanstr')}::bigint AS out_len FROM prepare_dataset)"
_BATCHES = f"""{_ROWS},
r1 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY out_len DESC, md5('0|' || idx), idx) - 1 AS r FROM r0),
r2 AS (SELECT *, r // {SIZE} AS b FROM r1),
b1 AS (SELECT lang, b, sum(in_len) AS s FROM r2 GROUP BY ALL HAVING count(*) = {SIZE}),
b2 AS (SELECT lang, b, row_number() OVER (ORDER BY s DESC, lang, b) - 1 AS batch FROM b1),
batched AS (SELECT idx, lang, in_len, batch::bigint AS batch, (r % {SIZE})::bigint AS place FROM r2 JOIN b2 USING (lang, b))"""


@_query(f"WITH {_BATCHES} SELECT idx, lang, batch, place FROM batched")
def lang_homogeneous_batches(spark: SparkSession, d: str) -> DataFrame:
    return batching.language_batches(_rows(spark, d), SIZE)


@_query(f"WITH {_BATCHES} SELECT batch, round(avg(in_len), 6) AS mean_len FROM batched GROUP BY batch")
def batch_mean_length(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return batching.language_batches(rows, SIZE).join(rows.select("idx", "in_len"), "idx").groupBy("batch").agg(F.round(F.avg("in_len"), 6).alias("mean_len"))


_CHUNKS = f"{_ROWS}, c AS (SELECT *, (row_number() OVER (ORDER BY idx) - 1) // {CHUNK} AS chunk, (row_number() OVER (ORDER BY idx) - 1) % {CHUNK} AS pos FROM r0)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return batching.chunks(_rows(spark, d), CHUNK, "idx")


@_query(f"WITH {_CHUNKS} SELECT idx, chunk::bigint AS chunk, pos::bigint AS pos FROM c")
def chunk_batches(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("idx", "chunk", "pos")


@_query(f"WITH {_CHUNKS} SELECT chunk::bigint AS batch, count(DISTINCT lang)::bigint AS languages FROM c GROUP BY chunk HAVING count(DISTINCT lang) > 1")
def batch_violations(spark: SparkSession, d: str) -> DataFrame:
    return batching.mixed_batches(_chunks(spark, d).select(F.col("chunk").alias("batch"), "lang"))


@_query(f"WITH {_CHUNKS} SELECT batch, lang FROM (SELECT chunk::bigint AS batch, lang, row_number() OVER (PARTITION BY chunk ORDER BY count(*) DESC, min(pos)) AS rn FROM c GROUP BY chunk, lang) WHERE rn = 1")
def batch_main_lang(spark: SparkSession, d: str) -> DataFrame:
    return batching.main_language(_chunks(spark, d).select(F.col("chunk").alias("batch"), "lang", "pos"))


@_query(f"""WITH RECURSIVE {_ROWS},
o AS (SELECT lang::varchar AS g, idx, greatest(in_len, 1) AS len, row_number() OVER (PARTITION BY lang ORDER BY idx) AS rn FROM r0),
p(g, idx, rn, longest, n, batch) AS (
  SELECT g, idx, rn, len, 1::bigint, 0::bigint FROM o WHERE rn = 1
  UNION ALL
  SELECT o.g, o.idx, o.rn, CASE WHEN greatest(p.longest, o.len) * (p.n + 1) <= {BUDGET} THEN greatest(p.longest, o.len) ELSE o.len END,
    CASE WHEN greatest(p.longest, o.len) * (p.n + 1) <= {BUDGET} THEN p.n + 1 ELSE 1 END,
    CASE WHEN greatest(p.longest, o.len) * (p.n + 1) <= {BUDGET} THEN p.batch ELSE p.batch + 1 END
  FROM p JOIN o ON o.g = p.g AND o.rn = p.rn + 1)
SELECT g AS "group", idx, batch FROM p""")
def token_budget_batches(spark: SparkSession, d: str) -> DataFrame:
    return batching.budget_batches(_rows(spark, d).select(F.col("lang").cast("string").alias("group"), "idx", F.col("in_len").alias("length")), BUDGET)
