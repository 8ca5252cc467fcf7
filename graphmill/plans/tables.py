"""Queries on predictions, beams and lookups, with their SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resume
from ..session import table

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@_query("SELECT sample_id, beam_idx, status, score, graph FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY status, score DESC, beam_idx) AS rn FROM beams) WHERE rn = 1")
def best_of_beam(spark: SparkSession, d: str) -> DataFrame:
    return resume.best_of_beam(table(spark, d, "beams")).select("sample_id", "beam_idx", "status", "score", "graph")


_NAMES = "CASE status WHEN 0 THEN 'ok' WHEN 1 THEN 'fixed' WHEN 2 THEN 'backoff' END"


def _name(c: str):
    return F.when(F.col(c) == 0, "ok").when(F.col(c) == 1, "fixed").when(F.col(c) == 2, "backoff")


@_query(f"SELECT {_NAMES} AS status, count(*)::bigint AS n FROM (SELECT sample_id, min(status) AS status FROM beams GROUP BY 1) GROUP BY 1")
def beam_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "beams").groupBy("sample_id").agg(F.min("status").alias("s")).groupBy(_name("s").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT system, coalesce(status, 'none') AS status, count(*)::bigint AS n FROM predictions GROUP BY ALL")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").groupBy("system", F.coalesce("status", F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT system, round(100.0 * count_if(status = 'backoff') / count(*), 6)::double AS pct FROM predictions GROUP BY 1")
def pct_backoff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").groupBy("system").agg(F.round(100.0 * F.count_if(F.col("status") == "backoff") / F.count(F.lit(1)), 6).alias("pct"))


@_query("SELECT system, count_if(penman_str IS NULL)::bigint AS no_graph, count_if(status = 'error')::bigint AS errors, count_if(run_at >= (SELECT max(run_at) FROM predictions) - INTERVAL 7 DAY)::bigint AS late FROM predictions GROUP BY 1")
def failure_counts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predictions")
    last = p.agg((F.max("run_at") - F.expr("INTERVAL 7 DAYS")).alias("since"))
    return p.crossJoin(F.broadcast(last)).groupBy("system").agg(F.count_if(F.col("penman_str").isNull()).alias("no_graph"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("run_at") >= F.col("since")).alias("late"))


@_query("SELECT system, count(*)::bigint AS kept FROM predictions WHERE penman_str IS NOT NULL GROUP BY 1")
def drop_null_predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").filter("penman_str is not null").groupBy("system").agg(F.count(F.lit(1)).alias("kept"))


@_query("SELECT pred_id, fname || '__' || sentid AS uid, uid = fname || '__' || sentid AS same FROM predictions")
def prediction_uid(spark: SparkSession, d: str) -> DataFrame:
    uid = F.concat("fname", F.lit("__"), "sentid")
    return table(spark, d, "predictions").select("pred_id", uid.alias("uid"), (F.col("uid") == uid).alias("same"))


@_query("SELECT row_id FROM prepare_dataset s WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.sentid = s.id)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "predictions").select(F.col("sentid").alias("id"))
    return resume.unfinished(table(spark, d, "prepare_dataset").select("row_id", "id"), done, "id").select("row_id")


@_query("SELECT row_id FROM prepare_dataset s WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.sentid = s.id) ORDER BY row_id LIMIT 25")
def first_n_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "predictions").select(F.col("sentid").alias("id"))
    return resume.first_unfinished(table(spark, d, "prepare_dataset").select("row_id", "id"), done, "id", "row_id", 25).select("row_id")


@_query("""SELECT id AS sentid, NULL::varchar AS system, 'new' AS state FROM (SELECT DISTINCT id FROM prepare_dataset s WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.sentid = s.id))
UNION ALL SELECT sentid, system, 'done' AS state FROM predictions""")
def resume_union(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "predictions").select("sentid", "system", F.lit("done").alias("state"))
    new = resume.unfinished(table(spark, d, "prepare_dataset").select(F.col("id").alias("sentid")).distinct(), done, "sentid").withColumn("state", F.lit("new"))
    return resume.merged(new, done).select("sentid", "system", "state")


@_query("SELECT pred_id, md5(r.penmanstr) AS reference FROM predictions p LEFT JOIN (SELECT id, arg_max(penmanstr, row_id) AS penmanstr FROM prepare_dataset GROUP BY id) r ON p.sentid = r.id")
def ref_left_join(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "prepare_dataset").select(F.col("id").alias("sentid"), "row_id", F.md5("penmanstr").alias("graph"))
    return resume.with_reference(table(spark, d, "predictions").select("pred_id", "sentid"), refs, "sentid", "row_id", "graph").select("pred_id", "reference")


_FIRST = "(SELECT system, uid, arg_min(coalesce(status, 'none'), pred_id) AS status FROM predictions GROUP BY ALL)"


@_query(f"SELECT a.status AS status_a, b.status AS status_b, count(*)::bigint AS n FROM {_FIRST} a JOIN {_FIRST} b USING (uid) WHERE a.system = 'amber' AND b.system = 'birch' GROUP BY ALL")
def pair_join(spark: SparkSession, d: str) -> DataFrame:
    """Two systems' predictions paired by uid, never by place."""
    first = table(spark, d, "predictions").groupBy("system", "uid").agg(F.min_by(F.coalesce("status", F.lit("none")), "pred_id").alias("status"))
    a, b = (first.filter(F.col("system") == s).select("uid", F.col("status").alias(f"status_{k}")) for s, k in (("amber", "a"), ("birch", "b")))
    return a.join(b, "uid").groupBy("status_a", "status_b").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT lang_name, count(*)::bigint AS n FROM prepare_dataset JOIN langs USING (src_lang_idx) GROUP BY 1")
def lang_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows are counted by index first, so only indexes meet the names."""
    counts = table(spark, d, "prepare_dataset").groupBy("src_lang_idx").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(table(spark, d, "langs"), "src_lang_idx").groupBy("lang_name").agg(F.sum("n").alias("n"))


@_query("SELECT coalesce(src_lang_idx, -1) AS src_lang_idx, count(*)::bigint AS n FROM prepare_dataset s WHERE NOT EXISTS (SELECT 1 FROM langs l WHERE l.src_lang_idx = s.src_lang_idx) GROUP BY 1")
def lang_integrity(spark: SparkSession, d: str) -> DataFrame:
    bad = table(spark, d, "prepare_dataset").join(table(spark, d, "langs"), "src_lang_idx", "left_anti")
    return bad.groupBy(F.coalesce("src_lang_idx", F.lit(-1)).alias("src_lang_idx")).agg(F.count(F.lit(1)).alias("n"))


@_query("WITH s AS (SELECT DISTINCT system FROM predictions) SELECT a.system AS system_1, b.system AS system_2 FROM s a JOIN s b ON a.system < b.system")
def system_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "predictions").select("system").distinct()
    a, b = s.select(F.col("system").alias("system_1")), s.select(F.col("system").alias("system_2"))
    return a.join(b, F.col("system_1") < F.col("system_2"))


@_query("SELECT a AS group_by_length, b AS shuffle, c AS keep_incomplete FROM (SELECT unnest([true, false]) AS a), (SELECT unnest([true, false]) AS b), (SELECT unnest([true, false]) AS c)")
def option_grid(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(product([True, False], repeat=3)), "group_by_length boolean, shuffle boolean, keep_incomplete boolean")


@_query("SELECT row_id, id FROM prepare_dataset ORDER BY row_id LIMIT 3")
def head_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "prepare_dataset").orderBy("row_id").limit(3).select("row_id", "id")
