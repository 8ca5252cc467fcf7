"""Queries on scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import graphs as G
from ..operators import scoring as S
from ..session import table, wide_table

QUERIES, SQL = {}, {}
N = S.REPLICATES


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.one_per_pair(table(spark, d, "pair_counts"))


_P = "p AS (SELECT system, uid, x.matched, x.n_pred, x.n_gold, x.backed_off FROM (SELECT system, uid, max({'matched': matched, 'n_pred': n_pred, 'n_gold': n_gold, 'backed_off': backed_off}) AS x FROM pair_counts GROUP BY ALL))"


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN 100.0::double * {a} / {b} ELSE 0.0::double END)"


def _f(m: str = "matched", p: str = "n_pred", g: str = "n_gold") -> str:
    return f"(CASE WHEN {p} + {g} > 0 THEN 200.0::double * {m} / ({p} + {g}) ELSE 0.0::double END)"


_PRF = f"round({_ratio('matched', 'n_pred')}, 6) AS precision, round({_ratio('matched', 'n_gold')}, 6) AS recall, round({_f()}, 6) AS fscore"
_SUMS = "sum(matched)::bigint AS matched, sum(n_pred)::bigint AS n_pred, sum(n_gold)::bigint AS n_gold"


@_query(f"WITH {_P} SELECT system, uid, {_PRF} FROM p")
def pair_prf(spark: SparkSession, d: str) -> DataFrame:
    return S.pair_scores(_pairs(spark, d))


@_query(f"WITH {_P} SELECT system, n, {_PRF} FROM (SELECT system, count(*)::bigint AS n, {_SUMS} FROM p GROUP BY 1)")
def micro_prf(spark: SparkSession, d: str) -> DataFrame:
    return S.micro_scores(_pairs(spark, d), "system")


@_query(f"WITH {_P} SELECT system, segment, n, {_PRF} FROM (SELECT system, lower(uid[1 : 3]) AS segment, count(*)::bigint AS n, {_SUMS} FROM p GROUP BY ALL)")
def micro_prf_by_segment(spark: SparkSession, d: str) -> DataFrame:
    return S.micro_scores(_pairs(spark, d).withColumn("segment", F.lower(F.substring("uid", 1, 3))), "system", "segment")


@_query(f"WITH {_P} SELECT system, CASE WHEN backed_off THEN 'backoff' ELSE 'scored' END AS state, count(*)::bigint AS n, round(100.0 * count_if(NOT (matched = n_pred AND matched = n_gold)) / count(*), 2)::double AS pct_imperfect FROM p GROUP BY ALL")
def score_states(spark: SparkSession, d: str) -> DataFrame:
    perfect = (F.col("matched") == F.col("n_pred")) & (F.col("matched") == F.col("n_gold"))
    return _pairs(spark, d).groupBy("system", F.when(F.col("backed_off"), "backoff").otherwise("scored").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(~perfect) / F.count(F.lit(1)), 2).alias("pct_imperfect"))


_WEIGHT = "(CASE " + " ".join(f"WHEN u < {int(p * 2**32)} THEN {k}" for k, p in enumerate(S.POISSON)) + f" ELSE {len(S.POISSON)} END)"
_REPS = f"""{_P},
draws AS (SELECT system, b, matched, n_pred, n_gold, ('0x' || md5('0|' || b || '|' || system || '|' || uid)[1 : 8])::bigint AS u FROM p, (SELECT unnest(range({N})) AS b)),
reps AS (SELECT system, b, sum(matched * {_WEIGHT})::bigint AS matched, sum(n_pred * {_WEIGHT})::bigint AS n_pred, sum(n_gold * {_WEIGHT})::bigint AS n_gold FROM draws GROUP BY ALL),
whole AS (SELECT system, {_SUMS} FROM p GROUP BY 1)"""


def _metric(name: str, expr: str) -> str:
    return f"SELECT w.system, '{name}' AS metric, any_value(w.x) AS x, quantile_cont(r.x, 0.025) AS low, quantile_cont(r.x, 0.975) AS high FROM (SELECT system, {expr} AS x FROM whole) w JOIN (SELECT system, {expr} AS x FROM reps) r USING (system) GROUP BY 1"


_CI = " UNION ALL ".join(_metric(n, e) for n, e in (("precision", _ratio("matched", "n_pred")), ("recall", _ratio("matched", "n_gold")), ("fscore", _f())))


@_query(f"WITH {_REPS} SELECT system, metric, round(x, 6) AS result, round(low, 6) AS ci_low, round(high, 6) AS ci_high FROM ({_CI})")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return S.intervals(_pairs(spark, d), N)


@_query(f"""WITH {_REPS}, ci AS ({_metric("fscore", _f())}) SELECT 'system ' || system AS label, round(x, 6) AS f1, round(round(x, 6) - round(low, 6), 6) AS below, round(round(high, 6) - round(x, 6), 6) AS above FROM ci""")
def ci_error_bars(spark: SparkSession, d: str) -> DataFrame:
    ci = S.intervals(_pairs(spark, d), N).filter("metric = 'fscore'")
    return ci.select(F.concat(F.lit("system "), "system").alias("label"), F.col("result").alias("f1"), F.round(F.col("result") - F.col("ci_low"), 6).alias("below"), F.round(F.col("ci_high") - F.col("result"), 6).alias("above"))


@_query(f"""WITH {_REPS}, o AS (SELECT a.system AS system_1, b.system AS system_2, abs(a.f - b.f) AS observed FROM (SELECT system, {_f()} AS f FROM whole) a JOIN (SELECT system, {_f()} AS f FROM whole) b ON a.system < b.system),
r AS (SELECT system, b, {_f()} AS f FROM reps)
SELECT system_1, system_2, round(any_value(observed), 6) AS observed, round(avg((abs(x.f - y.f) >= observed)::int), 6) AS pval, avg((abs(x.f - y.f) >= observed)::int) < 0.05 AS significant
FROM o JOIN r x ON x.system = system_1 JOIN r y ON y.system = system_2 AND x.b = y.b GROUP BY 1, 2""")
def significance_table(spark: SparkSession, d: str) -> DataFrame:
    return S.significance(_pairs(spark, d), N)


@_query()
def match_counts(spark: SparkSession, d: str) -> DataFrame:
    """Graphs of predictions matched with their references."""
    pairs = wide_table(spark, d, "predictions").filter("reference_penman_str is not null")
    return pairs.select("pred_id", "system", G.match_graphs("penman_str", "reference_penman_str").alias("m")).select("pred_id", "system", "m.*")


@_query()
def evaluate_systems(spark: SparkSession, d: str) -> DataFrame:
    """Micro scores of each system from its graphs."""
    return S.micro_scores(match_counts(spark, d), "system")
