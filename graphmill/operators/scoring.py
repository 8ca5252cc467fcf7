"""Scores of systems: micro precision, recall and F1 from pair counts, bootstrap intervals, significance of differences.

Micro scores are ratios of sums over pairs, so a replicate is a weighted sum of counts that are known: no graph is matched
twice. Weights are Poisson(1) draws from a hash of replicate, system and pair, the bootstrap that needs neither a join nor
the number of rows, in one pass and the same in every engine with md5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Poisson(1): the chance of at most k, to a precision beyond the 32 bits of a draw.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020, 0.9999998885745217)
REPLICATES = 1000


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, 100.0 * a / b).otherwise(0.0)


def f1(m: Column, p: Column, g: Column) -> Column:
    """F1 in percent from sums: twice the matched by all of both."""
    return F.when(p + g > 0, 200.0 * m / (p + g)).otherwise(0.0)


def one_per_pair(df: DataFrame) -> DataFrame:
    """One row a system and pair: of repeated ones the largest counts, so the result doesn't hang on their order."""
    best = F.max(F.struct("matched", "n_pred", "n_gold", "backed_off")).alias("b")
    return df.groupBy("system", "uid").agg(best).select("system", "uid", "b.*")


def pair_scores(df: DataFrame) -> DataFrame:
    return df.select("system", "uid", *_prf(F.col("matched"), F.col("n_pred"), F.col("n_gold")))


def _prf(m: Column, p: Column, g: Column) -> list[Column]:
    return [F.round(x, 6).alias(n) for x, n in ((ratio(m, p), "precision"), (ratio(m, g), "recall"), (f1(m, p, g), "fscore"))]


def micro_scores(df: DataFrame, *by: str) -> DataFrame:
    sums = df.groupBy(*by).agg(*(F.sum(c).cast("long").alias(c) for c in ("matched", "n_pred", "n_gold")), F.count(F.lit(1)).alias("n"))
    return sums.select(*by, "n", *_prf(F.col("matched"), F.col("n_pred"), F.col("n_gold")))


def draw(*parts: Column) -> Column:
    """A whole number below 2**32 from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def poisson(d: Column) -> Column:
    out = F.lit(len(POISSON))
    for k in range(len(POISSON) - 1, -1, -1):
        out = F.when(d < int(POISSON[k] * 2**32), k).otherwise(out)
    return out.cast("long")


def replicates(df: DataFrame, n: int = REPLICATES, seed: int = 0) -> DataFrame:
    """system, b, matched, n_pred, n_gold: the sums of each replicate. Rows are expanded and summed within tasks first.

    The rows are few and narrow beside their draws, so they are dealt out over all cores before they are expanded.
    """
    narrow = df.select("system", "uid", "matched", "n_pred", "n_gold").repartition(df.sparkSession.sparkContext.defaultParallelism, "uid")
    drawn = narrow.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))
    w = poisson(draw(F.lit(seed), F.col("b"), F.col("system"), F.col("uid")))
    return drawn.withColumn("w", w).filter("w > 0").groupBy("system", "b").agg(*(F.sum(F.col(c) * F.col("w")).cast("long").alias(c) for c in ("matched", "n_pred", "n_gold")))


def intervals(df: DataFrame, n: int = REPLICATES, level: float = 0.95, seed: int = 0) -> DataFrame:
    """system, metric, result, ci_low, ci_high."""
    reps = replicates(df, n, seed)
    q = [(1 - level) / 2, (1 + level) / 2]
    metrics = {"precision": lambda: ratio(F.col("matched"), F.col("n_pred")), "recall": lambda: ratio(F.col("matched"), F.col("n_gold")), "fscore": lambda: f1(F.col("matched"), F.col("n_pred"), F.col("n_gold"))}
    long = reps.select("system", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), m().alias("x")) for k, m in metrics.items()))).alias("v")).select("system", "v.*")
    ci = long.groupBy("system", "metric").agg(F.percentile("x", F.array(*map(F.lit, q))).alias("q"))
    whole = df.groupBy("system").agg(*(F.sum(c).cast("long").alias(c) for c in ("matched", "n_pred", "n_gold")))
    whole = whole.select("system", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), m().alias("result")) for k, m in metrics.items()))).alias("v")).select("system", "v.*")
    return whole.join(ci, ["system", "metric"]).select("system", "metric", F.round("result", 6).alias("result"), F.round(F.col("q")[0], 6).alias("ci_low"), F.round(F.col("q")[1], 6).alias("ci_high"))


def significance(df: DataFrame, n: int = REPLICATES, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """system_1, system_2, observed, pval, significant: of each pair of systems, how often replicates of both differ at least as much as they do."""
    whole = df.groupBy("system").agg(*(F.sum(c).cast("long").alias(c) for c in ("matched", "n_pred", "n_gold"))).select("system", f1(F.col("matched"), F.col("n_pred"), F.col("n_gold")).alias("f"))
    reps = replicates(df, n, seed).select("system", "b", f1(F.col("matched"), F.col("n_pred"), F.col("n_gold")).alias("f"))
    a, b = whole.select(F.col("system").alias("system_1"), F.col("f").alias("f1")), whole.select(F.col("system").alias("system_2"), F.col("f").alias("f2"))
    seen = a.join(b, F.col("system_1") < F.col("system_2")).select("system_1", "system_2", F.abs(F.col("f1") - F.col("f2")).alias("observed"))
    x, y = reps.select(F.col("system").alias("system_1"), "b", F.col("f").alias("r1")), reps.select(F.col("system").alias("system_2"), "b", F.col("f").alias("r2"))
    drawn = x.join(y, "b").filter("system_1 < system_2").join(seen, ["system_1", "system_2"])
    p = drawn.groupBy("system_1", "system_2").agg(F.first("observed").alias("observed"), F.avg((F.abs(F.col("r1") - F.col("r2")) >= F.col("observed")).cast("int")).alias("pval"))
    return p.select("system_1", "system_2", F.round("observed", 6).alias("observed"), F.round("pval", 6).alias("pval"), (F.col("pval") < alpha).alias("significant"))
