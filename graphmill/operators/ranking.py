"""Places of rows in an order, exact and distributed: no group, however large, is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def grouped_rank(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's place (from 0, bigint) within its group by ``order``, which should have no ties.

    One range shuffle on group and order; a row's place in its sorted partition, less where its group begins there, plus
    the group's rows in earlier partitions. The counts that are summed have a row for each partition and group in it.
    """
    keys = [F.col(g) for g in group]
    own = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__rank_m", F.monotonically_increasing_id())
    own = cut(own.select("*", F.shiftright("__rank_m", 33).alias("__rank_p"), F.col("__rank_m").bitwiseAND((1 << 33) - 1).alias("__rank_i")).drop("__rank_m"))
    firsts = own.groupBy("__rank_p", *group).agg(F.min("__rank_i").alias("__rank_first"), F.count(F.lit(1)).alias("__rank_n"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__rank_p").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(F.col("__rank_p").alias("__rank_q"), *(F.col(g).alias(f"__rank_g{i}") for i, g in enumerate(group)), (F.coalesce(F.sum("__rank_n").over(earlier), F.lit(0)) - F.col("__rank_first")).alias("__rank_shift"))
    same = own["__rank_p"] == firsts["__rank_q"]
    for i, g in enumerate(group):
        same = same & own[g].eqNullSafe(firsts[f"__rank_g{i}"])
    return own.join(firsts, same).withColumn(name, (F.col("__rank_i") + F.col("__rank_shift")).cast("long")).drop("__rank_p", "__rank_i", "__rank_q", "__rank_shift", *(f"__rank_g{i}" for i in range(len(group))))


def keep_first(df: DataFrame, key: Column, order: list[Column], id_col: str) -> DataFrame:
    """The first row of each key by ``order`` (ending in the unique id): one aggregation with map-side combining, no window."""
    place = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col(id_col).alias("id"))
    kept = df.select(key.alias("_k"), place.alias("_o")).groupBy("_k").agg(F.min("_o").alias("_o")).select(F.col("_o.id").alias("_kept"))
    return df.join(kept, df[id_col] == kept["_kept"], "left_semi")


def first_values(df: DataFrame, key: Column, order: list[Column], carry: list[str]) -> DataFrame:
    """The columns ``carry`` of the first row of each key by ``order`` (ending in a unique one): one shuffle, no join."""
    place = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    kept = df.select(key.alias("_k"), place.alias("_o")).groupBy("_k").agg(F.min("_o").alias("_o"))
    return kept.select(*(F.col(f"_o.c{i}").alias(c) for i, c in enumerate(carry)))
