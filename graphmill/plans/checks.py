"""Queries on rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rejects
from ..session import wide_table


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return wide_table(spark, d, "predictions"), wide_table(spark, d, "prediction_lines")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.unusable(*_both(spark, d))


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.loaded(*_both(spark, d))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return rejects.unusable(*_both(spark, d)).groupBy("tbl", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p1_reasons": p1_reasons}
SQL: dict[str, str] = {}
