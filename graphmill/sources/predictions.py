"""Tables of predictions as tab-separated files, statistics as JSON, system files side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "sentence string, fname string, sentid string, uid string, penman_str string, status string, reference_penman_str string"


def read_predictions(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """Quoted fields may hold tabs and line breaks; inner quotes are doubled."""
    return spark.read.schema(columns).option("sep", "\t").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_systems(spark: SparkSession, paths: list[str], names: list[str]) -> DataFrame:
    """Several files of predictions with the name of their system; as many names as files."""
    if len(paths) != len(names):
        raise ValueError("as many names as files are needed")
    return reduce(DataFrame.unionByName, [read_predictions(spark, p).withColumn("system", F.lit(n)) for p, n in zip(paths, names)])


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """tokenizer, split, stats of a document {tokenizer: {split: {statistic: value}}}, flattened by two explodes."""
    text = spark.read.text(path, wholetext=True)
    nested = F.from_json("value", "map<string,map<string,map<string,string>>>")
    outer = text.select(F.explode(nested).alias("tokenizer", "splits"))
    return outer.select("tokenizer", F.explode("splits").alias("split", "stats"))
