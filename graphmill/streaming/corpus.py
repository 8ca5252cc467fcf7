"""Streams: corpora that arrive as files are decoded as they come; statuses are counted in windows; beams are settled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graphs import decode_any
from ..sources.corpus import graph_of, metadata_of


def stream_blocks(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    """metadata, penmanstr, status, file of the blocks of files that arrive in a folder; stateless."""
    raw = spark.readStream.schema("value string").option("lineSep", "\n\n").option("maxFilesPerTrigger", files_a_trigger).option("pathGlobFilter", "*.txt").format("text").load(path)
    own = raw.select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("block")).filter("block <> ''")
    rows = own.select("file", metadata_of(F.col("block")).alias("metadata"), graph_of(F.col("block")).alias("penmanstr"))
    return rows.withColumn("status", decode_any("penmanstr")["status"])


def status_windows(predictions: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """start, system, status, n: predictions a window of run_at; rows later than the watermark allows are left out."""
    counted = predictions.withWatermark("run_at", late).groupBy(F.window("run_at", window), "system", F.coalesce("status", F.lit("none")).alias("status"))
    return counted.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "system", "status", "n")


def best_so_far(beams: DataFrame) -> DataFrame:
    """The best candidate of each sample among those that have arrived; for complete or update mode."""
    from ..operators.resume import best_of_beam

    return best_of_beam(beams)
