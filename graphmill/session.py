"""Session helpers: tables, the shared checkpoint folder, lineage cuts."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, as Parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same for work that is heavy on CPU: a table of fewer scan tasks than cores is dealt out over them.

    Projections and filters still reach the scan. Large tables have more tasks than cores and are read as they are.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the session names in ``spark.checkpoint.dir``; where it is unset, a local one for
    local masters only, on a cluster an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "graphmill-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def _archive() -> bytes:
    """This package as a zip file, empty where it isn't in a folder of its own."""
    root = os.path.dirname(os.path.abspath(__file__))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for at, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once an application; needed where it isn't installed there.

    The archive lies in the shared checkpoint folder, whatever its file system; a local folder serves local masters only.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    data = bytearray(_archive())
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/graphmill-{sc.applicationId}.zip")
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    stream.write(data, 0, len(data))
    stream.close()
    sc.addPyFile(path.toString())
    _shipped.add(sc.applicationId)
