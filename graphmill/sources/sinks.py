"""Results written: datasets by split, predictions, corpora of blocks, small JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, as_json: bool = False) -> None:
    writer = df.write.mode("overwrite").partitionBy("split")
    writer.json(path) if as_json else writer.parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)


def write_blocks(df: DataFrame, path: str, graph_col: str = "penman_str", key_cols: tuple[str, ...] = ()) -> None:
    """Blocks between blank lines, with a comment line for each key."""
    lines = [F.concat(F.lit(f"# ::{k} "), F.col(k)) for k in key_cols]
    df.select(F.concat_ws("\n", *lines, F.col(graph_col)).alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def write_table(df: DataFrame, path: str, decimals: int = 6) -> None:
    """A tab-separated table, floating numbers with a fixed number of decimals."""
    cols = [F.format_string(f"%.{decimals}f", F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_document(df: DataFrame, path: str) -> None:
    """Each row of a small table as a JSON document."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def append_new(new: DataFrame, path: str, key: str) -> int:
    """Rows whose key the table at ``path`` doesn't hold yet are appended; their number. The table need not exist."""
    spark = new.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
    except Exception as e:  # the path does not exist yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    rows = new if done is None else new.join(done, key, "left_anti")
    from ..session import cut

    rows = cut(rows)
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def processing_info(before: DataFrame, after: DataFrame, options: dict) -> DataFrame:
    """One row: options as JSON, rows dropped, sizes of the splits. Kept ids stay a table of their own."""
    import json

    sizes = after.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    total = before.agg(F.count(F.lit(1)).alias("b"))
    entries = sizes.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "n")))).alias("final_sizes"), F.coalesce(F.sum("n"), F.lit(0)).alias("a"))
    return entries.crossJoin(total).select(F.lit(json.dumps(options, sort_keys=True)).alias("options"), (F.col("b") - F.col("a")).alias("num_dropped"), "final_sizes")
