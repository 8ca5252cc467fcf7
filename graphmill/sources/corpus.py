"""Corpora of graphs in files: PENMAN blocks with comment lines, one folder a split, one root a language."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.graphs import decode_graph

#: Names of the folders of splits.
FOLDERS = ("train", "training", "dev", "validation", "test")


def metadata_of(block: Column) -> Column:
    """Map of the keys of a block's comment lines; a line may hold several ``::key value``. Of repeated keys the first counts."""
    lines = F.filter(F.split(block, "\n"), lambda x: F.ltrim(x).startswith("#"))
    text = F.concat(F.lit(" "), F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s*#+", "")), " "))
    parts = F.slice(F.split(text, r"\s::"), 2, 1_000_000)
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\S+)", 1).alias("key"), F.trim(F.regexp_replace(p, r"^\S+\s*", "")).alias("value")))
    pairs = F.filter(pairs, lambda p: p["key"] != "")
    firsts = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(firsts)


def graph_of(block: Column) -> Column:
    """The block without its comment lines."""
    return F.trim(F.array_join(F.filter(F.split(block, "\n"), lambda x: ~F.ltrim(x).startswith("#")), "\n"))


def read_blocks(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """file, block_no, block: the blocks between blank lines of the .txt files of a folder, in the order of each file.

    Lines end as they like (line feed, with or without carriage return), and a line of blanks is blank too. The reader splits
    files at double line feeds, so one file may be many tasks; what is left in a piece is split within it. block_no is the
    place of the block among those of its file by byte offset order, taken over all tasks. A file that holds no double line
    feed, as with carriage returns, is one piece.
    """
    raw = spark.read.option("lineSep", "\n\n").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.txt").text(path)
    own = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_i"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    own = own.select("file", "_at", "_i", F.posexplode(F.split("value", r"\n[ \t]*(?=\n)")).alias("_k", "value")).select("file", "_at", "_i", "_k", F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("block")).filter("block <> ''")
    from ..operators.ranking import grouped_rank

    return grouped_rank(own, ["file"], [F.col("_at"), F.col("_i"), F.col("_k")], "block_no").select("file", "block_no", "block")


def read_corpus(spark: SparkSession, path: str, src_lang_idx: int | None = None, strict: bool = False) -> DataFrame:
    """file, block_no, split, metadata, sentence, penmanstr, src_lang_idx, error of a root with a folder for each split.

    A graph that can't be decoded has its error and stays; ``strict`` makes it, or a missing id or sentence, an error of the
    job that names the file. Folders of no split are left out.
    """
    folder = F.element_at(F.split("file", "/"), -2)
    blocks = read_blocks(spark, path).filter(folder.isin(*FOLDERS))
    meta = metadata_of(F.col("block"))
    rows = blocks.select("file", "block_no", X.split_name(folder).alias("split"), meta.alias("metadata"), graph_of(F.col("block")).alias("penmanstr"))
    rows = rows.withColumn("error", decode_graph("penmanstr")["error"])
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.element_at("metadata", "id").isNull() | F.element_at("metadata", "snt").isNull(), "no id or sentence")))
    if strict:
        rows = rows.withColumn("penmanstr", F.when(F.col("error").isNull(), F.col("penmanstr")).otherwise(F.raise_error(F.concat("file", F.lit(": "), "error")).cast("string")))
    return rows.select("file", "block_no", "split", "metadata", F.element_at("metadata", "snt").alias("sentence"), "penmanstr", F.lit(src_lang_idx).cast("int").alias("src_lang_idx"), "error")


def read_corpora(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Several roots, one a language, in the order of their indexes."""
    out = read_corpus(spark, roots[0], 0)
    for i, root in enumerate(roots[1:], 1):
        out = out.unionByName(read_corpus(spark, root, i))
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line of all text files of a folder; next-line signs are blanks, other line ends of Unicode split too."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    lines = F.split(X.next_line_to_space(F.col("value")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{2028}\x{2029}]")
    return raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode(lines).alias("line_no", "line"))


def read_splits(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A prepared dataset, partitioned by split; a required split that is missing is an error."""
    df = spark.read.parquet(path)
    have = {r["split"] for r in df.select("split").distinct().limit(1000).collect()} if required else set()
    missing = [s for s in required if s not in have]
    if missing:
        raise ValueError(f"no rows of split {', '.join(missing)} in {os.path.basename(path)}")
    return df
