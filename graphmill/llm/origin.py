"""Source, language and domain of rows, from the fixed tables sources and langs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Most rows of a dimension table that becomes part of an expression; a larger one is an error, never a silent broadcast.
MOST = 10_000


def _lookup(rows: list[tuple], key: Column, match) -> Column:
    out = F.lit(None).cast("string")
    for k, v in rows:
        out = F.when(match(key, k), F.lit(v)).otherwise(out)
    return F.coalesce(out, F.lit(UNKNOWN))


def _small(df: DataFrame, *cols: str) -> list[tuple]:
    rows = [tuple(r) for r in df.select(*cols).limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"a dimension table holds more than {MOST} rows")
    return sorted(rows, key=str)


def source_of(df: DataFrame, id_col: str, sources: DataFrame) -> DataFrame:
    """df with ``source``: the one whose id_prefix the id starts with, in any letter case; ``unknown`` where none does."""
    low = F.lower(F.col(id_col))
    rows = sorted(_small(sources, "id_prefix", "source"), key=lambda r: len(r[0]))  # a longer prefix is tested first
    return df.withColumn("source", _lookup(rows, low, lambda c, k: c.startswith(k.lower())))


def domain_of(df: DataFrame, sources: DataFrame, source_col: str = "source") -> DataFrame:
    return df.withColumn("domain", _lookup(_small(sources, "source", "domain"), F.col(source_col), lambda c, k: c == k))


def language_of(df: DataFrame, idx_col: str, langs: DataFrame) -> DataFrame:
    return df.withColumn("lang", _lookup(_small(langs, "src_lang_idx", "lang"), F.col(idx_col), lambda c, k: c == k))
