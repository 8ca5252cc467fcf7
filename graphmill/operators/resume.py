"""Resumable work: what is finished, what is next, what failed; joins of predictions with their references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unfinished(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key is not among the finished; a null key is never finished."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def first_unfinished(work: DataFrame, done: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n of the unfinished in order; n is counted after the finished are gone."""
    return unfinished(work, done, key).orderBy(order).limit(n)


def merged(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New rows, then those that were there; a column one side lacks is null."""
    return new.unionByName(existing, allowMissingColumns=True)


def with_reference(rows: DataFrame, references: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with each key's last reference; rows without one keep null."""
    last = references.groupBy(key).agg(F.max_by(value, order).alias("reference"))
    return rows.join(last, key, "left")


def best_of_beam(beams: DataFrame) -> DataFrame:
    """Of each sample the candidate of the lowest status, then the highest score, then the first place. One aggregation."""
    rank = F.struct("status", (-F.col("score")).alias("worse"), "beam_idx")
    best = beams.groupBy("sample_id").agg(F.min_by(F.struct("beam_idx", "status", "score", "graph"), rank).alias("b"))
    return best.select("sample_id", "b.*")
