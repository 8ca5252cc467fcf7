"""Sequence functions on arrays of numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def argmax(c: Column) -> Column:
    """Place of the first largest element, from 0; null for null, -1 for an empty array."""
    return F.coalesce(F.array_position(c, F.array_max(c)), F.when(c.isNotNull(), 0).cast("long")) - 1


def replaced(c: Column, old: int, new: int) -> Column:
    return F.transform(c, lambda x: F.when(x == old, new).otherwise(x))


def without_last(c: Column) -> Column:
    return F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))


def without_first(c: Column) -> Column:
    return F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))


def truncated(c: Column, most: int, specials: int = 0) -> Column:
    return F.slice(c, 1, max(0, most - specials))


def padded(c: Column, length: Column, pad: int) -> Column:
    return F.concat(c, F.array_repeat(F.lit(pad), F.greatest(length - F.size(c), F.lit(0)).cast("int")))


def without_special(c: Column, specials: list[int]) -> Column:
    """Elements that are neither special nor negative."""
    return F.filter(c, lambda x: (x >= 0) & ~x.isin(*specials) if specials else x >= 0)


def mapped(c: Column, table: dict, default=None) -> Column:
    """Each element through a small table."""
    entries = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))
    return F.transform(c, lambda x: F.coalesce(F.element_at(entries, x), F.lit(default)))


def matches(predicted: Column, labels: Column, ignored: int = IGNORED) -> tuple[Column, Column]:
    """(equal, counted) places of two arrays where the label is not ignored."""
    pairs = F.filter(F.arrays_zip(predicted.alias("p"), labels.alias("l")), lambda z: z["l"] != ignored)
    return F.size(F.filter(pairs, lambda z: z["p"] == z["l"])).cast("long"), F.size(pairs).cast("long")
