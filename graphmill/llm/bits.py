"""Bit sets built in the tasks: of positions spread over a table, one row a part comes to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the part that a task makes.
PART = 1 << 18


def _parts(batches):
    held: dict[int, np.ndarray] = {}
    for b in batches:
        at = b.column(0).to_numpy()
        for k in np.unique(at // PART).tolist():
            own = held.setdefault(k, np.zeros(PART // 8, np.uint8))
            mine = at[at // PART == k] % PART
            np.bitwise_or.at(own, mine >> 3, (1 << (mine & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "bits"])


def bit_set(positions: DataFrame, size: int) -> bytes:
    """The set of the positions (one long column, each below ``size``, a multiple of PART) as size / 8 bytes."""
    bits = bytearray(size // 8)
    own = positions.toDF("p")
    for k, part in own.repartition(F.expr(f"p div {PART}")).mapInArrow(_parts, "part long, bits binary").toLocalIterator():
        at = slice(k * PART // 8, (k + 1) * PART // 8)
        bits[at] = bytes(x | y for x, y in zip(bits[at], part)) if any(bits[at]) else part
    return bytes(bits)
