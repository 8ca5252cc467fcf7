"""Rows that fail to parse: valid rows, and the others with a reason.

Structural indexing over whole Arrow batches: one byte buffer holds all records, a mask marks its quotes, the parity of
the quotes before a byte tells whether it lies inside a quoted field, and delimiters are the tabs at even parity. Count
and type checks then split the records. No row is looked at by Python but for the type check of its graphs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.penman import is_graph

FIELDS = ("sentence", "fname", "sentid", "uid", "penman_str", "status", "reference_penman_str")
STATUSES = ("ok", "fixed", "backoff")
TAB, QUOTE = 9, 34


def structural_index(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record of each real delimiter, its byte, records with broken quoting) of records laid end to end.

    ``data`` is the bytes of all records, ``ends`` the offsets (length records + 1). A quote that opens (odd parity
    after it) must stand at the start of a field or right after a quote, one that closes right before a delimiter, the
    end of its record or a quote; the parity of a record must be even. Empty records hold no delimiter and no error.
    """
    n = len(ends) - 1
    starts = ends[:-1]
    quotes = np.flatnonzero(data == QUOTE)
    record = np.searchsorted(ends, quotes, side="right") - 1
    first = np.searchsorted(quotes, starts)  # quotes before each record
    ordinal = np.arange(len(quotes)) - first[record]
    opening = ordinal % 2 == 0
    begin, end = starts[record], ends[record + 1]
    before = np.where(quotes > begin, data[np.maximum(quotes - 1, 0)], TAB)
    after = np.where(quotes + 1 < end, data[np.minimum(quotes + 1, max(len(data) - 1, 0))], TAB) if len(data) else quotes
    wrong = np.where(opening, (before != TAB) & (before != QUOTE), (after != TAB) & (after != QUOTE))
    # a quote that opens right after a quote continues its field: that quote must be the one that closed it
    broken = np.zeros(n, dtype=bool)
    broken[record[wrong]] = True
    counts = np.bincount(record, minlength=n)
    broken |= counts % 2 == 1
    tabs = np.flatnonzero(data == TAB)
    of = np.searchsorted(ends, tabs, side="right") - 1
    outside = (np.searchsorted(quotes, tabs) - first[of]) % 2 == 0
    return of[outside], tabs[outside], broken


#: Bytes of a file that are indexed at once; a record longer than that widens the window.
WINDOW = 1 << 20


def split_records(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of the records of a file, without their line breaks (LF or CRLF).

    A record ends at a line break at even parity of quotes. Where a quote stands wrongly its parity means nothing: that
    record is its first line only, and the index starts anew after it, so one broken record spoils no other. Empty lines
    are no records.
    """
    out: list[tuple[int, int]] = []
    pos, width, n = 0, WINDOW, len(data)
    while pos < n:
        piece = np.frombuffer(data, dtype=np.uint8, count=min(width, n - pos), offset=pos)
        quotes = np.flatnonzero(piece == QUOTE)
        breaks = np.flatnonzero(piece == 10)
        even = np.searchsorted(quotes, breaks) % 2 == 0
        ends = breaks[even]
        before = np.where(quotes > 0, piece[np.maximum(quotes - 1, 0)], 10)
        after = np.where(quotes + 1 < len(piece), piece[np.minimum(quotes + 1, len(piece) - 1)], 10)
        opening = np.arange(len(quotes)) % 2 == 0
        good_before, good_after = np.isin(before, (TAB, QUOTE, 10)), np.isin(after, (TAB, QUOTE, 10, 13))
        wrong = quotes[np.where(opening, ~good_before, ~good_after)]
        last = pos + len(piece) >= n
        if last and len(quotes) % 2 and not len(wrong):
            wrong = quotes[-1:]
        limit = int(wrong[0]) if len(wrong) else len(piece)
        at = 0
        for e in ends[ends < limit].tolist():
            out.append((pos + at, pos + e))
            at = e + 1
        if len(wrong):
            e = data.find(b"\n", pos + at)
            e = n if e < 0 else e
            out.append((pos + at, e))
            pos, width = e + 1, WINDOW
        elif last:
            if pos + at < n:
                out.append((pos + at, n))
            pos = n
        elif at:
            pos, width = pos + at, WINDOW
        else:
            width *= 2
    return [(a, b - 1 if b > a and data[b - 1] == 13 else b) for a, b in out if data[a:b].strip(b"\r")]


def read_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """batch_file, rec_no, raw of the records of tab-separated files; a file is one task, files are many."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = split_records(data)[int(header) :]
                raw = [data[a:b].decode("utf-8", "replace") for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(raw), pa.string()), pa.array(range(len(raw)), pa.int32()), pa.array(raw, pa.string())], ["batch_file", "rec_no", "raw"])

    return files.mapInArrow(run, "batch_file string, rec_no int, raw string")


def _unquote(field: bytes) -> str:
    if field[:1] == b'"':
        field = field[1:-1].replace(b'""', b'"')
    return field.decode("utf-8", "replace")


def _bad_value(penman: str | None, status: str | None, reference: str | None) -> bool:
    return bool((status and status not in STATUSES) or (penman and not is_graph(penman)) or not is_graph(reference))


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, whatever its slice."""
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _line_batch(batch: pa.RecordBatch, keep: bool) -> pa.RecordBatch:
    ids, raw = batch.column(0), batch.column(1)
    missing = np.asarray(raw.is_null())
    data, ends = _buffers(raw.fill_null(""))
    of, tabs, broken = structural_index(data, ends)
    n = len(raw)
    columns = np.bincount(of, minlength=n) + 1 if n else np.zeros(0, int)
    at = np.concatenate([[0], np.cumsum(columns - 1)])
    content = data.tobytes()
    reason: list[str | None] = [None] * n
    fields: list[tuple | None] = [None] * n
    for i in range(n):
        if missing[i]:
            reason[i] = "columns"
        elif broken[i]:
            reason[i] = "quoting"
        elif columns[i] != len(FIELDS):
            reason[i] = "columns"
        else:
            cuts = tabs[at[i] : at[i + 1]].tolist()
            bounds = list(zip([int(ends[i]), *(c + 1 for c in cuts)], [*cuts, int(ends[i + 1])]))
            values = [_unquote(content[a:b]) for a, b in (bounds if keep else bounds[4:])]
            if _bad_value(*values[-3:]):
                reason[i] = "value"
            elif keep:
                fields[i] = tuple(values)
    out = [ids, pa.array(reason, pa.string())]
    if keep:
        out += [pa.array([f and f[k] for f in fields], pa.string()) for k in range(len(FIELDS))]
    names = ["rec_id", "reason", *(FIELDS if keep else ())]
    return pa.RecordBatch.from_arrays(out, names)


def parse_lines(df: DataFrame, id_col: str = "rec_id", raw_col: str = "raw", keep_fields: bool = True) -> DataFrame:
    """One row per raw record: rec_id, reason (null for valid rows) and, of valid rows, the seven fields as text.

    The reason is the first that holds: ``quoting``, ``columns``, ``value``. A null or empty record has one field and so
    the reason ``columns``. Repeated records are judged each for itself; an empty table gives an empty result; columns
    beside the two named are ignored. An empty penman_str or status is valid and comes out as empty text.
    """
    schema = T.StructType([T.StructField("rec_id", T.LongType()), T.StructField("reason", T.StringType()), *(T.StructField(f, T.StringType()) for f in (FIELDS if keep_fields else ()))])

    def run(batches):
        for b in batches:
            yield _line_batch(b, keep_fields)

    return df.select(df[id_col].cast("long").alias("rec_id"), df[raw_col].cast("string").alias("raw")).mapInArrow(run, schema)


def check_rows(df: DataFrame, id_col: str = "pred_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """rec_id and reason (``value`` or null) of loaded prediction rows, by the types of their three checked fields, and the columns to keep as text.

    Null or empty penman_str and status are valid; a null or empty reference is not a graph and so not valid.
    """
    schema = "rec_id long, reason string" + "".join(f", `{c}` string" for c in keep)

    def run(batches):
        for b in batches:
            bad = map(_bad_value, *(b.column(k).to_pylist() for k in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["value" if x else None for x in bad], pa.string()), *b.columns[4:]], ["rec_id", "reason", *keep])

    checked = ("penman_str", "status", "reference_penman_str")
    return df.select(df[id_col].cast("long").alias("rec_id"), *(df[c].cast("string") for c in checked), *(df[c].cast("string").alias(f"_{c}") for c in keep)).mapInArrow(run, schema)


def unusable(predictions: DataFrame, lines: DataFrame) -> DataFrame:
    """tbl, rec_id, reason of every unusable record of both tables."""
    both = [check_rows(predictions).select(F.lit("predictions").alias("tbl"), "rec_id", "reason"), parse_lines(lines, keep_fields=False).select(F.lit("prediction_lines").alias("tbl"), "rec_id", "reason")]
    return both[0].unionByName(both[1]).filter(F.col("reason").isNotNull())


def loaded(predictions: DataFrame, lines: DataFrame) -> DataFrame:
    """The valid rows of both tables in one schema: tbl, rec_id and the seven fields (empty status and graph as null)."""
    own = check_rows(predictions, keep=FIELDS).filter(F.col("reason").isNull()).select(F.lit("predictions").alias("tbl"), "rec_id", *FIELDS)
    read = parse_lines(lines).filter(F.col("reason").isNull()).select(F.lit("prediction_lines").alias("tbl"), "rec_id", *FIELDS)
    both = own.unionByName(read)
    return both.select("tbl", "rec_id", *(F.nullif(F.col(c), F.lit("")).alias(c) if c in ("penman_str", "status") else F.col(c) for c in FIELDS))
