"""Graph functions for DataFrames and SQL: Arrow UDFs over the pure functions, and a table function of triples."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linear, match, penman, repair

# types as objects: a DDL text needs a running session when the module is imported
_STRING = T.StringType()
TRIPLE = T.StructType([T.StructField(f, _STRING) for f in ("source", "role", "target")])
TRIPLES = T.ArrayType(TRIPLE)
DECODED = T.StructType([T.StructField("top", _STRING), T.StructField("triples", TRIPLES), T.StructField("error", _STRING)])
STATUS = T.StructType([T.StructField("status", _STRING), T.StructField("triples", TRIPLES), T.StructField("error", _STRING)])
COUNTS = T.StructType([*(T.StructField(f, T.LongType()) for f in ("matched", "n_pred", "n_gold")), T.StructField("backed_off", T.BooleanType()), T.StructField("proved", T.BooleanType())])


def _structs(triples) -> list[dict]:
    return [{"source": s, "role": r, "target": t} for s, r, t in triples]


def _decoded(text: str | None, invert: bool) -> dict:
    try:
        g = penman.decode(text, invert)
        return {"top": g.top, "triples": _structs(g.triples), "error": None}
    except penman.DecodeError as e:
        return {"top": None, "triples": None, "error": str(e)}


@F.pandas_udf(DECODED)
def decode_graph(texts: pd.Series) -> pd.DataFrame:
    """top, triples and, where the text is no graph, the error; roles stay as they are written."""
    return pd.DataFrame([_decoded(t, False) for t in texts], columns=["top", "triples", "error"])


@F.pandas_udf(DECODED)
def decode_inverted(texts: pd.Series) -> pd.DataFrame:
    """The same with inverse roles turned round."""
    return pd.DataFrame([_decoded(t, True) for t in texts], columns=["top", "triples", "error"])


@F.pandas_udf(_STRING)
def encode_graph(triples: pd.Series) -> pd.Series:
    """One-line text of triples; null where they make no connected graph."""

    def one(ts):
        try:
            return None if ts is None else penman.encode([(t["source"], t["role"], t["target"]) for t in ts], indent=None)
        except penman.DecodeError:
            return None

    return triples.map(one)


@F.pandas_udf(T.ArrayType(_STRING))
def linear_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else linear.linearize(t))


@F.pandas_udf(STATUS)
def decode_any(texts: pd.Series) -> pd.DataFrame:
    """status (ok, fixed, backoff), triples and error of text that may be broken."""
    out = [repair.decode_text(t) for t in texts]
    return pd.DataFrame({"status": [repair.STATUS[d.status] for d in out], "triples": [_structs(d.triples) for d in out], "error": [d.error for d in out]})


@F.pandas_udf(STATUS)
def decode_token_list(tokens: pd.Series) -> pd.DataFrame:
    """The same for a linear token sequence."""
    out = [repair.decode_tokens(None if t is None else list(t)) for t in tokens]
    return pd.DataFrame({"status": [repair.STATUS[d.status] for d in out], "triples": [_structs(d.triples) for d in out], "error": [d.error for d in out]})


@F.pandas_udf(_STRING)
def delinearized(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else linear.delinearize(t))


@F.pandas_udf(_STRING)
def literals_tagged(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else linear.tagged(t, ()))


def _matched(pred: str | None, gold: str | None) -> dict:
    """Counts of a pair; what cannot be read counts as the constant fallback graph."""
    graphs, back = [], False
    for text in (pred, gold):
        try:
            graphs.append(penman.decode(text, True))
        except penman.DecodeError:
            graphs.append(penman.Graph("d2", penman.BACKOFF_TRIPLES))
            back = True
    c = match.match(graphs[0].triples, graphs[1].triples, graphs[0].top, graphs[1].top)
    return {"matched": c.matched, "n_pred": c.n_pred, "n_gold": c.n_gold, "backed_off": back, "proved": c.proved}


@F.pandas_udf(COUNTS)
def match_graphs(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_matched(p, g) for p, g in zip(pred, gold)], columns=["matched", "n_pred", "n_gold", "backed_off", "proved"])


def without_wiki(triples: Column) -> Column:
    """Triples whose :wiki targets are a plus sign; no triple is dropped."""
    return F.transform(triples, lambda t: F.when(t["role"] == ":wiki", F.struct(t["source"].alias("source"), t["role"].alias("role"), F.lit("+").alias("target"))).otherwise(t))


def triples_of(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """key, pos, source, role, target of every triple; rows whose text is no graph have none. Decoded once, written as columns."""
    own = df.select(df[key].alias("key"), df[text_col].cast("string").alias("text"))
    schema = T.StructType([T.StructField(key, own.schema["key"].dataType), T.StructField("pos", T.IntegerType()), *TRIPLE.fields])

    def run(batches):
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            for row, text in enumerate(batch.column(1).to_pylist()):
                try:
                    triples = penman.decode(text).triples
                except penman.DecodeError:
                    continue
                rows += [row] * len(triples)
                cols[0].extend(range(len(triples)))
                for i in (1, 2, 3):
                    cols[i].extend([t[i - 1] for t in triples])
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(cols[0], pa.int32()), *(pa.array(c, pa.string()) for c in cols[1:])], [key, "pos", "source", "role", "target"])

    return own.mapInArrow(run, schema)


@F.udtf(returnType=T.StructType([T.StructField("pos", T.IntegerType()), *TRIPLE.fields]))
class PenmanTriples:
    """SQL table function: the triples of a text."""

    def eval(self, text: str):
        try:
            for i, (s, r, t) in enumerate(penman.decode(text).triples):
                yield i, s, r, t
        except penman.DecodeError:
            return


def register(spark: SparkSession) -> None:
    """The functions by name in SQL."""
    for name, f in (("penman_decode", decode_graph), ("penman_decode_inverted", decode_inverted), ("penman_encode", encode_graph), ("penman_linearize", linear_tokens), ("penman_repair", decode_any), ("penman_match", match_graphs), ("penman_delinearize", delinearized)):
        spark.udf.register(name, f)
    spark.udtf.register("penman_triples", PenmanTriples)
