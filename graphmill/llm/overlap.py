"""Same or near-same records across splits.

Near-same by words: an evaluation record and a training record share at least a given part of their distinct words. Word
n-grams are taken over the words in order of rarity (rarest first): two sets with Jaccard similarity t share at least n
of their first |x| - ceil(t |x|) + n words, so the n-grams of these words are hashed, partitioned and joined, and no pair
is lost. An n-gram that would give many candidates is hot: it is counted before, and records give it with each word of the
prefix for n + 1 words added instead, for they share at least n + 1 of these. A 64-bit parity sketch and the sizes bound the difference of a candidate from below inside the join; what stays
is compared exactly. Equal word sets are collapsed to classes before, so copies never multiply candidates.
Same by graph: equal canonical graphs, by a 128-bit hash.

A null or empty sentence, and one without letters or digits, matches no words; a null or empty graph matches no graph.
Unknown split names are neither training nor evaluation and match nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .bits import bit_set
from .canon import canonical_graph

#: Frequencies of words are counted in so many buckets of their hash: any order is exact, the bound keeps it small.
BUCKETS = 1 << 16
#: Words in an n-gram of the rarity order.
N = 2
#: Words of a record up to which pairs are found by n-grams of N words; beyond, by single words.
LONG = 256
#: A gram is hot if its candidates are more than so many times the records that hold it. Hot grams are sent as a bit set of
#: a fixed size; one that isn't hot but falls on its bits is only longer than it had to be.
HOT, BITS = 16, 1 << 26
#: Grams after which a task hands on what it has.
FLUSH = 500_000
#: Similarity as a fraction of integers, compared without rounding.
NUM, DEN = 7, 10


def folded_split(c: Column) -> Column:
    """train, validation or test; other names in lower case without blanks around."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("train", "training"), "train").when(low.isin("validation", "dev"), "validation").otherwise(low)


def word_hashes(c: Column) -> Column:
    """Sorted 64-bit hashes of the distinct words (maximal runs of letters and digits, lower case)."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.xxhash64(w))))


@F.pandas_udf(T.StringType())
def renamed_graph(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: canonical_graph(t, True) if t and t.strip() else None)


def prepared(df: DataFrame, *more: str) -> DataFrame:
    """row_id, is_eval, words (null where none), set_key and graph_key (null where none); ``more``: split (folded) and columns to be kept."""
    side = folded_split(df["split_type"])
    own = df.select(df["row_id"].cast("long").alias("row_id"), side.alias("_side"), df["sentence"].alias("_t"), df["penmanstr"].alias("_p"), *(side.alias("split") if c == "split" else df[c] for c in more))
    own = own.filter(F.col("_side").isin("train", "validation", "test"))
    own = own.select("row_id", (F.col("_side") != "train").alias("is_eval"), word_hashes(F.col("_t")).alias("w"), F.unhex(F.md5(renamed_graph("_p"))).alias("graph_key"), *more)
    own = own.withColumn("w", F.when(F.size("w") > 0, F.col("w")))
    return own.withColumn("set_key", F.unhex(F.md5(F.array_join(F.col("w").cast("array<string>"), " "))))


def _frequencies(rows: DataFrame) -> np.ndarray:
    """Rows a bucket of word hashes, over all rows: BUCKETS numbers, whatever the size of the data."""
    counts = rows.filter("w is not null").select(F.explode("w").alias("h")).groupBy(F.col("h").bitwiseAND(BUCKETS - 1).alias("b")).count()
    out = np.zeros(BUCKETS, dtype=np.int64)
    for b, n in counts.collect():
        out[b] = n
    return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        g = a * np.int64(-7046029254386353131) + b
        return (g ^ (g >> 29)) * np.int64(-4658895280553007687)


def _grams(freq: np.ndarray, hot=None, count: bool = False):
    """Hashed n-grams of the first words in order of rarity of each record, with its id, parity sketch and number of words.

    The grams of a record grow as its words to the power N. So pairs whose larger record has more than LONG words are found
    by single words (salted, so they meet no other grams): such records give these only, those that may be their smaller
    partner give both. ``hot``: a broadcast bit set of the grams to be extended. ``count``: the grams only.
    """
    pairs: dict[int, tuple[np.ndarray, ...]] = {}
    salt = np.int64(0x5DEECE66D1234567)

    def prefix(x: np.ndarray, n: int) -> np.ndarray:
        return x[: len(x) - -(-NUM * len(x) // DEN) + n]

    def run(batches):
        held_bits = np.frombuffer(hot.value, np.uint8) if hot is not None else None
        for batch in batches:
            cids, words = batch.column(0).to_numpy(), batch.column(1)
            values = words.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
            masks, sizes = np.zeros(len(cids), dtype=np.int64), np.diff(ends).astype(np.int32)
            grams: list[np.ndarray] = []
            of: list[np.ndarray] = []
            held = 0

            def flush():
                if count:
                    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64))], ["gram"])
                found, k = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (grams, of))
                return pa.RecordBatch.from_arrays([pa.array(found), pa.array(cids[k]), pa.array(masks[k]), pa.array(sizes[k])], ["gram", "cid", "mask", "n"])

            for i in range(len(cids)):
                x = values[ends[i] : ends[i + 1]]
                m = len(x)
                if m < N:
                    continue
                masks[i] = np.bitwise_xor.reduce(np.left_shift(np.int64(1), (x >> 20) & 63))
                x = x[np.lexsort((x, freq[x & (BUCKETS - 1)]))]
                with np.errstate(over="ignore"):
                    if DEN * m >= NUM * LONG:
                        grams.append((prefix(x, 1) ^ salt) * np.int64(-4658895280553007687))
                    if m <= LONG:
                        y = prefix(x, N)
                        if len(y) not in pairs:
                            pairs[len(y)] = np.triu_indices(len(y), 1)
                        j, k = pairs[len(y)]
                        g = _mixed(y[j], y[k])
                        if held_bits is not None and len(g):
                            at = g & (BITS - 1)
                            long = (held_bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                            z = prefix(x, N + 1)
                            third = np.arange(len(z))
                            fits = (third != j[long][:, None]) & (third != k[long][:, None])
                            more = _mixed(g[long][:, None] ^ salt, z[None, :])[fits]
                            g = np.concatenate([g[~long], more])
                        grams.append(g)
                while len(of) < len(grams):
                    of.append(np.full(len(grams[len(of)]), i))
                    held += len(of[-1])
                if held > FLUSH:
                    yield flush()
                    grams, of, held = [], [], 0
            yield flush()

    return run


def _hot_grams(classes: DataFrame, freq: np.ndarray) -> bytes:
    """The grams of which candidates are more than HOT times the records, as a bit set."""
    sides = (classes.filter(side).select("cid", "w").mapInArrow(_grams(freq, count=True), "gram long").select("gram", F.lit(a).alias("e"), F.lit(1 - a).alias("t")) for side, a in (("has_eval", 1), ("has_train", 0)))
    e, t = sides
    counts = e.unionByName(t).groupBy("gram").agg(F.sum("e").alias("e"), F.sum("t").alias("t")).filter(F.col("e") * F.col("t") > HOT * (F.col("e") + F.col("t")))
    return bit_set(counts.select(F.col("gram").bitwiseAND(BITS - 1)), BITS)


def _enough(overlap: Column, a: Column, b: Column) -> Column:
    return DEN * overlap >= NUM * (a + b - overlap)


def word_matches(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes: set_key, cid, n; pairs of classes: cid_e, cid_t, n_e, n_t, overlap), the pair of a class with itself included."""
    classes = cut(rows.filter("w is not null").groupBy("set_key").agg(F.min("row_id").alias("cid"), F.max("is_eval").alias("has_eval"), F.max(~F.col("is_eval")).alias("has_train"), F.first("w").alias("w")))
    freq = _frequencies(rows)
    emit, schema = _grams(freq, rows.sparkSession.sparkContext.broadcast(_hot_grams(classes, freq))), "gram long, cid long, mask long, n int"
    # each side's grams come from its own classes only
    e, t = (classes.filter(side).select("cid", "w").mapInArrow(emit, schema).select("gram", *(F.col(c).alias(f"{c}_{k}") for c in ("cid", "mask", "n"))) for side, k in (("has_eval", "e"), ("has_train", "t")))
    # the difference of two sets is at least the bits in which their parity sketches differ, and at most what the similarity leaves
    near = (F.col("cid_e") != F.col("cid_t")) & (DEN * F.least("n_e", "n_t") >= NUM * F.greatest("n_e", "n_t")) & ((DEN + NUM) * F.bit_count(F.col("mask_e").bitwiseXOR(F.col("mask_t"))) <= (DEN - NUM) * (F.col("n_e") + F.col("n_t")))
    found = e.join(t, "gram").filter(near).select("cid_e", "cid_t").distinct()
    w = classes.select("cid", "w")
    exact = found.join(w.select(F.col("cid").alias("cid_e"), F.col("w").alias("w_e")), "cid_e").join(w.select(F.col("cid").alias("cid_t"), F.col("w").alias("w_t")), "cid_t")
    exact = exact.select("cid_e", "cid_t", F.size("w_e").alias("n_e"), F.size("w_t").alias("n_t"), F.size(F.array_intersect("w_e", "w_t")).alias("overlap")).filter(_enough(F.col("overlap"), F.col("n_e"), F.col("n_t")))
    same = classes.filter("has_eval and has_train").select(F.col("cid").alias("cid_e"), F.col("cid").alias("cid_t"), F.size("w").alias("n_e"), F.size("w").alias("n_t"), F.size("w").alias("overlap"))
    return classes.select("set_key", "cid"), exact.unionByName(same)


def overlaps(df: DataFrame) -> DataFrame:
    """eval_id, train_id, by_words, by_graph of every pair of records, containment (part of the evaluation record's words in the training record, null without words match)."""
    rows = cut(prepared(df))
    classes, pairs = word_matches(rows)
    members = rows.filter("set_key is not null").select("row_id", "is_eval", "set_key").join(classes, "set_key").select("row_id", "is_eval", "cid")
    e = members.filter("is_eval").select(F.col("cid").alias("cid_e"), F.col("row_id").alias("eval_id"))
    t = members.filter("not is_eval").select(F.col("cid").alias("cid_t"), F.col("row_id").alias("train_id"))
    by_words = pairs.join(e, "cid_e").join(t, "cid_t").select("eval_id", "train_id", F.lit(True).alias("by_words"), F.lit(False).alias("by_graph"), (F.col("overlap") / F.col("n_e")).alias("containment"))
    g = rows.filter("graph_key is not null")
    ge, gt = g.filter("is_eval").select("graph_key", F.col("row_id").alias("eval_id")), g.filter("not is_eval").select("graph_key", F.col("row_id").alias("train_id"))
    by_graph = ge.join(gt, "graph_key").select("eval_id", "train_id", F.lit(False).alias("by_words"), F.lit(True).alias("by_graph"), F.lit(None).cast("double").alias("containment"))
    return by_words.unionByName(by_graph).groupBy("eval_id", "train_id").agg(F.max("by_words").alias("by_words"), F.max("by_graph").alias("by_graph"), F.max("containment").alias("containment"))


def overlap_pairs(df: DataFrame) -> DataFrame:
    """row_id_a < row_id_b of every overlap."""
    return overlaps(df).select(F.least("eval_id", "train_id").alias("row_id_a"), F.greatest("eval_id", "train_id").alias("row_id_b"))


def _with_classes(df: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """(rows with cid, null without words; pairs of word classes) of prepared rows, other columns kept."""
    rows = cut(prepared(df, *more))
    classes, pairs = word_matches(rows)
    return rows.join(classes, "set_key", "left"), pairs


def class_overlaps(df: DataFrame) -> DataFrame:
    """eval_class, train_class, eval_records, train_records, containment (part of the evaluation class's words in the training class).

    A class is the records with one set of words, named by its smallest row_id; so copies are counted, never paired.
    """
    rows, pairs = _with_classes(df)
    sizes = cut(rows.filter("cid is not null").groupBy("cid").agg(F.count_if("is_eval").alias("e"), F.count_if(~F.col("is_eval")).alias("t")))
    out = pairs.join(sizes.select(F.col("cid").alias("cid_e"), F.col("e").alias("eval_records")), "cid_e").join(sizes.select(F.col("cid").alias("cid_t"), F.col("t").alias("train_records")), "cid_t")
    return out.select(F.col("cid_e").alias("eval_class"), F.col("cid_t").alias("train_class"), "eval_records", "train_records", (F.col("overlap") / F.col("n_e")).alias("containment"))


def overlap_report(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Per folded split and source of the evaluation records: its records, those with a counterpart in train, and the pairs.

    Pairs are counted from the sizes of classes: by words, and by graph, less those that are both.
    """
    from .origin import source_of

    own = source_of(df.select("row_id", "split_type", "sentence", "penmanstr", F.col("id").alias("_id")), "_id", sources)
    rows, pairs = _with_classes(own, "split", "source")
    e = rows.filter("is_eval").groupBy("split", "source", "cid", "graph_key").agg(F.count(F.lit(1)).alias("n"))
    t = cut(rows.filter("not is_eval").groupBy("cid", "graph_key").agg(F.count(F.lit(1)).alias("k")))
    linked = pairs.select("cid_e", "cid_t")
    by_words = linked.join(t.filter("cid is not null").groupBy(F.col("cid").alias("cid_t")).agg(F.sum("k").alias("k")), "cid_t").groupBy(F.col("cid_e").alias("cid")).agg(F.sum("k").alias("words"))
    by_graph = t.filter("graph_key is not null").groupBy("graph_key").agg(F.sum("k").alias("graphs"))
    both = e.filter("cid is not null and graph_key is not null").select(F.col("cid").alias("cid_e"), "graph_key").distinct().join(linked, "cid_e").join(t.withColumnRenamed("cid", "cid_t"), ["cid_t", "graph_key"])
    both = both.groupBy(F.col("cid_e").alias("cid"), "graph_key").agg(F.sum("k").alias("both"))
    counted = e.join(by_words, "cid", "left").join(by_graph, "graph_key", "left").join(both, ["cid", "graph_key"], "left")
    k = F.coalesce("words", F.lit(0)) + F.coalesce("graphs", F.lit(0)) - F.coalesce("both", F.lit(0))
    return counted.select("split", "source", "n", k.alias("k")).groupBy("split", "source").agg(F.sum("n").alias("records"), F.sum(F.when(F.col("k") > 0, F.col("n")).otherwise(0)).alias("overlapping"), F.sum(F.col("n") * F.col("k")).alias("pairs"))
