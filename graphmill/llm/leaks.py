"""Evaluation texts leaking into training text: item-sized windows, CGK embedding, bit-sampling LSH, exact edit check.

A window is WINDOW consecutive words. The CGK embedding walks over a window with random bits shared by all windows: at
each of 3 x WINDOW steps it writes the current word and moves on or stays, as a random bit of step and word says. Two
windows within a small edit distance then differ in few written places, so hashes of a few sampled places collide; the
sampling is repeated until the target recall is reached. For an edit distance of 0 one sampling has recall 1. Every hit is
checked against the item's words exactly.

Steps are numpy operations over all windows of a batch at once. Up to BLOCK item windows their index is broadcast. More
are partitioned by their hashes: a bit set of a fixed size tells which windows of the documents may meet one, only these
leave the scan and are joined. Either way the documents are read once, whatever the number of items.

Null and empty texts, and items or documents with fewer words than a window, match nothing. Repeated items and documents
are matched each for itself.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bits import bit_set

WINDOW = 15
#: Places sampled for one hash, and the recall that repeated sampling must reach for windows at the edit distance asked.
PLACES, RECALL = 6, 0.99
#: Most windows of items whose index is broadcast, 24 bytes each for one sampling; bits of the set that sifts the windows of more.
BLOCK, BITS = 400_000, 1 << 27
_WORD = re.compile(r"[^\W_]+")
_PAD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_codes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, each distinct word hashed once."""
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in index), dtype=np.uint64, count=len(index))
    return codes[ids] if len(ids) else np.zeros(0, np.uint64)


def samplings(window: int, places: int, times: int, seed: int = 7) -> list[np.ndarray]:
    """Sampled steps of each repetition. After about 2 x window steps a walk has read its window; later ones write padding."""
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice(2 * window, size=min(places, 2 * window), replace=False)) for _ in range(times)]


def embed(codes: np.ndarray, starts: np.ndarray, window: int, sampled: list[np.ndarray]) -> np.ndarray:
    """One hash a window and repetition: the sampled steps of a CGK walk of its own over the windows that begin at ``starts``."""
    end = starts.astype(np.int64) + window
    last = len(codes) - 1
    out = np.zeros((len(sampled), len(starts)), dtype=np.uint64)
    for k, places in enumerate(sampled):
        # the random bits of a word are the bits of a hash of it, one for each step, others for each repetition
        mixed = (codes + np.uint64(0x632BE59BD9B4E019 * (k + 1) % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        wanted = set(places.tolist())
        at = starts.astype(np.int64)
        for j in range(int(places[-1]) + 1):
            inside = at < end
            here = np.minimum(at, last)
            if j in wanted:
                out[k] = (out[k] ^ np.where(inside, codes[here], _PAD)) * np.uint64(0x9FB21C651E98DF25)
                out[k] ^= out[k] >> np.uint64(31)
            if j % 64 == 63:
                mixed = mixed * np.uint64(0xD6E8FEB86659FD93) ^ (mixed >> np.uint64(7))
            at = at + (((mixed[here] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64) & inside)
    return out


def repetitions(window: int, edits: int, recall: float = RECALL, places: int = PLACES) -> int:
    """How often to sample so that windows at this edit distance share a hash with the recall asked.

    The chance of one sampling is taken from simulated windows, each with so many random substitutions, insertions and
    deletions, less two standard errors. Equal windows always share their hash.
    """
    if edits == 0:
        return 1
    rng = np.random.default_rng(11)
    n, tries = 300, 16
    base = rng.integers(1, 1 << 62, size=(n, window)).astype(np.uint64)
    changed = []
    for row in base:
        new = row.tolist()
        for _ in range(edits):
            kind, k = rng.integers(3), int(rng.integers(len(new)))
            if kind == 0:
                new[k] = int(rng.integers(1, 1 << 62))
            elif kind == 1:
                new.insert(k, int(rng.integers(1, 1 << 62)))
            else:
                new.pop(k)
        changed.append((new + rng.integers(1, 1 << 62, size=edits).tolist())[:window])
    sampled = samplings(window, places, tries)
    starts = np.arange(0, n * window, window)
    same = embed(base.reshape(-1), starts, window, sampled) == embed(np.array(changed, np.uint64).reshape(-1), starts, window, sampled)
    p = max(1e-3, same.mean() - 2 * same.std() / math.sqrt(same.size))
    # windows differ in how often they collide, so the chance of none is averaged over them by their own rates
    rates = same.mean(axis=0)
    times = max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(p, 0.999))))
    while times < 512 and 1 - np.mean((1 - np.maximum(rates, 0.5 / tries)) ** times) < recall:
        times += 1
    return times


def within(a: np.ndarray, b: np.ndarray, edits: int) -> bool:
    """Whether two word sequences are within an edit distance (banded dynamic programming)."""
    if edits == 0:
        return len(a) == len(b) and bool((a == b).all())
    if abs(len(a) - len(b)) > edits:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [edits + 1] * len(b)
        for j in range(max(1, i - edits), min(len(b), i + edits) + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        if min(new) > edits:
            return False
        row = new
    return row[-1] <= edits


class Index:
    """Hashes of the windows of a block of items, sorted, with item and place of each."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int, edits: int) -> None:
        self.window, self.edits = window, edits
        self.sampled = samplings(window, PLACES, repetitions(window, edits))
        self.codes = np.concatenate([c for _, c in items]) if items else np.zeros(0, np.uint64)
        base = np.cumsum([0, *(len(c) for _, c in items)])
        starts = [np.arange(b, b + len(c) - window + 1) for b, (_, c) in zip(base, items)]
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.items = np.repeat(np.array([i for i, _ in items], np.int64), [len(s) for s in starts])
        keys = embed(self.codes, self.starts, window, self.sampled)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def hits(self, codes: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(index into starts, item) of the windows that match."""
        found: set[tuple[int, int]] = set()
        if not len(starts) or not len(self.starts):
            return found
        for k, mine in enumerate(embed(codes, starts, self.window, self.sampled)):
            low = np.searchsorted(self.keys[k], mine)
            hit = np.flatnonzero(self.keys[k][np.minimum(low, len(self.starts) - 1)] == mine)
            high = np.searchsorted(self.keys[k], mine[hit], side="right")
            own = np.repeat(hit, high - low[hit])
            other = self.order[k][np.concatenate([np.arange(a, b) for a, b in zip(low[hit], high)])] if len(hit) else np.zeros(0, np.int64)
            if self.edits == 0:
                span = np.arange(self.window)
                same = (codes[starts[own][:, None] + span] == self.codes[self.starts[other][:, None] + span]).all(axis=1) if len(own) else np.zeros(0, bool)
                found.update(zip(own[same].tolist(), self.items[other[same]].tolist()))
            else:
                for i, o in zip(own.tolist(), other.tolist()):
                    pair = (i, int(self.items[o]))
                    a, b = starts[i], self.starts[o]
                    if pair not in found and within(codes[a : a + self.window], self.codes[b : b + self.window], self.edits):
                        found.add(pair)
        return found


#: Words whose windows are walked over at once; a longer document is walked over by itself.
STRETCH = 200_000


def _scan(index):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: dict[tuple[int, int], list[int]] = {}
            words: list[str] = []
            starts: list[np.ndarray] = []
            rows: list[int] = []

            def settle():
                if starts:
                    row_of, place_of = np.repeat(rows, [len(s) for s in starts]), np.concatenate([np.arange(len(s)) for s in starts])
                    for i, item in index.value.hits(word_codes(words), np.concatenate(starts)):
                        out.setdefault((item, int(row_of[i])), []).append(int(place_of[i]))
                words.clear(), starts.clear(), rows.clear()

            for row, text in enumerate(texts):
                own = words_of(text)
                n = len(own) - index.value.window + 1
                if n > 0:
                    starts.append(np.arange(len(words), len(words) + n))
                    rows.append(row)
                    words += own
                    if len(words) > STRETCH:
                        settle()
            settle()
            rows_ = [(item, ids[row], len(p), min(p), max(p) + index.value.window) for (item, row), p in out.items()]
            cols = list(zip(*rows_)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_id", "doc_id", "windows", "first_word", "end_word"])

    return run


def _places(batches):
    """Of item windows: the positions of their hashes in the bit set."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy() & (BITS - 1))], ["p"])


def _windows(window: int, edits: int, bits=None):
    """(key, id, place, words) of each window and repetition; with ``bits`` only of those whose hash is in the set."""

    def run(batches):
        sampled = samplings(window, PLACES, repetitions(window, edits))
        held = np.frombuffer(bits.value, np.uint8) if bits is not None else None
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = word_codes(words_of(text))
                for first in range(0, len(codes) - window + 1, STRETCH):
                    starts = np.arange(first, min(first + STRETCH, len(codes) - window + 1))
                    for k, keys in enumerate(embed(codes, starts, window, sampled)):
                        keys = (keys ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)
                        at = np.arange(len(keys))
                        if held is not None:
                            p = keys & (BITS - 1)
                            at = np.flatnonzero((held[p >> 3] >> (p & 7).astype(np.uint8)) & 1)
                        words = codes[starts[at][:, None] + np.arange(window)].view(np.int64)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * window, pa.int32()), pa.array(words.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array([row] * len(at), pa.int64()), pa.array(starts[at].astype(np.int64)), lists], ["key", "id", "place", "words"])

    return run


def _checked(edits: int):
    def run(batches):
        for b in batches:
            keep = [within(np.array(x), np.array(y), edits) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:3]], ["item_id", "doc_id", "place"])

    return run


def _partitioned(texts: DataFrame, asked: DataFrame, window: int, edits: int) -> DataFrame:
    """As leaks(), for any number of items: windows of both sides meet by their hashes in a join."""
    schema = "key long, id long, place long, words array<long>"
    mine = cut(asked.mapInArrow(_windows(window, edits), schema))
    bits = texts.sparkSession.sparkContext.broadcast(bit_set(mine.select("key").mapInArrow(_places, "p long"), BITS))
    items = mine.select("key", F.col("id").alias("item_id"), F.col("words").alias("a")).distinct()
    found = texts.mapInArrow(_windows(window, edits, bits), schema).join(items, "key").select("item_id", F.col("id").alias("doc_id"), "place", "words", "a")
    found = found.filter(F.col("words") == F.col("a")).select("item_id", "doc_id", "place") if edits == 0 else found.mapInArrow(_checked(edits), "item_id long, doc_id long, place long")
    return found.distinct().groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("windows"), F.min("place").alias("first_word"), (F.max("place") + window).alias("end_word"))


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, edits: int = 0, block: int = BLOCK) -> DataFrame:
    """item_id, doc_id, windows (of the document that match), first_word, end_word (words of the document they span).

    Repeated doc_ids are one document in the numbers of more than ``block`` item windows, and rows of their own below.
    """
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    asked = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text"))
    # as many windows as words, at most
    size = asked.agg(F.sum(F.size(F.regexp_extract_all(F.col("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))))).first()[0] or 0
    if size > block:
        return _partitioned(texts, asked, window, edits)
    held = [(item, codes) for item, codes in ((i, word_codes(words_of(t))) for i, t in asked.collect()) if len(codes) >= window]
    index = spark.sparkContext.broadcast(Index(held, window, edits))
    return texts.mapInArrow(_scan(index), "item_id long, doc_id long, windows long, first_word long, end_word long")
