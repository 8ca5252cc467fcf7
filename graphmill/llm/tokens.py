"""Token budgets: how many tokens a text has under an existing vocabulary, per source, language and domain.

Longest-match counts: a trie over the vocabulary's bytes with failure links. Each node holds how many tokens are certain
when no byte continues it and the node that then goes on, so a text is counted in one pass that never steps back, and the
counts are exactly those of greedy longest-match segmentation. The vocabularies at hand merge pairs (BPE), for which the
longest match is an estimate; ``merged`` counts exactly as such a tokenizer does, so both come out side by side.

Texts are cut into stretches of blanks and what follows; no token of these vocabularies crosses the cut. A stretch is
counted once a Python worker and remembered (a cache of bounded size), so a corpus costs one look-up a word.

Null texts have 0 tokens, like empty ones. An unknown source, language or domain is a group of its own.
"""

from __future__ import annotations

import base64
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .origin import domain_of, language_of, source_of

#: The vocabulary that is used unless another path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stretches that a worker remembers.
CACHE = 400_000
_STRETCH = re.compile(r"\s*\S+|\s+")


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token to rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Trie:
    """Longest-match segmentation with failure links; tokens are bytes, any set of them.

    A byte that starts no token is a token of its own. Every node knows what is certain once no byte continues it: the longest
    token on its path (or its first byte, where none is) and the node where the rest of the path leads, by the same rule.
    """

    def __init__(self, tokens) -> None:
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for t in sorted(t for t in tokens if t):
            v = 0
            for b in t:
                w = self.next[v].get(b)
                if w is None:
                    w = self.next[v][b] = len(self.next)
                    self.next.append({})
                    final.append(False)
                v = w
            final[v] = True
        n = len(self.next)
        #: where a node goes on when a byte doesn't continue it, and the tokens that are then certain
        self.fail, self.emit = [0] * n, [0] * n
        todo: deque[tuple[int, int, int]] = deque((v, 0, b) for b, v in self.next[0].items())
        while todo:
            v, parent, byte = todo.popleft()
            if final[v] or parent == 0:
                self.emit[v] = 1  # a token, or a byte that only begins one
            else:
                self.fail[v], more = self._advance(self.fail[parent], byte)
                self.emit[v] = self.emit[parent] + more
            todo.extend((w, v, b) for b, w in self.next[v].items())

    def _advance(self, v: int, byte: int) -> tuple[int, int]:
        """(node, certain tokens) after one more byte; nodes above must know their failures."""
        k = 0
        while True:
            w = self.next[v].get(byte)
            if w is not None:
                return w, k
            if v == 0:
                return 0, k + 1
            k += self.emit[v]
            v = self.fail[v]

    def count(self, data: bytes) -> int:
        """Tokens of the longest-match segmentation."""
        total, v = 0, 0
        nxt, fail, emit = self.next, self.fail, self.emit
        for b in data:
            w = nxt[v].get(b)
            while w is None:
                if v == 0:
                    total += 1
                    w = 0
                    break
                total += emit[v]
                v = fail[v]
                w = nxt[v].get(b)
            v = w
        while v:
            total += emit[v]
            v = fail[v]
        return total


def greedy_count(data: bytes, tokens: set[bytes]) -> int:
    """The same by definition, for tests: take the longest token again and again."""
    longest, i, n = max(map(len, tokens)), 0, 0
    while i < len(data):
        i += next((k for k in range(min(longest, len(data) - i), 0, -1) if data[i : i + k] in tokens), 1)
        n += 1
    return n


class Counts(dict):
    """Stretch to its counts, longest-match in the upper half of the number and merged in the lower."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import regex
        import tiktoken

        self.pieces = regex.compile(PATTERN)
        self.trie = Trie(ranks)
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, stretch: str) -> int:
        pieces = [p.encode("utf-8", "replace") for p in self.pieces.findall(stretch)]
        n = (sum(map(self.trie.count, pieces)) << 32) + len(self.coder.encode_ordinary(stretch))
        if len(self) > CACHE:
            self.clear()
        if len(stretch) < 200:
            self[stretch] = n
        return n

    def of(self, text: str | None) -> tuple[int, int]:
        if not text:
            return 0, 0
        n = sum(map(self.__getitem__, _STRETCH.findall(text)))
        return n >> 32, n & 0xFFFFFFFF


_workers: dict[int, Counts] = {}


def counts_of(ranks: dict[bytes, int]) -> Counts:
    """One automaton a worker and vocabulary."""
    key = hash((len(ranks), next(iter(ranks), b""), next(reversed(ranks), b"")))
    if key not in _workers:
        _workers.clear()
        _workers[key] = Counts(ranks)
    return _workers[key]


def count_tokens(df: DataFrame, text_col: str, keep: tuple[str, ...], path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep``, tokens (longest match), merged_tokens and chars of each row's text."""
    ranks = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))  # as large as the vocabulary, not the data
    own = df.select(*(df[c] for c in keep), df[text_col].cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]) + ", tokens long, merged_tokens long, chars long"

    def run(batches):
        counter = counts_of(ranks.value)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            n = [counter.of(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in n], pa.int64()), pa.array([y for _, y in n], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], [*b.schema.names[:-1], "tokens", "merged_tokens", "chars"])

    return own.mapInArrow(run, schema)


def _sample_texts(samples: DataFrame, langs: DataFrame, sources: DataFrame) -> DataFrame:
    rows = source_of(language_of(samples.select("row_id", "id", "src_lang_idx", "sentence", "penmanstr"), "src_lang_idx", langs), "id", sources)
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("sentence", "penmanstr"))))
    return rows.select(F.col("row_id").cast("long").alias("row_id"), "source", "lang", fields.alias("f")).select(F.lit("prepare_dataset").alias("tbl"), "row_id", "f.field", "source", "lang", "f.text")


def _document_texts(docs: DataFrame) -> DataFrame:
    lang = F.lower(F.trim("lang"))
    return docs.select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("long").alias("row_id"), F.lit("text").alias("field"), F.coalesce("source", F.lit("unknown")).alias("source"), F.when(lang.rlike("^[a-z]{2}$"), lang).otherwise("unknown").alias("lang"), "text")


def token_rows(samples: DataFrame, docs: DataFrame, langs: DataFrame, sources: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """tbl, row_id, field, source, lang, domain and counts of every text of both tables."""
    texts = _sample_texts(samples, langs, sources).unionByName(_document_texts(docs))
    return domain_of(count_tokens(texts, "text", ("tbl", "row_id", "field", "source", "lang"), path), sources)


def token_budget(samples: DataFrame, docs: DataFrame, langs: DataFrame, sources: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Totals per table, field, source, language and domain; added up in the tasks before anything is shuffled."""
    rows = token_rows(samples, docs, langs, sources, path)
    return rows.groupBy("tbl", "field", "source", "lang", "domain").agg(F.count(F.lit(1)).alias("n_texts"), *(F.sum(c).alias(c) for c in ("chars", "tokens", "merged_tokens")))
