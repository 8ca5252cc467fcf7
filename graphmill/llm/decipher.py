"""Ciphers of text sources learned by expectation-maximization against the languages' character bigrams.

Everything is counted over all rows. Counters of characters and bigrams are hashed to a fixed size, so the language model
stays as small at any size of corpus. Suspicious contexts are aggregated in the tasks and stay distributed: each round the
tasks weigh their contexts with the parameters so far (E-step) and hand on sums, one row a source and parameter, which the
driver turns into new parameters (M-step). What is garbled owes its counts to the cipher, so its share is taken out of the
language model as the rounds go. For substitutions that isn't enough, as any rare letter could be taken for a frequent one
and would lose its own counts: whether a source's characters are right as they are is judged by the other sources, the
source's own text counts only half (OWN).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .pages import CLEAN, LOST, WRITTEN, readings, usual_swaps

#: Cells of the hashed bigram and unigram counters; fixed, whatever the corpus.
BIGRAMS, UNIGRAMS = 1 << 18, 1 << 14
#: Weight of the unigram estimate in a bigram estimate, and of a character never seen.
KAPPA, NEVER = 5.0, 1e-9
#: What a reading loses for each of its characters that the corpus nowhere has, as a log.
UNSEEN = -4.0
ROUNDS, SETTLED = 25, 5e-4
#: A language's letters beyond ASCII: those that single-byte pages hold and that make one of so many of its non-ASCII characters; bounds their number.
RARE = 2000
#: Share and number of a source's runs that a substitution must explain.
SWAPPED, LEAST = 0.05, 10.0
#: What a source's own text counts for its characters being right as they are.
OWN = 0.5
#: Counts that known pairs of pages lend to a mapping, and that any pairing has.
LENT, FLAT = 1.0, 0.5
#: Numbers of an array that is worked on at once.
ROOM = 1 << 20
#: Suspicious stretches are learned from in pieces of so many characters.
PIECE = 8
_SUSPECT = re.compile("[^\x00-\x7f]{2}|�")
_RUN = re.compile("[^\x00-\x7f]+")


def _cells(a, b, lang):
    """Hash of (language, character, next character) into the counters; works on numbers and arrays alike."""
    h = (a * 0x9E3779B1 + b * 0x85EBCA6B + lang * 0xC2B2AE35) & 0xFFFFFFFF
    return ((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 14


def _cell1(a, lang):
    return ((a * 0x9E3779B1 + lang * 0x27D4EB2F) & 0xFFFFFFFF) >> 18


def lang_code(values: pd.Series) -> np.ndarray:
    """0 is all languages together, 1 no language; others follow."""
    return (pd.to_numeric(values, errors="coerce").fillna(-1).astype("int64") + 2).clip(lower=1).to_numpy()


@dataclass
class Model:
    """Counters of bigrams and unigrams (language 0 is all languages together) and what was learned of each source.

    ``theta``: share of each cipher in a source's suspicious segments, then of clean ones. ``swaps``: a source's mapping of
    characters, and the share of its runs that went through it. ``gone``: bigrams that belong to garbled text.
    """

    two: np.ndarray
    one: np.ndarray
    theta: dict[str, np.ndarray] = field(default_factory=dict)
    letters: dict[int, str] = field(default_factory=dict)
    swaps: dict[str, tuple[dict[int, str], float]] = field(default_factory=dict)
    gone: np.ndarray | None = None

    @property
    def total(self) -> float:
        if not hasattr(self, "_total"):
            self._total = self.one.sum() / 2 or 1.0
        return self._total

    def steps(self, a, b, lang, gone: np.ndarray | None = None):
        """Probability of each transition (arrays of code points); from 0, an unknown character, that of b alone; to 0, 1."""
        total, p = self.total, 0.0
        for l, w in ((lang, 0.7), (0, 0.3)):
            cell = _cells(a, b, l)
            two = self.two[cell] if gone is None else np.maximum(self.two[cell] - gone[cell], 0.0)
            p = p + w * (two + KAPPA * self.one[_cell1(b, l)] / total) / (self.one[_cell1(a, l)] + KAPPA)
        return np.where(np.equal(b, 0), 1.0, np.where(np.equal(a, 0), self.one[_cell1(b, lang)] / total, p) + NEVER)

    def by_others(self, a, b, lang, own) -> np.ndarray:
        """The same where a source's own text counts only half (OWN). ``own``: its counts of the transition, of its second
        and of its first character, each in the language and in all of them (last axis)."""
        total, p, less = self.total, 0.0, 1 - OWN
        for k, (l, w) in enumerate(((lang, 0.7), (0, 0.3))):
            two = np.maximum(self.two[_cells(a, b, l)] - less * own[..., k], 0.0)
            second = np.maximum(self.one[_cell1(b, l)] - less * own[..., 2 + k], 0.0) / total
            p = p + w * (two + KAPPA * second) / (np.maximum(self.one[_cell1(a, l)] - less * own[..., 4 + k], 0.0) + KAPPA)
        alone = np.maximum(self.one[_cell1(b, lang)] - less * own[..., 2], 0.0) / total
        return np.where(np.equal(b, 0), 1.0, np.where(np.equal(a, 0), alone, p) + NEVER)

    def chain(self, text: str, lang: int, own: int = 0, clean: bool = False) -> float:
        """Log-probability of a text's transitions; ``own`` of each transition's count are the text's own and don't speak
        for it, nor, if ``clean``, does what belongs to garbled text."""
        total, n = 0.0, self.total
        for x, y in zip(text, text[1:]):
            a, b = ord(x), ord(y)
            p = 0.0
            for l, w in ((lang, 0.7), (0, 0.3)):
                cell = _cells(a, b, l)
                two = self.two[cell] - (self.gone[cell] if clean and self.gone is not None else 0.0)
                p += w * (max(two - own, 0) + KAPPA * self.one[_cell1(b, l)] / n) / (self.one[_cell1(a, l)] + KAPPA)
            total += math.log(p + NEVER)
        return total

    def unseen(self, text: str) -> float:
        return UNSEEN * sum(not self.one[_cell1(ord(c), 0)] for c in text)

    def weigh(self, left: str, segment: str, right: str, plains, lang: int, theta: np.ndarray) -> np.ndarray:
        """Responsibility of each cipher and of the segment being right."""
        logs = np.full(CLEAN + 1, -np.inf)
        logs[CLEAN] = self.chain(left + segment + right, lang, 1) + math.log(theta[CLEAN] + 1e-12)
        seen: dict[str, float] = {}
        for i, z in plains:
            if z not in seen:
                seen[z] = self.chain(left + z + right, lang) + self.unseen(z)
            logs[i] = seen[z] + math.log(theta[i] + 1e-12)
        w = np.exp(logs - logs.max())
        return w / w.sum()


def first_theta() -> np.ndarray:
    theta = np.full(CLEAN + 1, 0.5 / CLEAN)
    theta[CLEAN] = 0.5
    return theta


# --- counting


def _contexts(text: str):
    """(character before, suspicious piece, character after) of what may be UTF-8 read through a page."""
    for m in _RUN.finditer(text):
        run, base = m[0], m.start()
        if len(run) < 2:
            continue
        for a, b, _ in readings(run):
            for k in range(base + a, base + b, PIECE):
                end = min(k + PIECE, base + b)
                yield text[k - 1] if k else " ", text[k:end], text[end] if end < len(text) else " "


def _single_contexts(text: str):
    """(character before, piece, character after) of the runs that aren't UTF-8 from end to end and that a single-byte page can write.

    Within a run the character before or after a piece is a cipher's own, so it counts as unknown (none).
    """
    for m in _RUN.finditer(text):
        run, base = m[0], m.start()
        if not WRITTEN.issuperset(run) or len(run) > 1 and any(b - a == len(run) for a, b, _ in readings(run)):
            continue
        last = m.end()
        for k in range(base, last, PIECE):
            end = min(k + PIECE, last)
            yield (text[k - 1] if k else " ") if k == base else "", text[k:end], (text[end] if end < len(text) else " ") if end == last else ""


def _count(batches):
    """Of one task: counter cells (kind 1 and 2, key the cell), letters by language (kind 3), contexts of suspicious runs (kind 0) and of runs that may be swapped (kind 4), characters by source and language (kind 5)."""
    two, one = np.zeros(BIGRAMS, np.int64), np.zeros(UNIGRAMS, np.int64)
    found: dict[tuple, int] = {}
    single: dict[tuple, int] = {}
    letters: dict[tuple[int, int], int] = {}
    by_source: dict[tuple, int] = {}
    for batch in batches:
        pdf = batch.to_pandas()
        codes = lang_code(pdf["lang"])
        places, names = pd.factorize(pdf["source"])
        for name in ("a", "b"):
            texts = pdf[name].fillna("")
            whole = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
            if len(whole) < 2:
                continue
            lang = np.repeat(codes, texts.str.len().to_numpy() + 1)[: len(whole)]
            for l in (lang, 0):
                two += np.bincount(_cells(whole[:-1], whole[1:], l[:-1] if l is lang else 0), minlength=BIGRAMS)
                one += np.bincount(_cell1(whole, l), minlength=UNIGRAMS)
            group = np.repeat(places, texts.str.len().to_numpy() + 1)[: len(whole)].astype(np.int64)
            keys, n = np.unique((group << 42) | (lang << 21) | whole, return_counts=True)
            for key, k in zip(keys.tolist(), n.tolist()):
                at = (names[key >> 42], key >> 21 & 0x1FFFFF, key & 0x1FFFFF)
                by_source[at] = by_source.get(at, 0) + k
            high = whole > 127
            for l in np.unique(lang[high]).tolist():
                chars, n = np.unique(whole[high & (lang == l)], return_counts=True)
                for c, k in zip(chars.tolist(), n.tolist()):
                    letters[l, c] = letters.get((l, c), 0) + k
            for text, l, source in zip(texts, codes.tolist(), pdf["source"]):
                if text.isascii():
                    continue
                if _SUSPECT.search(text):
                    for left, run, right in _contexts(text):
                        k = (source, l, left, run, right)
                        found[k] = found.get(k, 0) + 1
                for left, run, right in _single_contexts(text):
                    k = (source, l, left, run, right)
                    single[k] = single.get(k, 0) + 1
    rows = [(kind, 0, l, s, a, r, b, n) for kind, of in ((0, found), (4, single)) for (s, l, a, r, b), n in of.items()]
    rows += [(3, c, l, None, None, None, None, n) for (l, c), n in letters.items()]
    rows += [(5, c, l, s, None, None, None, n) for (s, l, c), n in by_source.items()]
    for kind, cells in ((1, one), (2, two)):
        at = np.flatnonzero(cells)
        rows += [(kind, int(k), 0, None, None, None, None, int(cells[k])) for k in at]
    cols = list(zip(*rows)) or [[]] * 8
    types = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["kind", "key", "lang", "source", "left", "run", "right", "n"])


def _weighed(model):
    """Of one task: contexts as code points, with what each cipher gives (index and log-probability) for suspicious segments."""

    def run(batches):
        for batch in batches:
            rows = []
            for kind, lang, source, left, piece, right, n in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 4:
                    rows.append((kind, source, lang, n, [ord(left or "\0"), *map(ord, piece), ord(right or "\0")], [], []))
                    continue
                for a, b, plains in readings(piece):
                    x, y = left if a == 0 else piece[a - 1], right if b == len(piece) else piece[b]
                    seen: dict[str, float] = {}
                    for _, z in plains:
                        if z not in seen:
                            seen[z] = model.value.chain(x + z + y, lang)
                    rows.append((kind, source, lang, n, [*map(ord, x + piece[a:b] + y)], [i for i, _ in plains], [seen[z] for _, z in plains]))
            cols = list(zip(*rows)) or [[]] * 7
            types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["kind", "source", "lang", "n", "codes", "ids", "logs"])

    return run


# --- the rounds


@lru_cache(maxsize=1)
def _usual() -> tuple[dict[tuple[int, int], list[int]], int]:
    """Of each (read, written) pair of characters the numbers of the page pairs that map so, and how many page pairs there are."""
    at: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(usual_swaps()):
        for r, w in p.items():
            at.setdefault((ord(r), ord(w)), []).append(i)
    return at, len(usual_swaps())


@lru_cache(maxsize=1)
def _mapped() -> tuple[np.ndarray, np.ndarray]:
    """All characters that single-byte pages write, and what each pair of pages (a row) makes of each of them."""
    characters = sorted(WRITTEN)
    return np.array([ord(c) for c in characters], np.int64), np.array([[ord(p.get(c, c)) for c in characters] for p in usual_swaps()], np.int64)


@dataclass
class State:
    """The parameters of one round: theta and, of substitutions, share and emissions (written to read) per source.

    ``swapped``: sources that are known to be, so what is garbled in them is taken out of the model too.
    """

    theta: dict[str, np.ndarray] = field(default_factory=dict)
    share: dict[str, float] = field(default_factory=dict)
    emit: dict[str, dict[tuple[int, int], float]] = field(default_factory=dict)
    gone: np.ndarray | None = None
    swapped: frozenset = frozenset()


def _emissions(state: State, source, written: np.ndarray, read: np.ndarray) -> np.ndarray:
    """How likely each written letter is read as each character by the source's cipher; what has no count has a flat rest."""
    own = state.emit.get(source)
    if own is None:  # before the first round: any pairing may be, those of known pages are likelier
        at, n = _usual()
        return np.array([[1 / 256 + len(at.get((y, x), ())) / n for y in read.tolist()] for x in written.tolist()])
    rest = own.get((0, 0), 1e-6)
    return np.array([[own.get((x, y), rest) for y in read.tolist()] for x in written.tolist()])


def _segments_step(model: Model, state: State, rows, sums: dict, gone: np.ndarray) -> None:
    """E-step of suspicious segments: the share of each cipher, and the bigrams that belong to garbled text."""
    codes = [np.asarray(r[2], np.int64) for r in rows]
    of = np.repeat(np.arange(len(rows)), [len(c) - 1 for c in codes])
    a, b = np.concatenate([c[:-1] for c in codes]), np.concatenate([c[1:] for c in codes])
    lang = np.array([r[0] for r in rows], np.int64)[of]
    clean = np.bincount(of, np.log(model.steps(a, b, lang, state.gone)), minlength=len(rows))
    garbled = np.zeros(len(rows))
    for i, (_, n, _, ids, logs, source) in enumerate(rows):
        theta = state.theta.get(source)
        theta = first_theta() if theta is None else theta
        ids = np.asarray(ids, np.int64)
        w = np.concatenate([np.asarray(logs) + np.log(theta[ids] + 1e-12), [clean[i] + math.log(theta[CLEAN] + 1e-12)]])
        w = np.exp(w - w.max())
        w *= n / w.sum()
        for k, x in zip((*ids.tolist(), CLEAN), w.tolist()):
            sums[0, source, k, 0] = sums.get((0, source, k, 0), 0.0) + x
        garbled[i] = n - w[-1]
    _take_out(gone, a, b, lang, garbled[of])


def _take_out(gone: np.ndarray, a, b, lang, mass) -> None:
    for l in (lang, np.zeros_like(lang)):
        np.add.at(gone, _cells(a, b, l), mass)


def _swaps_step(model: Model, state: State, source, lang: int, rows, letters: np.ndarray, sums: dict, gone: np.ndarray) -> None:
    """E-step of runs of one length, language and source: forward and backward over the letters they may stand for."""
    n = np.array([r[1] for r in rows], float)
    codes = np.array([r[2] for r in rows], np.int64)
    left, run, right = codes[:, 0], codes[:, 1:-1], codes[:, -1]
    size = run.shape[1]
    clean = model.by_others(codes[:, :-1], codes[:, 1:], lang, np.array([r[3] for r in rows], float).reshape(len(rows), size + 1, 6)).prod(axis=1)
    read, index = np.unique(run, return_inverse=True)
    emit = _emissions(state, source, letters, read)
    emit = np.where(letters[:, None] == read[None, :], 0.0, emit)  # what stays as it is isn't changed by a cipher
    at = emit.T[index.reshape(run.shape)]
    step = model.steps(letters[:, None], letters[None, :], lang, state.gone)
    forward = [model.steps(left[:, None], letters[None, :], lang, state.gone) * at[:, 0]]
    for k in range(1, size):
        forward.append(forward[-1] @ step * at[:, k])
    back = [model.steps(letters[None, :], right[:, None], lang, state.gone)]
    for k in range(size - 1, 0, -1):
        back.append((back[-1] * at[:, k]) @ step.T)
    back.reverse()
    z = (forward[-1] * back[-1]).sum(axis=1)
    if source not in state.emit:
        _first_guess(model, state, source, lang, codes, read, index, n, clean, z, sums)
    share = state.share.get(source, 0.5)
    swapped = share * z
    r = n * swapped / (swapped + (1 - share) * clean + 1e-300)
    sums[3, source, 0, 0] = sums.get((3, source, 0, 0), 0.0) + n.sum()
    sums[3, source, 1, 0] = sums.get((3, source, 1, 0), 0.0) + r.sum()
    mass = np.zeros((len(read), len(letters)))
    for k in range(size):
        np.add.at(mass, index.reshape(run.shape)[:, k], (r / np.maximum(z, 1e-300))[:, None] * forward[k] * back[k])
    for i, j in np.argwhere(mass > 1e-3).tolist():
        key = (2, source, int(letters[j]), int(read[i]))
        sums[key] = sums.get(key, 0.0) + mass[i, j]
    if source in state.swapped:
        _take_out(gone, codes[:, :-1].ravel(), codes[:, 1:].ravel(), np.full(codes[:, 1:].size, lang), np.repeat(r, size + 1))


def _first_guess(model: Model, state: State, source, lang: int, codes: np.ndarray, read: np.ndarray, index: np.ndarray, n: np.ndarray, clean: np.ndarray, free: np.ndarray, sums: dict) -> None:
    """Before the first round there is no mapping: what each known pair of pages makes of the runs, as far as it fits better
    than the runs themselves and any free pairing do, is where the rounds begin."""
    characters, mapped = _mapped()
    ways, times = np.unique(mapped[:, np.searchsorted(characters, read)], axis=0, return_counts=True)
    index = index.reshape(len(codes), -1)
    fits = np.zeros((len(ways), len(codes)))
    held = max(1, ROOM // codes.size)
    for k in range(0, len(ways), held):
        way = ways[k : k + held]
        inner = way[:, index]
        edges = [np.broadcast_to(codes[:, [c]], (len(way), len(codes), 1)) for c in (0, -1)]
        own = np.concatenate([edges[0], inner, edges[1]], axis=2)
        changed = (way != read)[:, index].any(axis=2)
        fits[k : k + held] = np.where(changed, model.steps(own[..., :-1], own[..., 1:], lang, state.gone).prod(axis=2), 0.0) * (times[k : k + held, None] / times.sum())
    fits *= n / (clean + free + fits.sum(axis=0))
    for k in np.flatnonzero(fits.sum(axis=1) > 1e-3).tolist():
        for j, c in enumerate(read.tolist()):
            m = (fits[k][:, None] * (index == j)).sum()
            if m > 1e-3:
                key = (2, source, int(ways[k, j]), c)
                sums[key] = sums.get(key, 0.0) + float(m)


def _expect(model, state):
    """Of one task: sums of its contexts, (what, source, a, b, x): shares of ciphers (0), bigrams gone (1), letters (2), runs (3)."""

    def run(batches):
        m, s = model.value, state.value
        sums: dict[tuple, float] = {}
        gone = np.zeros(BIGRAMS)
        segments, runs = [], {}
        for batch in batches:
            for kind, source, lang, n, codes, ids, logs in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    segments.append((lang, n, codes, ids, logs, source))
                else:
                    runs.setdefault((source, lang, len(codes)), []).append((lang, n, codes, logs))
            if len(segments) > 10_000:
                _segments_step(m, s, segments, sums, gone)
                segments = []
            if sum(map(len, runs.values())) > 20_000:
                settle(m, s, runs, sums, gone)
                runs = {}
        if segments:
            _segments_step(m, s, segments, sums, gone)
        settle(m, s, runs, sums, gone)
        rows = [(what, source, a, b, x) for (what, source, a, b), x in sums.items()]
        rows += [(1, None, int(c), 0, float(gone[c])) for c in np.flatnonzero(gone)]
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64()))], ["what", "source", "a", "b", "x"])

    def settle(m, s, runs, sums, gone):
        for (source, lang, _), rows in runs.items():
            letters = np.array([ord(c) for c in m.letters.get(lang, "")], np.int64)
            for k in range(0, len(rows) if len(letters) else 0, 2000):
                _swaps_step(m, s, source, lang, rows[k : k + 2000], letters, sums, gone)

    return run


def _by_source(sums: pd.DataFrame, what: int) -> dict[str, pd.DataFrame]:
    part = sums[sums["what"] == what]
    return dict(iter(part.groupby("source"))) if len(part) else {}


def _maximize(sums: pd.DataFrame) -> State:
    """M-step: new parameters from the sums of all tasks."""
    new = State(gone=np.zeros(BIGRAMS))
    cells = sums[sums["what"] == 1]
    new.gone[cells["a"].to_numpy(np.int64)] = cells["x"].to_numpy()
    for source, part in _by_source(sums, 0).items():
        mass = np.full(CLEAN + 1, 1e-3)
        mass[part["a"].to_numpy(np.int64)] += part["x"].to_numpy()
        new.theta[source] = mass / mass.sum()
    for source, part in _by_source(sums, 3).items():
        runs = part.groupby("a")["x"].sum()
        new.share[source] = float(runs.get(1, 0.0) / runs[0])
    at, pairs = _usual()
    for source, part in _by_source(sums, 2).items():
        mass = {(int(x), int(y)): m for x, y, m in zip(part["a"], part["b"], part["x"])}
        # a pair of known pages lends counts as far as the whole mapping agrees with it
        agreed = np.zeros(pairs)
        for (x, y), m in mass.items():
            for p in at.get((y, x), ()):
                agreed[p] += m
        agreed = (agreed / max(sum(mass.values()), 1e-9)) ** 10
        lent = np.zeros(pairs) if agreed.sum() <= 0 else LENT * agreed / agreed.sum() * min(1.0, agreed.max() * 4)
        counts = dict(mass)
        letters = {x for x, _ in mass}
        for p in np.flatnonzero(lent > 1e-3).tolist():
            for r, w in usual_swaps()[p].items():
                if ord(w) in letters or ord(r) in {y for _, y in mass}:
                    counts[ord(w), ord(r)] = counts.get((ord(w), ord(r)), 0.0) + lent[p]
        total: dict[int, float] = {}
        for (x, _), m in counts.items():
            total[x] = total.get(x, 0.0) + m
        new.emit[source] = {(x, y): (m + FLAT / 256) / (total[x] + FLAT) for (x, y), m in counts.items()}
        new.emit[source][0, 0] = FLAT / 256 / (max(total.values()) + FLAT)
    return new


def mapping(mass: dict[tuple[int, int], float], plain: dict[int, int], share: float, uses) -> tuple[dict[int, str], float]:
    """(character read to letter written, runs it explains), one to one, the heaviest pairs first.

    A character must give most of its mass to its letter. A cipher takes the same share of every letter, so a letter of which
    less than half that share went through it (``plain`` are its uses as itself) only lends its place to a rare character.
    What the whole corpus writes more often (``uses``) is never taken for what it writes less often.
    """
    of: dict[int, float] = {}
    for (_, y), m in mass.items():
        of[y] = of.get(y, 0.0) + m
    out: dict[int, str] = {}
    used: set[int] = set()
    explained = 0.0
    for (x, y), m in sorted(mass.items(), key=lambda p: (-p[1], p[0])):
        if x != y and y not in out and x not in used and 2 * m >= of[y] and 2 * m >= share * (m + plain.get(x, 0)) and uses(x) >= uses(y):
            out[y] = chr(x)
            used.add(x)
            explained += m
    return out, explained


def _moved(a: State, b: State) -> float:
    """The largest change of a garbled share between two rounds."""
    change = [abs(a.share.get(s, 0.5) - x) for s, x in b.share.items()]
    change += [abs(a.theta[s][CLEAN] - t[CLEAN]) if s in a.theta else 1.0 for s, t in b.theta.items()]
    return max(change, default=0.0)


CONTEXT = "kind int, source string, lang long, n long, codes array<int>, ids array<int>, logs array<double>"


def _with_own_counts(contexts: DataFrame, characters: DataFrame) -> DataFrame:
    """Contexts with, as ``logs``, six counts of their own source for each transition: of it, its second and its first
    character, each in the language and in all. Their number is bounded by the alphabets, so is what is joined."""
    contexts = contexts.withColumn("_id", F.monotonically_increasing_id())
    last = F.size("codes") - 1
    pairs = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.struct(i.alias("k"), F.get("codes", i).alias("a"), F.get("codes", i + 1).alias("b")))
    steps = contexts.select("_id", "source", "lang", "n", F.explode(pairs).alias("p")).select("_id", "source", "lang", "n", "p.k", "p.a", "p.b")

    def both(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        here = df.groupBy("source", "lang", *keys).agg(F.sum("n").alias(name))
        everywhere = here.groupBy("source", *keys).agg(F.sum(name).alias(f"{name}_all"))
        return here.join(everywhere, ["source", *keys])

    chars = both(characters, ["c"], "m")
    steps = steps.join(both(steps, ["a", "b"], "two"), ["source", "lang", "a", "b"])
    for c in ("b", "a"):
        steps = steps.join(chars.select("source", "lang", F.col("c").alias(c), F.col("m").alias(f"m_{c}"), F.col("m_all").alias(f"all_{c}")), ["source", "lang", c], "left")
    counts = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("two", "two_all", "m_b", "all_b", "m_a", "all_a")))
    own = steps.groupBy("_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", counts.alias("x")))), lambda s: s["x"])).alias("own"))
    return contexts.join(own, "_id").select("kind", "source", "lang", "n", "codes", "ids", F.col("own").alias("logs"))


def learn(own: DataFrame) -> Model:
    """The model of a corpus of (source, lang, a, b), over all its rows and both texts.

    To the driver come counters of a fixed size, letters of a language (at most RARE) and, each round, sums by source: as
    many as there are ciphers and pairs of letters, whatever the number of rows.
    """
    spark = own.sparkSession
    schema = "kind int, key long, lang long, source string, left string, run string, right string, n long"
    stats = cut(own.mapInArrow(_count, schema).groupBy("kind", "key", "lang", "source", "left", "run", "right").agg(F.sum("n").alias("n")))
    model = Model(np.zeros(BIGRAMS), np.zeros(UNIGRAMS))
    cells = stats.filter("kind in (1, 2)").select("kind", "key", "n").toPandas()
    for kind, to in ((1, model.one), (2, model.two)):
        part = cells[cells["kind"] == kind]
        to[part["key"].to_numpy()] = part["n"].to_numpy()
    high = stats.filter("kind = 3").select("lang", "key", "n")
    total = high.groupBy("lang").agg(F.sum("n").alias("all"))
    for lang, c, _ in high.join(total, "lang").filter(f"n * {RARE} >= all").select("lang", "key", "n").orderBy(F.desc("n"), "key").collect():
        if chr(c).isalpha() and chr(c) in WRITTEN:
            model.letters[lang] = model.letters.get(lang, "") + chr(c)
    sent = spark.sparkContext.broadcast(model)
    weighed = cut(stats.filter("kind in (0, 4)").select("kind", "lang", "source", "left", "run", "right", "n").mapInArrow(_weighed(sent), CONTEXT))
    # few bytes, but each costs work in every round: all cores get their part
    contexts = cut(weighed.filter("kind = 0").unionByName(_with_own_counts(weighed.filter("kind = 4"), stats.filter("kind = 5").select("source", "lang", F.col("key").cast("int").alias("c"), "n"))).repartition(spark.sparkContext.defaultParallelism))


    def expected(state: State) -> pd.DataFrame:
        held = spark.sparkContext.broadcast(state)
        sums = contexts.mapInArrow(_expect(sent, held), "what int, source string, a long, b long, x double").groupBy("what", "source", "a", "b").agg(F.sum("x").alias("x")).toPandas()
        held.unpersist()
        return sums

    state, sums = State(), None
    for _ in range(ROUNDS):
        sums = expected(state)
        new = _maximize(sums)
        moved, state = _moved(state, new), new
        if moved < SETTLED:
            break
    model.theta, model.gone = state.theta, state.gone
    swaps, runs = _by_source(sums, 2), {s: float(p.loc[p["a"] == 0, "x"].sum()) for s, p in _by_source(sums, 3).items()}
    likely = [s for s in swaps if state.share[s] >= SWAPPED]
    plain: dict[str, dict[int, int]] = {}
    uses = stats.filter("kind = 5 and key > 127").filter(F.col("source").isin(likely)).groupBy("source", "key").agg(F.sum("n").alias("n"))
    for source, c, n in uses.collect() if likely else ():
        plain.setdefault(source, {})[c] = n
    for source in likely:
        part = swaps[source]
        found, explained = mapping({(int(x), int(y)): m for x, y, m in zip(part["a"], part["b"], part["x"])}, plain.get(source, {}), state.share[source], lambda c: model.one[_cell1(c, 0)])
        if found and explained >= SWAPPED * runs[source] and explained >= LEAST:
            model.swaps[source] = (found, state.share[source])
    if model.swaps:
        state.swapped = frozenset(model.swaps)
        model.gone = _maximize(expected(state)).gone
    return model
