"""Garbled text from wrong character encodings: found and, where possible, restored.

Each source is taken as written through an unknown cipher, learned by expectation-maximization against the character
bigrams of the languages, over all rows and in the tasks (``decipher``). There are two kinds:

* UTF-8 read through a code page, once or twice: one letter became several characters. The key space is the byte tables
  of code pages; what is learned per source is how often its text went through each (``theta``). The E-step weighs for each
  suspicious segment every letter sequence that some table gives against the segment being right as it is.
* A byte written in one page and read through another: one letter became one other letter, a substitution. What is
  learned per source is the mapping itself, character to letter, without any page being known (known pages only weigh a
  little where counts are few), and the share of its runs that went through it.

A segment is garbled if ciphers weigh more than the segment itself. It is restored with translate(): through the winning
page's byte table, which reproduces the segment when applied the other way round, or through the learned mapping. A
substitution is weighed for a field as a whole, since a decoder goes wrong for all of its letters; a source has one only if
it explains SWAPPED of its runs and LEAST of them. U+FFFD is what a decoder writes for a lost byte: the field is garbled
at once; it is restored where one letter of the language stands out.

Null and empty fields are not garbled; a null language or unknown source is a language or source of its own.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decipher
from .decipher import CLEAN, Model, first_theta, lang_code
from .origin import source_of
from .pages import LOST, garble, readings

SUSPECT = r"[^\x00-\x7f]{2}|\x{FFFD}"
ANY = r"[^\x00-\x7f]"
#: Punctuation that a lost byte may have been, beside the letters of the language.
SIGNS = "“”«»–"
_SUSPECT = re.compile("[^\x00-\x7f]{2}|\ufffd")
_RUN = re.compile("[^\x00-\x7f]+")


def _fields(df: DataFrame, sources: DataFrame, fields: tuple[str, str]) -> DataFrame:
    own = df.select(df["row_id"].cast("long").alias("row_id"), df["id"].alias("_id"), df["src_lang_idx"].cast("int").alias("lang"), df[fields[0]].alias("a"), df[fields[1]].alias("b"))
    return source_of(own, "_id", sources).select("row_id", "source", "lang", "a", "b")


def learn(df: DataFrame, sources: DataFrame, fields: tuple[str, str] = ("sentence", "snt")) -> Model:
    """The ciphers of a corpus' sources, over all its rows."""
    return decipher.learn(_fields(df, sources, fields))


@lru_cache(maxsize=10_000)
def _script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


def _lost(text: str, at: int, end: int, lang: int, model: Model) -> str | None:
    """The one letter sequence that fits a stretch with lost bytes, None where none stands out."""
    piece = text[at:end]
    left, right = text[at - 1] if at else " ", text[end] if end < len(text) else " "
    options: set[str] = set()
    scripts = {_script(c) for c in left + right if c.isalpha()}
    for letter in model.letters.get(lang, "") + SIGNS:
        if scripts and letter not in SIGNS and _script(letter) not in scripts:
            continue  # a letter is of its word's script
        if len(piece) == 1:
            options.add(letter)
        for page in ("cp1252", "latin_1"):
            g = garble(letter, page)
            if len(g) == len(piece) and all(p in (LOST, c) for p, c in zip(piece, g)):
                options.add(letter)
    if not options:
        return None
    scored = sorted(((model.chain(left + o + right, lang), o) for o in options), reverse=True)
    rest = sum(math.exp(s - scored[0][0]) for s, _ in scored[1:])
    return scored[0][1] if rest < 0.25 else None


def _unswapped(text: str, lang: int, source: str, model: Model) -> tuple[str, bool] | None:
    """The text as its source's mapping gives it and whether all of it was mapped; None if it is likelier right as it is."""
    swap = model.swaps.get(source)
    if not swap or text.isascii() or LOST in text:
        return None
    table, share = swap
    own, other, whole = math.log(1 - share + 1e-12), math.log(share + 1e-12), True
    known = model.letters.get(lang, "")
    changed = False
    for m in _RUN.finditer(text):
        run = m[0]
        new = run.translate(table)
        left, right = text[m.start() - 1] if m.start() else " ", text[m.end()] if m.end() < len(text) else " "
        own += model.chain(left + run + right, lang, 1, True)
        other += model.chain(left + new + right, lang) + model.unseen(new)
        changed = changed or new != run
        whole = whole and all(ord(c) in table or c in known for c in run)
    return (text.translate(table), whole) if changed and other > own else None


def restore(text: str | None, lang: int, source: str, model: Model) -> tuple[bool, bool, str | None]:
    """(garbled, wholly restored, text as far as restored)."""
    if not text or not _SUSPECT.search(text) and (text.isascii() or source not in model.swaps):
        return False, False, text
    theta = model.theta.get(source)
    if theta is None:
        theta = first_theta()
    garbled, whole = False, True
    edits: list[tuple[int, int, str]] = []
    for m in _RUN.finditer(text):
        run, base = m[0], m.start()
        for a, b, plains in readings(run) if len(run) > 1 else ():
            left = text[base + a - 1] if base + a else " "
            right = text[base + b] if base + b < len(text) else " "
            w = model.weigh(left, run[a:b], right, plains, lang, theta)
            if w[CLEAN] < 0.5:
                garbled = True
                by: dict[str, float] = {}
                for i, z in plains:
                    by[z] = by.get(z, 0.0) + w[i]
                edits.append((base + a, base + b, max(by, key=lambda z: (by[z], z))))
    for a, b, z in reversed(edits):
        text = text[:a] + z + text[b:]
    if not garbled:
        plain = _unswapped(text, lang, source, model)
        if plain is not None:
            return True, plain[1], plain[0]
    if LOST in text:
        garbled = True
        out, at = [], 0
        for m in re.finditer("[\x80-￿]?�[\x80-\xff–-›]?", text):
            for a, b in ((m.start(), m.end()), (text.index(LOST, m.start()), text.index(LOST, m.start()) + 1)):
                z = _lost(text, a, b, lang, model)
                if z is not None:
                    out.append(text[at:a] + z)
                    at = b
                    break
            else:
                whole = False
        text = "".join(out) + text[at:]
        whole = whole and LOST not in text
    return garbled, garbled and whole, text


def garbled_fields(df: DataFrame, sources: DataFrame, fields: tuple[str, str] = ("sentence", "snt"), model: Model | None = None) -> DataFrame:
    """row_id, field, text, restored, whole: each garbled field with its text as far as restored, and whether it is whole again."""
    model = model or learn(df, sources, fields)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            codes = lang_code(pdf["lang"])
            out = []
            for col, name in (("a", fields[0]), ("b", fields[1])):
                for row, text, lang, source in zip(pdf["row_id"].tolist(), pdf[col], codes.tolist(), pdf["source"]):
                    bad, whole, new = restore(text, lang, source, sent.value)
                    if bad:
                        out.append((row, name, text, new, whole))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()))], ["row_id", "field", "text", "restored", "whole"])

    own = _fields(df, sources, fields)
    pattern = ANY + r"|\x{FFFD}" if model.swaps else SUSPECT
    own = own.filter(F.coalesce(F.col("a").rlike(pattern), F.lit(False)) | F.coalesce(F.col("b").rlike(pattern), F.lit(False)))
    return own.mapInArrow(run, "row_id long, field string, text string, restored string, whole boolean")
