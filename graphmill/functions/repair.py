"""Graphs from malformed token sequences: one tolerant pass with a stack, then a status for each.

OK: a connected graph came out. FIXED: it was in parts, which are now the operands of a new ``and``. BACKOFF: nothing could
be built; a constant graph stands in. The order OK < FIXED < BACKOFF ranks candidates.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

from .linear import delinearize, split_except_quotes
from .penman import BACKOFF_TRIPLES, INSTANCE, DecodeError, decode, encode, is_graph

OK, FIXED, BACKOFF = 0, 1, 2
STATUS = ("ok", "fixed", "backoff")
_VAR = re.compile(r"[a-z]\d*\Z")
_POINTER = re.compile(r"(<pointer:\d+>)(.*)", re.S)
_PLAIN = re.compile(r"\d*\.?\d*\Z")


class Decoded(NamedTuple):
    triples: list
    status: int
    error: str | None


def _class(t: str) -> str:
    """Class of a token: i, var, const, edge, word, or the sign itself."""
    if t in ("(", ")", "/"):
        return t
    if t == "i":
        return "i"
    if _VAR.match(t):
        return "var"
    if t[:1] == ":":
        return "edge"
    if t in "+-" or not t[0].isalpha() or re.search(r"[,:/().!?\\]", t):
        return "const"
    return "word"


def _constant(t: str) -> str:
    """A constant as it may stand in a graph: quoted where its signs need it, never half quoted."""
    if '"' in t:
        return '"' + t.replace('"', "") + '"'
    plain = _PLAIN.match(t) and t.count(".") < 2
    return f'"{t}"' if not plain and re.search(r"[,:/().!?\\_=]", t) else t


def _clean(tokens: list[str]) -> list[str]:
    """Tokens without foreign tags, text set off from the pointer it is glued to, a lone colon joined with what follows."""
    out: list[str] = []
    for t in map(str, tokens):
        m = _POINTER.match(t)
        if m:
            out += [m[1], m[2]] if m[2] else [m[1]]
        elif t == ":negation":
            out += [":polarity", "-"]
        elif not (t[:1] == "<" and t[-1:] == ">"):
            out.append(t)
    joined: list[str] = []
    for t in out:
        if joined and joined[-1] == ":":
            joined[-1] += t
        elif t:
            joined.append(t)
    return joined


def _names(tokens: list[str]) -> dict[str, str]:
    """Variable of each pointer that is defined: the first letter of its concept, and a number from the second on."""
    seen: Counter[str] = Counter()
    out: dict[str, str] = {}
    for before, pointer, concept in zip(["(", *tokens], tokens, tokens[1:]):
        if before == "(" and pointer.startswith("<pointer:"):
            letter = next((c.lower() for c in concept if c.isalpha()), "x")
            letter = letter if "a" <= letter <= "z" else "x"
            seen[letter] += 1
            out[pointer] = letter + (str(seen[letter]) if seen[letter] > 1 else "")
    return out


def build(tokens: list[str]) -> list[tuple[str, str, str]]:
    """Triples of a token sequence, whatever is wrong with its brackets and edges. Raises where nothing can be built.

    Unclosed nodes are closed at the end, the text ends where the first node closes. A node without concept is a
    ``thing``; an edge without target is dropped, at the very end it gets a new ``thing``. A second definition of a variable
    makes a new one, and later mentions mean that. An undefined pointer or one in the last place cannot be read.
    """
    tokens = _clean(tokens)
    if not tokens:
        raise DecodeError("no tokens")
    names = _names(tokens)
    if tokens[-1].startswith("<pointer:"):
        raise DecodeError("a pointer in the last place")
    stream: list[str] = []
    for t, after in zip(tokens, [*tokens[1:], ""]):
        if t.startswith("<pointer:"):
            if t not in names:
                raise DecodeError(f"undefined pointer {t}")
            if after[:1] == ":" or after == ")":
                stream.append(names[t])
            else:
                stream += [*([] if stream and stream[-1] == "(" else ["("]), names[t], "/"]
        else:
            stream.append(t)

    triples: list[list[str]] = []
    concept_at: dict[str, int] = {}
    renamed: dict[str, str] = {}
    stack: list[str] = []
    role: str | None = None
    expect = "node"
    i, n, fresh = 0, len(stream), 1000
    if stream[0] != "(":
        stream.insert(0, "(")
        n += 1

    def opened(v: str) -> None:
        nonlocal fresh, role, expect
        if v in concept_at:
            renamed[v] = f"z{fresh}"
            fresh += 1
            v = renamed[v]
        if stack:
            triples.append([stack[-1], role, v])
        role = None
        concept_at[v] = len(triples)
        triples.append([v, INSTANCE, "thing"])
        stack.append(v)
        expect = "concept"

    while i < n:
        t = stream[i]
        kind = _class(t)
        i += 1
        if kind == "(":
            named = i < n and _class(stream[i]) in ("var", "i")
            if named and (not stack or role is not None):
                i += 1
                opened(stream[i - 1])
            # a bracket without variable or role opens nothing
        elif kind == ")":
            if not stack:
                continue
            role = None
            stack.pop()
            expect = "edge"
            if not stack:
                break
        elif kind == "/":
            if expect == "concept" and i < n and _class(stream[i]) in ("word", "i", "var"):
                triples[concept_at[stack[-1]]][2] = stream[i]
                i += 1
                expect = "edge"
            elif i < n and expect != "concept" and _class(stream[i]) in ("word", "i", "var"):
                i += 1  # a second concept
        elif kind == "edge" and stack:
            role = t
            expect = "target"
        elif role is not None and expect == "target":
            if kind in ("var", "i"):
                triples.append([stack[-1], role, renamed.get(t, t)])
                role, expect = None, "edge"
            elif kind == "const" or role == ":mode":
                triples.append([stack[-1], role, _constant(t)])
                role, expect = None, "edge"
    if role is not None and stack:
        triples += [[stack[-1], role, "z2000"], ["z2000", INSTANCE, "thing"]]
    if not triples:
        raise DecodeError("no node")
    return [tuple(t) for t in triples]


def parts(triples) -> list[list[str]]:
    """Variables of each connected part, parts and variables in the order of definition."""
    order = [s for s, r, _ in triples if r == INSTANCE]
    known = set(order)
    parent = {v: v for v in order}

    def root(v: str) -> str:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for s, r, t in triples:
        if r != INSTANCE and s in known and t in known:
            a, b = root(s), root(t)
            if a != b:
                parent[b] = a
    groups: dict[str, list[str]] = {}
    for v in dict.fromkeys(order):
        groups.setdefault(root(v), []).append(v)
    return list(groups.values())


def connect(triples, strict_names: bool = False):
    """(triples, status): parts of a graph become operands of a new ``and``, each by its variable first in name and number.

    ``strict_names``: a variable without number among several parts is an error, as in tools that read the number only.
    """
    groups = parts(triples)
    if len(groups) < 2:
        return triples, OK
    if strict_names and any(not v[1:].isdigit() for g in groups for v in g):
        raise DecodeError("a variable without number")
    taken = {v for g in groups for v in g}
    k = len(taken) + 1
    while f"a{k}" in taken:
        k += 1
    top = f"a{k}"
    first = [min(g, key=lambda v: (v[:1], int(v[1:]) if v[1:].isdigit() else 1, v)) for g in groups]
    return [*((top, f":op{i}", v) for i, v in enumerate(first, 1)), *triples, (top, INSTANCE, "and")], FIXED


def decode_tokens(tokens: list[str] | None, strict_names: bool = False) -> Decoded:
    """A graph for any token sequence, with its status."""
    try:
        triples, status = connect(build(tokens or []), strict_names)
        encode(triples, triples[0][0])
        return Decoded(triples, status, None)
    except (DecodeError, KeyError, IndexError) as e:
        return Decoded(BACKOFF_TRIPLES, BACKOFF, str(e))


def decode_linear(text: str | None, roles=()) -> Decoded:
    """A graph for the text that a model's tokens decode to."""
    if not text or not text.strip():
        return Decoded(BACKOFF_TRIPLES, BACKOFF, "empty text")
    return decode_tokens(split_except_quotes(delinearize(text, roles)))


_LOOSE = re.compile(r'"[^"]*"|[()/]|:[^\s()"]+|[^\s()"/]+')


def decode_text(text: str | None) -> Decoded:
    """A graph for PENMAN text that may be broken: OK as it is, else rebuilt from its tokens (FIXED), else BACKOFF."""
    if text and is_graph(text):
        try:
            return Decoded(list(decode(text).triples), OK, None)
        except DecodeError:
            pass
    if not text or "(" not in text:
        return Decoded(BACKOFF_TRIPLES, BACKOFF, "no graph in the text")
    out = decode_tokens(_LOOSE.findall(text[text.index("(") :]))
    return out if out.status == BACKOFF else Decoded(out.triples, FIXED, out.error)
