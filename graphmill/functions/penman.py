"""Codec for PENMAN notation: syntax check, text to triples, triples to text. Pure Python, used inside Arrow UDFs."""

from __future__ import annotations

import re
from typing import NamedTuple

INSTANCE = ":instance"
#: Fallback graph for what cannot be decoded; fixed value of the reference.
BACKOFF_TRIPLES = [("d2", INSTANCE, "dog"), ("b1", INSTANCE, "bark-01"), ("b1", ":ARG0", "d2")]
#: Roles that end in -of but are not inverses; fixed values of the AMR model.
NOT_INVERSE = frozenset({":consist-of", ":prep-on-behalf-of", ":prep-out-of"})

LITERAL = r'"[^"\\]*(?:\\.[^"\\]*)*"'
_LIT = re.compile(LITERAL, re.S)
_CONTROL = re.compile("[\x00-\x08]")
_ROLE = re.compile(r'(?<![^\s()"/\x01]):[^\s()"/\x01]+')
_ATOM = re.compile(r'[^\s()"/\x01\x02]+')
_BLANK = re.compile(r"\s+")
_LOCAL = re.compile("\\(\x03/\x03(?:\x02[\x01\x03]|\x02\\(\x03/\x03|\\))*")
_LONE_COLON = re.compile(r'(?<![^\s()"/\x01]):(?=[\s()"/\x01]|\Z)')
_TOKEN = re.compile(rf'{LITERAL}|[()/]|[^\s()"/]+|\S', re.S)


class DecodeError(ValueError):
    """The text is not one PENMAN graph."""


class Graph(NamedTuple):
    top: str | None
    triples: list[tuple[str, str, str | None]]


def is_graph(text: str | None) -> bool:
    """Whether the text is exactly one node ``( variable / concept role target ... )`` and nothing else.

    Linear in the text: literals, roles and atoms become one character each, what may follow what is one regular
    expression over these, and the brackets must close exactly at the end. Null and empty text: false.
    """
    if not text:
        return False
    s = _LIT.sub("\x01", _CONTROL.sub("x", text))
    if '"' in s or _LONE_COLON.search(s):
        return False
    s = _BLANK.sub("", _ATOM.sub("\x03", _ROLE.sub("\x02", s)))
    if not s or s[-1] != ")" or s.count("(") != s.count(")") or not _LOCAL.fullmatch(s):
        return False
    depth, last = 0, len(s) - 1
    for m in re.finditer(r"[()]", s):
        depth += 1 if m[0] == "(" else -1
        if depth == 0 and m.start() != last:
            return False
    return True


def decode(text: str | None, invert: bool = False) -> Graph:
    """Triples in the order of the text; a node's :instance comes where the node opens.

    ``invert`` turns ``x :role-of y`` into ``y :role x`` (the default model); without it roles stay verbatim. A missing
    concept or target gives a null target. Raises DecodeError for text that is not one graph.
    """
    if not text or not text.strip():
        raise DecodeError("empty text")
    tokens = _TOKEN.findall(text)
    n, i = len(tokens), 0
    triples: list[tuple[str, str, str | None]] = []
    stack: list[str] = []
    role: str | None = None
    top: str | None = None

    def emit(source: str, r: str, target: str | None) -> None:
        triples.append((source, r, target))

    while i < n:
        t = tokens[i]
        if top is not None and not stack:
            raise DecodeError("text after the graph")
        if t == "(":
            if i + 1 >= n or tokens[i + 1] in "()/" or tokens[i + 1][0] in ':"':
                raise DecodeError("a node without variable")
            var = tokens[i + 1]
            if stack:
                if role is None:
                    raise DecodeError("a node without role")
                emit(stack[-1], role, var)
                role = None
            else:
                top = var
            i += 2
            concept = None
            if i < n and tokens[i] == "/":
                i += 1
                if i < n and tokens[i] not in ("(", ")", "/") and tokens[i][0] != ":":
                    concept = tokens[i]
                    i += 1
            emit(var, INSTANCE, concept)
            stack.append(var)
            continue
        if not stack:
            raise DecodeError("text outside a node")
        if t == ")":
            if role is not None:
                emit(stack[-1], role, None)
                role = None
            stack.pop()
        elif t[0] == ":" and len(t) > 1:
            if role is not None:
                emit(stack[-1], role, None)
            role = t
        elif t == "/" or t == '"' or t == ":":
            raise DecodeError(f"misplaced {t}")
        else:
            if role is None:
                raise DecodeError(f"target without role: {t}")
            emit(stack[-1], role, t)
            role = None
        i += 1
    if stack or top is None:
        raise DecodeError("a bracket is not closed")
    if invert:
        nodes = {s for s, r, _ in triples if r == INSTANCE}
        triples = [(t, r[:-3], s) if r.endswith("-of") and r not in NOT_INVERSE and t in nodes else (s, r, t) for s, r, t in triples]
    return Graph(top, triples)


def variables(triples: list[tuple[str, str, str | None]]) -> dict[str, str | None]:
    """Variable to concept, in the order of definition."""
    return {s: t for s, r, t in triples if r == INSTANCE}


def _inverse(role: str) -> str:
    return role[:-3] if role.endswith("-of") and role not in NOT_INVERSE else role + "-of"


def encode(triples: list[tuple[str, str, str | None]], top: str | None = None, indent: int | None = 6) -> str:
    """Text of the triples, depth first from the top (the first source unless given); edges against the walk get -of.

    ``indent`` None writes one line. Raises DecodeError if some triple cannot be reached from the top.
    """
    if not triples:
        raise DecodeError("no triples")
    top = top if top is not None else triples[0][0]
    concepts = variables(triples)
    if top not in concepts:
        raise DecodeError("the top has no concept")
    out_of: dict[str, list[int]] = {}
    into: dict[str, list[int]] = {}
    for k, (s, r, t) in enumerate(triples):
        if r != INSTANCE:
            out_of.setdefault(s, []).append(k)
            if t in concepts and t != s:
                into.setdefault(t, []).append(k)
    used: set[int] = set()
    seen: set[str] = set()
    parts: list[str] = []

    def open_node(v: str) -> None:
        c = concepts[v]
        parts.append(f"({v}" + (f" / {c}" if c is not None else " /"))
        seen.add(v)

    def edges(v: str):
        return iter(sorted(out_of.get(v, []) + into.get(v, [])))

    open_node(top)
    walk = [(top, edges(top))]
    while walk:
        v, it = walk[-1]
        for k in it:
            if k in used:
                continue
            used.add(k)
            s, r, t = triples[k]
            other, name = (t, r) if s == v else (s, _inverse(r))
            parts.append(" " if indent is None else "\n" + " " * (indent * len(walk)))
            parts.append(name + " ")
            if other in concepts and other not in seen:
                open_node(other)
                walk.append((other, edges(other)))
                break
            parts.append("" if other is None else other)
        else:
            parts.append(")")
            walk.pop()
    if len(seen) != len(concepts) or len(used) != sum(r != INSTANCE for _, r, _ in triples):
        raise DecodeError("the graph is not connected")
    return "".join(parts)
