"""Canonical forms of sentences and graphs, as text, for hashing. Pure Python and Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.penman import LITERAL

#: Blanks, punctuation and the ASCII signs that count as punctuation in plain text.
NOISE = r"[\s\p{Z}\p{P}$+<=>^`|~]+"
WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(rf'\)|\(\s*([^\s()"/]+)\s*/\s*({LITERAL}|[^\s()"/]+)?|(:[^\s()"/]+)|({LITERAL}|[^\s()"/]+)', re.S)
_BLANK = re.compile(r"\s+")


def plain_sentence(c: Column) -> Column:
    """The sentence without blanks and punctuation, in lower case; null stays null."""
    return F.regexp_replace(F.lower(c), NOISE, "")


def canonical_graph(text: str | None, rename: bool = False) -> str:
    """Text equal for two graphs iff they differ only in blanks, letter case and the order of a node's relations.

    ``rename``: names of variables do not count either. The relations of a node are sorted by their own canonical text;
    with ``rename`` variables are then numbered in the sorted order. Text that is no bracketed graph is only lower-cased
    and stripped of blanks; null gives an empty text. Linear in the text but for the sorting, no recursion.
    """
    if not text:
        return ""
    low = text.lower()
    tokens = _TOKEN.findall(low)
    flat = _BLANK.sub("", low)
    if not tokens or low.lstrip()[:1] != "(":
        return flat
    concept_of = {v: c for v, c, _, _ in tokens if v} if rename else {}
    reentrant = False
    stack: list[tuple[str, str, list]] = []
    role = ""
    root = None
    for var, concept, r, atom in tokens:
        if var:
            stack.append((role, var, [concept]))
            role = ""
        elif r:
            role = r
        elif atom:
            if not stack:
                return flat
            if atom in concept_of:
                reentrant = True
                stack[-1][2].append((f"{role} *{concept_of[atom]}", role, atom, None))
            else:
                a = _BLANK.sub("", atom)
                stack[-1][2].append((f"{role} {a}", role, a, None))
            role = ""
        else:
            if not stack:
                return flat
            own, var, parts = stack.pop()
            concept, kids = parts[0], parts[1:]
            kids.sort(key=lambda k: k[0])
            head = concept if rename else f"{var}/{concept}"
            s = f"({head}{''.join(k[0] for k in kids)})"
            if stack:
                stack[-1][2].append((f"{own} {s}", own, var, (concept, kids)))
            elif root is not None:
                return flat
            else:
                root = (s, var, (concept, kids))
    if stack or root is None:
        return flat
    if not reentrant:
        return root[0]
    number: dict[str, int] = {}
    out: list[str] = []
    todo: list = [("", root[1], root[2])]
    later: list[tuple[int, str]] = []
    while todo:
        item = todo.pop()
        if item is None:
            out.append(")")
            continue
        own, var, node = item
        if node is None:
            out.append(own + " ")
            if var in concept_of:
                later.append((len(out), var))
            out.append(var)
        else:
            number.setdefault(var, len(number))
            out.append(f"{own}({number[var]}/{node[0]}")
            todo.append(None)
            todo.extend((k[1], k[2], k[3]) for k in reversed(node[1]))
    for k, var in later:
        out[k] = f"*{number.get(var, -1)}"
    return "".join(out)
