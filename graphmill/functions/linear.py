"""Graphs as sequences of tokens and back: linearisation, text of token sequences, tokens by vocabulary. Pure Python."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

from . import patterns
from .penman import LITERAL

_TORN = re.compile(r"[()/]|:?[^\s()/:]+|:")
_ATOM = re.compile(rf'{LITERAL}|[()/]|[^\s()"/]+|\S', re.S)
POINTER = re.compile(r"<pointer:\d+>")
_ADDRESSES = [re.compile(p, re.I) for p in (patterns.URL, patterns.EMAIL, patterns.FILENAME)]


def is_address(text: str) -> bool:
    """Whether a text begins like a web or mail address or ends like a file name."""
    return any(p.match(text) for p in _ADDRESSES)


def linearize(text: str, tear_literals: bool = False) -> list[str]:
    """Tokens of a graph's text in its own order.

    A variable becomes ``<pointer:k>``, k by the order of definitions, in its definition (whose slash goes) and where a
    role points at it; ``:polarity -`` becomes ``:negation``; an en dash a hyphen. A literal is one token, unless
    ``tear_literals``: then its blanks, brackets and slashes split it as they split other text.
    """
    raw = _ATOM.findall(text.replace("–", "-"))
    if tear_literals:
        raw = [p for t in raw for p in (_TORN.findall(t) if t[0] == '"' and re.search(r"\s", t) else [t])]
    names: dict[str, str] = {}
    for name, slash in zip(raw, raw[1:]):
        if slash == "/":
            names[name] = f"<pointer:{len(names)}>" if name not in names else names[name]
    out: list[str] = []
    i, n = 0, len(raw)
    while i < n:
        t = raw[i]
        before = out[-1] if out else ""
        if t in names and before == "(" and i + 1 < n and raw[i + 1] == "/":
            out.append(names[t])
            i += 1
        elif t in names and before[:1] == ":":
            out.append(names[t])
        elif t == "-" and before == ":polarity":
            out[-1] = ":negation"
        else:
            out.append(t)
        i += 1
    return out


def split_except_quotes(text: str) -> list[str]:
    """Tokens between blanks; a quoted stretch and a tag in angles are one token each. An open quotation runs to the end."""
    return [t for t in re.findall(r'(?:[^\s"<]+)?"[^"]*"?|<[^>]*>?|[^\s<"]+', text) if t.strip()]


def tagged(text: str, vocabulary: Collection[str]) -> str:
    """A linear text in the tags of models: literals in <lit>, brackets as <rel>; no blank before tags and known tokens.

    Underscores in literals become blanks, unless the literal is an address or file name. A known token after
    ``:quant`` keeps its blank, so a number never grows onto the role.
    """
    out: list[str] = []
    for part in re.split(r'("[^"]*")', text):
        if part[:1] == '"' and part[-1:] == '"' and len(part) > 1:
            inner = part[1:-1]
            out.append(f" <lit> {inner if is_address(inner) else inner.replace('_', ' ')}</lit> ")
        else:
            out.append(part.replace("(", " <rel> ").replace(")", " </rel> "))
    flat = " ".join("".join(out).split()).replace(" </lit>", "</lit>")
    known = sorted(vocabulary, key=len, reverse=True)
    tag = r"</?(?:pointer|rel|lit|AMR)"
    return re.sub(rf"(?<!:quant) ({tag}|{'|'.join(map(re.escape, known))})" if known else rf" ({tag})", r"\1", flat)


_PIECE = re.compile(r"<lit>(.*?)(?:</lit>|$)|(</?rel>|<pointer:\d+>)|(:[A-Za-z][A-Za-z0-9-]*)|([^\s<:]+|[<:])", re.S)


def _literal(content: str, role: str, before: str) -> str:
    name = role.lstrip(":")
    content = content.strip()
    if name.startswith(("wiki", "op", "value")):
        if before != "phone-number-entity":
            content = re.sub(r"(?<=\d)\s+(?=\d)", "", content)
            content = re.sub(r"\s+-\s*(?=\d)", "-", content)
        if name.startswith("value"):
            joined = content.replace(" ", "")
            return joined if is_address(joined) else content
        content = re.sub(r"(?<=\d)\s+(?=[A-Z]+(?![a-z]))", "", content)
        return re.sub(r"(?<=\d)\s+\)", ")", content).replace(" ", "_")
    return content


def delinearize(text: str, roles: Collection[str] = ()) -> str:
    """Linear text with brackets and quotation marks from a decoded token sequence in tags.

    The text is read piece by piece: words after a pointer are one concept, however a tokenizer split it; digits after a
    role are its argument, or part of the role where a bracket or literal follows; ``-of`` goes back to its role; digits
    that belong to a known role's argument are set off from it, the longest known role first.
    """
    known = sorted(roles, key=len, reverse=True)
    text = text.replace(":negation", ":polarity - ")
    out: list[str] = []
    words: list[str] = []
    role, owner = "", ""

    def flush(follows: str) -> None:
        nonlocal role
        if not words:
            return
        if owner == "pointer":
            out.append("".join(words))
        elif owner == "role":
            if words[-1] == "-of" and follows == "<rel>":
                words.pop()
                out[-1] += "-of"
            if words and words[0] and re.fullmatch(r"\d+", "".join(words)) and follows in ("<rel>", "<lit>") and out:
                out[-1] += "".join(words)
                role = out[-1]
            elif words and out and out[-1] in (":prep-", ":conj-"):
                out[-1] += words[0]
                out.extend(words[1:])
            elif words and all(re.fullmatch(r"-?\d+\.?\d*", w) for w in words[:1]) and all(re.fullmatch(r"\d+", w) for w in words[1:]):
                out.append("".join(words))
            else:
                glued: list[str] = []
                for w in words:
                    if glued and w in ("-quantity", "-entity"):
                        glued[-1] += w
                    else:
                        glued.append(w)
                out.extend(glued)
        else:
            out.extend(words)
        words.clear()

    for m in _PIECE.finditer(text):
        literal, tag, name, word = m.groups()
        if literal is not None:
            before = out[-2] if len(out) > 1 else ""
            flush("<lit>")
            out.append(f'"{_literal(literal, role, before)}"')
            owner = ""
        elif tag:
            flush(tag)
            out.append({"<rel>": "(", "</rel>": ")"}.get(tag, tag))
            owner = "pointer" if tag.startswith("<pointer") else ""
            if owner:
                role = ""
        elif name:
            flush(name)
            stem = next((r for r in known if name.startswith(r) and re.fullmatch(r"-?\d+", name[len(r) :])), None)
            if stem and name not in roles:
                out += [stem, name[len(stem) :]]
                role, owner = stem, ""
            else:
                out.append(name)
                role, owner = name, "role"
        else:
            words.append(word)
    flush("")
    return " ".join(" ".join(out).split())


def vocabulary_tokens(tokens: list[str], vocabulary: Collection[str], subwords: Callable[[str], list[str]], prefix: str = "") -> list[str]:
    """Model tokens of linear tokens: those in the vocabulary whole (words first with the prefix), others in known parts.

    A literal stands between <lit> and </lit>, its underscores as blanks; brackets become <rel>; a frame falls into stem
    and sense, an inverse role into role and -of, ``:prep-x`` into ``:prep-`` and x; the rest goes to ``subwords``.
    """
    out: list[str] = []
    for t in tokens:
        if len(t) > 1 and t[0] == t[-1] == '"':
            out += ["<lit>", *subwords(t[1:-1].replace("_", " ")), "</lit>"]
        elif t in "()":
            out.append("<rel>" if t == "(" else "</rel>")
        elif t[0] == ":" and len(t) > 1:
            stem, dash, rest = t.partition("-")
            if t in vocabulary:
                out.append(t)
            elif t.endswith("-of"):
                out += [t[:-3], "-of"] if t[:-3] in vocabulary else [":", *subwords(t[1:-3]), "-of"]
            elif dash and stem + dash in vocabulary:
                out += [stem + dash, *subwords(rest)]
            else:
                out += [":", *subwords(t[1:])]
        elif re.fullmatch(r".+-\d\d", t) and t not in vocabulary:
            out += [*subwords(t[:-3]), t[-3:]]
        elif t[0] == "<" and t[-1] == ">" and t in vocabulary:
            out.append(t)
        elif prefix + t in vocabulary:
            out.append(prefix + t)
        elif t in vocabulary:
            out.append(t)
        else:
            out += subwords(t)
    return out
