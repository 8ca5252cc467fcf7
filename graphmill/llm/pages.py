"""Code pages: their byte tables, and what a run of characters may have been before it was read through one of them."""

from __future__ import annotations

import re
from encodings.aliases import aliases
from functools import lru_cache

LOST = "\ufffd"
#: Most characters of a run whose readings are remembered.
SHORT = 64
_RUN = re.compile("[^\x00-\x7f]+")
_UTF8 = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3})+")


def _upper_half(codec: str) -> str | None:
    """The characters of bytes 128 to 255, U+FFFD for undefined ones; None for what is no single-byte page with ASCII."""
    high = bytes(range(128, 256))
    try:
        table = high.decode(codec, "replace")
        same = bytes(range(128)).decode(codec) == bytes(range(128)).decode("ascii")
        alone = "".join(bytes([b]).decode(codec, "replace") for b in high)
    except (LookupError, UnicodeError, AttributeError, TypeError):
        return None
    return table if same and table == alone and table.count(LOST) < 100 else None


@lru_cache(maxsize=1)
def _tables() -> dict[str, str]:
    """Every single-byte page that Python knows, one name for each table."""
    found: dict[str, str] = {}
    for codec in sorted(set(aliases.values())):
        table = _upper_half(codec)
        if table:
            found.setdefault(table, codec)
    return {codec: table for table, codec in found.items()}


PAGES = tuple(_tables())
DEPTHS = (1, 2)
CIPHERS = tuple((p, k) for k in DEPTHS for p in PAGES)
CLEAN = len(CIPHERS)
#: What a decoder of a single-byte page can write, beyond ASCII.
WRITTEN = frozenset("".join(_tables().values())) - {LOST}


class ByteTable(dict):
    """Character to byte (as a character below 256) of a code page, for str.translate(); other characters become no byte."""

    def __missing__(self, key: int) -> str:
        return "\uffff"


@lru_cache(maxsize=None)
def byte_table(page: str) -> ByteTable:
    """The table of a page; bytes the page leaves undefined stand for themselves, as in browsers."""
    table = ByteTable()
    for b, c in zip(range(128, 256), _tables()[page]):
        table.setdefault(ord(c) if c != LOST else b, chr(b))
    return table


@lru_cache(maxsize=1)
def usual_swaps() -> tuple[dict[str, str], ...]:
    """Character read to character written, of each two pages that differ: one written in, the other read through."""
    tables = list(_tables().values())
    pairs = ({r: w for w, r in zip(written, read) if w != r and LOST not in (w, r)} for written in tables for read in tables if written != read)
    return tuple(p for p in pairs if p)


def segments(run: str, page: str) -> list[tuple[int, int, str]]:
    """(start, end, plain) of the stretches of a run that are the UTF-8 bytes of something, read through this page."""
    return [(m.start(), m.end(), m[0].encode("latin-1").decode("utf-8")) for m in _UTF8.finditer(run.translate(byte_table(page)))]


def garble(text: str, page: str) -> str:
    """The cipher itself: UTF-8 read through a page, undefined bytes standing for themselves."""
    back = {ord(b): chr(c) for c, b in byte_table(page).items()}
    return "".join(c if ord(c) < 128 else "".join(back[b] for b in c.encode("utf-8")) for c in text)


def readings(run: str):
    """What _readings gives, remembered for runs of usual length."""
    return _remembered(run) if len(run) <= SHORT else _readings(run)


@lru_cache(maxsize=100_000)
def _remembered(run: str):
    return _readings(run)


def _readings(run: str) -> tuple[tuple[int, int, tuple[tuple[int, str], ...]], ...]:
    """(start, end, ((cipher, plain), ...)) of the suspicious segments of a run of non-ASCII characters.

    Segments of different ciphers that overlap are one; each cipher then gives what it makes of the whole segment.
    """
    spans: set[tuple[int, int]] = set()
    able = []
    for page in PAGES:
        own = segments(run, page)
        if own:
            able.append(page)
            spans.update((a, b) for a, b, _ in own)
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out = []
    for a, b in merged:
        plains = []
        for i, (page, depth) in enumerate(CIPHERS):
            if page not in able:
                continue
            text, changed = run[a:b], True
            for _ in range(depth):
                found = segments(text, page)
                changed = changed and bool(found)
                for s, e, z in reversed(found):
                    text = text[:s] + z + text[e:]
            if changed:
                plains.append((i, text))
        out.append((a, b, tuple(plains)))
    return tuple(out)
