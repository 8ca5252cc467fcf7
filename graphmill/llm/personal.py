"""Personal information inside free text: anchors, expanded and validated by local parsers, replaced by typed placeholders.

An Aho-Corasick automaton finds at-signs and their spellings, cues of identity numbers and phones and words of streets in
one pass over a text. From an anchor a parser walks to the boundaries of its mention and validates it; digits groups that
may be numbers of phones or persons are anchors too. After a cue any 8 to 15 digits with usual signs between are a phone
(no date, no round number, no amount of money); without a cue the usual groupings are, but no bare row of digits unless it
begins as a mobile number does. Of two cues before a number the nearer one counts. Names are found from their own words: those of the lexicon, and words that
the corpus uses as names, learned over all documents (a word is learned as given or family name if at least half of its
capitalised uses stand beside a known name word of the other kind). What is learned is sent as a bit set, sized by the number
of learned words so that less than one word in 100,000 that wasn't learned is taken for one, at any size of corpus.
Accounts (IBAN, cards) are validated by their check digits; user names before a host in an address with a scheme are no email.

Null and empty texts hold no mention. Repeated texts are searched each for itself. Mentions never overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bits import PART, bit_set

KINDS = ("name", "email", "phone", "id_number", "address")
GIVEN, FAMILY = 1, 2
#: Bits of the set of learned name words for each word and kind, and bits set for each.
PER_WORD, HASHES = 40, 6
#: Most bits that are sent (256 MB, 50 million words); more is an error, never a fuller set.
MOST_BITS = 1 << 31
#: Characters on each side of a street's word in which its address is looked for; longer ones are none.
AROUND = 240
#: Most rows of a lexicon that is sent as it is; beyond, it belongs into the learned set.
MOST = 100_000

# --- fixed values: words and forms -------------------------------------------------------------------------------------
AT = ("@", "[at]", "(at)", "{at}", "<at>", " at ", "[AT]", "(AT)", " AT ", "[ at ]", "( at )", " arroba ")
STREETS_EN = ("Street", "St", "Road", "Rd", "Lane", "Ln", "Avenue", "Ave", "Terrace", "Ter", "Drive", "Dr", "Court", "Ct", "Place", "Pl", "Square", "Sq", "Close", "Crescent", "Boulevard", "Blvd", "Highway", "Hwy", "Parkway", "Row", "Way", "Walk", "Gardens", "Grove", "Mews", "Alley", "Circle")
STREETS_ES = ("Calle", "C/", "Avda", "Avenida", "Av", "Plaza", "Pza", "Camino", "Paseo", "Ronda", "Travesía", "Carretera", "Glorieta", "Callejón", "Rambla")
STREETS_NL_DE = ("straat", "laan", "weg", "gracht", "plein", "kade", "dijk", "singel", "steeg", "pad", "hof", "straße", "strasse", "str.", "gasse", "allee", "platz", "ufer", "ring", "damm", "chaussee", "markt")
QUALIFIERS = "Oude|Nieuwe|Grote|Kleine|Lange|Korte|Hoge|Lage|Noorder|Zuider|Ooster|Wester|Alte|Neue|Große|Kurze|Hohe|Obere|Untere|Am|Im|An der|Auf der|Zum|Zur"
ID_CUES = ("social security", "Social Security", "SSN", "identity no", "identity number", "identity card", "Identity no", "national number", "National number", "national id", "national insurance", "National Insurance", "passport", "Passport", "ID number", "ID card", "id number", "tax number", "tax id", "documento de identidad", "Documento de identidad", "DNI", "NIE", "pasaporte", "Pasaporte", "seguridad social", "burgerservicenummer", "Burgerservicenummer", "BSN", "paspoort", "identiteits", "Ausweis", "ausweis", "Reisepass", "Sozialversicherung", "Steuer-ID", "Steueridentifikation", "Personalnummer")
#: Cues of phones in English, Spanish, Dutch and German. Stems may stand inside a longer word, the others are whole words; after a weak one the number must look like a phone's.
PHONE_STEMS = ("phone", "telefon", "telefoon", "teléfon", "rufnummer", "faxnumm", "durchwahl", "festnetz", "whatsapp", "handynummer", "mobielnummer", "mobilnummer")
PHONE_WORDS = ("tel", "telf", "tlf", "tfno", "tfn", "téléphone", "fax", "gsm", "handy", "móvil", "movil", "mobiel", "mobil", "fijo", "landline", "hotline", "helpline")
PHONE_WEAK = ("mobile", "mob", "cell", "call", "ring", "text", "sms", "dial", "bel", "bellen", "belt", "llame", "llamar", "llama", "llámame", "marque", "anrufen", "anruf", "ruf", "rufen", "erreichbar", "bereikbaar")
#: Particles between given and family name.
PARTICLES = "van|Van|von|Von|de|De|del|Del|der|Der|den|Den|des|la|La|las|los|ter|Ter|ten|Ten|te|zu|zum|zur|di|da|dos|du|le"
# ------------------------------------------------------------------------------------------------------------------------

#: Capital letters of the Latin script, by rule.
_UP = "A-Z" + "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isupper())
_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+-])?\Z")
_DOT = r"(?:\.|\s?\[\s?(?:dot|DOT|punto|punt|punkt)\s?\]\s?|\s?\(\s?(?:dot|DOT|punto|punt|punkt)\s?\)\s?|\s(?:dot|DOT)\s)"
_DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_SCHEME = re.compile(r"[a-zA-Z][\w+.-]*://[^\s/@<>]*\Z")
_IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?:[ ]?[A-Z\d]{4}){2,7}(?:[ ]?[A-Z\d]{1,4})?(?![\w-])")
_CARD = re.compile(r"(?<![\w.,+/-])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}([ -]?)\d{6}\2\d{5})(?![\w/])(?![-.,]\d)")
_SPELLED = re.compile(r"dot|punto|punt|punkt", re.I)
_AFTER_DOMAIN = re.compile(r"\s?(?:@|\[at\]|\(at\)|_)", re.I)
_MARKED = re.compile(r"[0-9._+-]")
_MAIL_CUE = re.compile(r"(?:\b(?:e-?mail|correo es|(?:mail|address) is|to|naar|unter|contact|at)\s|[:(]\s?)\Z", re.I)

_PHONE = r"""\+\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]?\(\d{1,5}\))?(?:[ .-]?\d{2,13}){1,6}
    | \(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,5}
    | \d{3}[-.]\d{3}[-.]\d{4}
    | 0\d{4}[ ]\d{6}
    | 0\d{1,3}[-/]\d{6,8}
    | 0\d{2,4}[ ]\d{3}[ ]\d{3,4}
    | 00\d{9,13}"""
_ID = r"""\d{3}-\d{2}-\d{4}
    | \d{5}\.\d{2}\.\d{2}
    | \d{6}-\d{4}
    | \d{8}[A-Z]
    | [A-Z]{2}\d{7}
    | [A-Z]\d[A-Z]{2}\d{5}
    | [A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]"""
_NUMBER = re.compile(rf"(?<![\w+/#])(?<!\d[.,-])(?:(?P<id_number>{_ID})|(?P<phone>{_PHONE}))(?![\w/])(?![-.,]\d)", re.X)
_LABELLED = re.compile(r"[A-Z]{0,3}[ ]?\d(?:[A-Z\d]|[ ./-](?=[A-Z]{0,2}\d)){4,17}[A-Z]?(?![\w])")
_AFTER_CUE = re.compile(r"[^\n.!?;]{0,40}?(?:\bno\.|\bnr\.|n\.º)?[^\n.!?;\d]{0,25}?(?=\b[A-Z]{0,3}[ ]?\d)")

_SIGNS = "[ \u00a0]?[-‐‑–/][ \u00a0]?|[ \u00a0.]|[ \u00a0]?\\(|\\)[ \u00a0]?[-/]?[ \u00a0]?"
_DIALLED = re.compile(rf"\+?\(?\+?\d(?:(?:{_SIGNS})?\d){{7,}}(?!\w|[:.,-]\d)")
_TO_DIALLED = re.compile(r"\.?(?:[^\n.!?;\d+]|\b(?:no|nr|núm|num|n)\.){0,40}?:?[ \t\u00a0]*\n?[ \t\u00a0]*(?<![\w,.])(?=\(\+?\d{1,5}\)|\+?\(?\+?\d)")
_WIDE = re.compile(r"[ \u00a0][-‐‑–/][ \u00a0]|/")
#: Groupings of national numbers: trunk 0 and groups, mobile numbers in one piece, Spain, North America.
_NATIONAL = re.compile(
    r"""(?<![\w+/\#€$£])(?<!\d[.,:-])(?<!\d[ \u00a0])(?<![€$£][ \u00a0])(?:
      (?:\(0[1-9]\d{0,4}\)[ \u00a0]?|0[1-9]\d{0,4}(?:[ \u00a0]?[-/‐–][ \u00a0]?|[ \u00a0.]))\d{2,8}(?:[ \u00a0.-]\d{2,4}){0,4}
    | 06\d{8} | 07\d{9} | 01[5-7]\d{8,9}
    | [6-9]\d{2}([ \u00a0-])\d{3}\1\d{3} | [6-9]\d{2}(?:[ \u00a0-]\d{2}){3} | [89]\d[ \u00a0]\d{3}[ \u00a0]\d{2}[ \u00a0]\d{2}
    | (?:1[ -])?[2-9]\d{2}[ \u00a0-]\d{3}[ \u00a0-]\d{4}
    )(?![\w/])(?![-.,:]\d)(?![ \u00a0]\d)""",
    re.X,
)
_DATE = re.compile(r"(?:\d{1,2}([./ -])\d{1,2}\1(?:1[5-9]|20)\d\d|(?:1[5-9]|20)\d\d([./ -])\d{1,2}\2\d{1,2})(?!\d)")
_ROUND = re.compile(r"\d{1,3}(?:[ \u00a0.]\d{3})*[ \u00a0.]000")
_MONEY = re.compile(r"[ \u00a0]?(?:[€$£%]|(?:EUR|USD|GBP|euros?|dollars?|pounds|percent|Prozent|procent|por ciento)\b)")

_EN = re.compile(rf"(?<![\w.,/-])\d{{1,5}}[A-Za-z]?[ \t]+(?:(?:[{_UP}][\w'’-]*|[NSEW]\.)[ \t]+){{1,4}}(?:{'|'.join(STREETS_EN)})\b\.?(?:,?[ \t]*(?:(?:Apt|Apartment|Flat|Unit|Suite|Room)\.?[ \t]*\w+|\#[ \t]?\w+))?")
_ES = re.compile(rf"(?:{'|'.join(map(re.escape, STREETS_ES))})\.?[ \t]+(?:(?:de|del|la|las|los|el)[ \t]+)*[{_UP}]\w*(?:[ \t]+(?:(?:de|del|la|las|los|el|y)[ \t]+)*[{_UP}]\w*){{0,4}},?[ \t]+(?:n\.?[ \t]?º[ \t]?|núm\.?[ \t]?|nº[ \t]?)?\d{{1,4}}\b(?:,?[ \t]*\d{{1,2}}\.?[ \t]?[ºª][ \t]*[A-Z]?\b)?")
_NL = re.compile(rf"(?:(?:{QUALIFIERS})[ \t]+)?(?<!\w)[{_UP}]\w*(?:[ -][{_UP}]\w*)?(?:{'|'.join(map(re.escape, STREETS_NL_DE))})[ \t]+\d{{1,4}}(?:[ \t]?bis\b|-[A-Z0-9]+\b|[ \t]?[a-z]\b|[A-Z]\b)?")
_CAP = re.compile(rf"(?<![\w@.+-])(?:[ODL]['’])?[{_UP}][^\W\d_]+(?:-[{_UP}][^\W\d_]+)*(?![\w@+])")
_SPACE = re.compile(rf"[ \t ]*\n?[ \t ]*(?:(?:[{_UP}]\.[ \t ]*){{1,3}}\n?[ \t ]*)?(?:(?:{PARTICLES})[ \t\u00a0]+){{0,3}}\Z")
_COMMA = re.compile(r",[ \t ]*\n?[ \t ]*\Z")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for words, kind in ((AT, "at"), (STREETS_EN, "en"), (STREETS_ES, "es"), (STREETS_NL_DE, "nl"), (ID_CUES, "cue")):
        for w in words:
            for form in ([" " + w] if kind == "en" else [w + " ", w + ". "] if kind == "es" else [w + " "] if kind == "nl" else [w]):
                a.add_word(form, (kind, len(form)))
    for words, kind in ((PHONE_STEMS, "stem"), (PHONE_WORDS, "word"), (PHONE_WEAK, "weak")):
        for w in words:
            for form in (w, w.capitalize(), w.upper()):
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def _email(text: str, a: int, b: int) -> tuple[int, int] | None:
    """The address around an at-sign in any spelling at text[a:b]."""
    sign = text[a:b]
    left, right = a, b
    word = sign.strip().lower() in ("at", "arroba")
    if not word:
        if left and text[left - 1] in " \t" and left > 1:
            left -= 1
        if right < len(text) and text[right] in " \t":
            right += 1
    begin = left
    while begin and left - begin < 64 and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
        begin -= 1
    local = _LOCAL.search(text[begin:left])
    domain = _DOMAIN.match(text, right)
    if not local or not domain:
        return None
    begin += local.start()
    if _SCHEME.search(text, max(0, begin - 300), begin):
        return None
    labels = re.split(_DOT, domain[0])
    end = domain.end()
    if len(labels[-1]) < 2 or not labels[-1].isalpha() or _AFTER_DOMAIN.match(text, end):
        return None
    # a sentence may begin right after an address: "a@b.test.The" ends before the capitalised word
    if word and not _SPELLED.search(domain[0]) and not _MARKED.search(local[0]) and not _MAIL_CUE.search(text, max(0, begin - 16), begin):
        return None
    return begin, end


def _labelled(text: str, at: int) -> tuple[int, int] | None:
    """The identity number after a cue that ends at this place."""
    gap = _AFTER_CUE.match(text, at)
    m = gap and _LABELLED.match(text, gap.end())
    if m and sum(c.isdigit() for c in m[0]) >= 6 and not _NUMBER.fullmatch(m[0]):
        return m.start(), m.end()
    return None


def _shaped(text: str, a: int, b: int) -> bool:
    """Whether digits at text[a:b] may be a phone's by their number, and are no date, round number or amount."""
    number = text[a:b]
    return 8 <= sum(c.isdigit() for c in number) <= 15 and not _DATE.match(number) and not _ROUND.fullmatch(number) and not _MONEY.match(text, b) and text[:a].rstrip(" \u00a0")[-1:] not in ("€", "$", "£")


def _dialled(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The phone after a cue at text[a:b]; of several numbers parted by a stroke the first."""
    if kind != "stem":
        if a and text[a - 1].isalnum() or b < len(text) and text[b].isalpha():
            return None
    else:
        while b < len(text) and text[b].isalpha():
            b += 1
    gap = _TO_DIALLED.match(text, b, min(len(text), b + 60))
    m = gap and _DIALLED.match(text, gap.end(), min(len(text), gap.end() + 60))
    if not m:
        return None
    start, end = m.span()
    if sum(c.isdigit() for c in m[0]) > 15:
        ends = [w.start() + start for w in _WIDE.finditer(m[0])]
        end = max((e for e in ends if _shaped(text, start, e)), default=end)
    if not _shaped(text, start, end) or _NUMBER.fullmatch(text, start, end):
        return None
    if kind == "weak" and text[start] not in "0(+" and sum(c.isdigit() for c in text[start:end]) < 9:
        return None
    return start, end


def _account(text: str) -> list[tuple[int, int]]:
    """Accounts in international form and cards whose check digits are right; groups of an account after its right end are dropped."""
    out = []
    for m in _IBAN.finditer(text):
        end = m.end()
        while end - m.start() >= 15:
            plain = text[m.start() : end].replace(" ", "")
            if len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                out.append((m.start(), end))
                break
            end = text.rfind(" ", m.start(), end)
    for m in _CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if any(digits) and (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0:
            out.append(m.span())
    return out


class Names:
    """Kinds of name words: lexicon, and a bit set of learned words."""

    def __init__(self, lexicon: dict[str, int], bits: bytes = b"") -> None:
        self.lexicon, self.bits, self.memo = lexicon, bits, {}

    def __getstate__(self):
        return {"lexicon": self.lexicon, "bits": self.bits, "memo": {}}

    def kind(self, word: str) -> int:
        k = self.memo.get(word)
        if k is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            parts = word.lower().split("-")
            k = 0
            for p in parts:
                k |= self.lexicon.get(p, 0) if len(parts) == 1 else self.lexicon.get(p, 0) & FAMILY
                if self.bits:
                    k |= (GIVEN if len(parts) == 1 and _has(self.bits, p, GIVEN) else 0) | (FAMILY if _has(self.bits, p, FAMILY) else 0)
            self.memo[word] = k
        return k


def _positions(word: str, kind: int, size: int) -> list[int]:
    return [xxhash.xxh3_64_intdigest(f"{kind}:{word}", seed=i) % size for i in range(HASHES)]


def _has(bits: bytes, word: str, kind: int) -> bool:
    return all(bits[p >> 3] >> (p & 7) & 1 for p in _positions(word, kind, 8 * len(bits)))


def _words(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0]) for m in _CAP.finditer(text)]


def _gap(text: str, a: int, b: int) -> str:
    """How two words stand to each other: s (blank, initials between), c (comma) or nothing."""
    if b - a > 30 or b <= a:
        return ""
    g = text[a:b]
    return "s" if _SPACE.match(g) else "c" if _COMMA.match(g) else ""


def name_spans(text: str, names: Names) -> list[tuple[int, int]]:
    words = _words(text)
    kinds = [names.kind(w) for _, _, w in words]
    out = []
    i, n = 0, len(words)
    while i < n - 1:
        k = kinds[i]
        if k and kinds[i + 1]:
            gap = _gap(text, words[i][1], words[i + 1][0])
            if k & GIVEN and gap == "s" and kinds[i + 1] & FAMILY:
                out.append((words[i][0], words[i + 1][1]))
                i += 2
                continue
            if k & FAMILY and gap and kinds[i + 1] & GIVEN and not (i + 2 < n and kinds[i + 2] & FAMILY and _gap(text, words[i + 1][1], words[i + 2][0]) == "s"):
                out.append((words[i][0], words[i + 1][1]))
                i += 2
                continue
        i += 1
    return out


def mentions(text: str | None, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the mentions, in order, without overlap; emails come before numbers, addresses and names."""
    if not text:
        return []
    found: list[tuple[int, int, str, float]] = []
    for last, (kind, length) in _automaton().iter(text):
        a, b = last - length + 1, last + 1
        if kind == "at":
            e = _email(text, a, b)
            if e:
                found.append((*e, "email", 0))
        elif kind == "cue":
            e = _labelled(text, b)
            if e:
                found.append((*e, "id_number", 2 + (e[0] - b) / 1000))  # the nearest cue first
        elif kind in ("stem", "word", "weak"):
            e = _dialled(text, a, b, kind)
            if e:
                found.append((*e, "phone", 2 + (e[0] - b) / 1000))
        else:
            low = max(text.rfind("\n", max(0, a - AROUND), a) + 1, a - AROUND, 0)
            pattern = {"en": _EN, "es": _ES, "nl": _NL}[kind]
            for m in pattern.finditer(text, low if kind != "es" else a, min(len(text), b + AROUND)):
                if m.start() <= a + 1 and m.end() >= b - 2:
                    found.append((m.start(), m.end(), "address", 4))
    found += [(a, b, "id_number", 0.5) for a, b in _account(text)]
    for m in _NUMBER.finditer(text):
        kind = m.lastgroup
        if kind == "phone" and not 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            continue
        found.append((m.start(), m.end(), kind, 1))
    for m in _NATIONAL.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 13 and _shaped(text, *m.span()):
            found.append((*m.span(), "phone", 3))
    found += [(a, b, "name", 5) for a, b in name_spans(text, names)]
    found.sort(key=lambda x: (x[3], x[0], -x[1]))
    taken: list[tuple[int, int, str]] = []  # in order, without overlap
    for a, b, kind, _ in found:
        i = bisect_left(taken, (a,))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
            taken.insert(i, (a, b, kind))
    return taken


def redact(text: str | None, names: Names) -> str | None:
    for a, b, kind in reversed(mentions(text, names)):
        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
    return text


def _use(names: Names):
    """Of one task: each capitalised word's uses, and its uses beside a name word of the other kind."""

    def run(batches):
        total, given, family = Counter(), Counter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                words = _words(text)
                kinds = [names.kind(w) for _, _, w in words]
                n = len(words)
                total.update(w.lower() for _, _, w in words)
                for i, k in enumerate(kinds):
                    if not k:
                        continue
                    after = _gap(text, words[i][1], words[i + 1][0]) if i + 1 < n else ""
                    before = _gap(text, words[i - 1][1], words[i][0]) if i else ""
                    if k & GIVEN and after == "s":
                        family[words[i + 1][2].lower()] += 1
                    elif k & GIVEN and before == "c":
                        family[words[i - 1][2].lower()] += 1
                    if k & FAMILY and before == "s":
                        given[words[i - 1][2].lower()] += 1
                    elif k & FAMILY and after == "c":
                        given[words[i + 1][2].lower()] += 1
        # a word that is nowhere beside a name here may be so in another task, so all leave the task, once each
        rows = [(w, n, given[w], family[w]) for w, n in total.items()]
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["w", "n", "g", "f"])

    return run


def lexicon_of(lexicon: DataFrame) -> dict[str, int]:
    out: dict[str, int] = {}
    rows = lexicon.filter("token is not null").select("token", "kind").distinct().limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"the lexicon holds more than {MOST} words")
    for token, kind in rows:
        out[token.lower()] = out.get(token.lower(), 0) | (GIVEN if kind == "given" else FAMILY if kind == "family" else 0)
    return out


def learn_names(docs: DataFrame, lexicon: DataFrame, text_col: str = "text") -> Names:
    """The lexicon, widened over all documents."""
    names = Names(lexicon_of(lexicon))
    uses = docs.select(docs[text_col].alias("text")).mapInArrow(_use(names), "w string, n long, g long, f long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("f").alias("f"))

    learned = cut(uses.filter("2 * g >= n or 2 * f >= n").select("w", (F.col("g") * 2 >= F.col("n")).alias("given"), (F.col("f") * 2 >= F.col("n")).alias("family")))
    # parts of a double family name are learned each
    n = int(learned.agg(F.sum(F.col("given").cast("long") + F.when(F.col("family"), F.size(F.split("w", "-"))).otherwise(0))).first()[0] or 0)
    size = PART
    while size < PER_WORD * n:
        size *= 2
    if size > MOST_BITS:
        raise ValueError(f"{n} learned name words are more than can be sent")

    def places(batches):
        for b in batches:
            out = []
            for w, given, family in zip(*(c.to_pylist() for c in b.columns)):
                if given:
                    out += _positions(w, GIVEN, size)
                for p in w.split("-") if family else ():
                    out += _positions(p, FAMILY, size)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set(out)), pa.int64())], ["p"])

    names.bits = bit_set(learned.mapInArrow(places, "p long"), size)
    return names


def find_mentions(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kind, start_pos, end_pos of every mention; positions count code points from 0."""
    sent = docs.sparkSession.sparkContext.broadcast(learn_names(docs, lexicon, text_col))

    def run(batches):
        for b in batches:
            rows = [(i, kind, s, e) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s, e, kind in mentions(t, sent.value)]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "kind", "start_pos", "end_pos"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, kind string, start_pos long, end_pos long")


def redacted(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its text with placeholders; null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(learn_names(docs, lexicon, text_col))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([redact(t, sent.value) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, text string")
