"""Text functions as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns

#: ASCII punctuation, as a regular expression's character class.
PUNCT = r"!-/:-@\[-`{-~"
SPLITS = ("train", "validation", "test")
#: Places of the splits in scan order.
SPLIT_ORDER = {s: i for i, s in enumerate(SPLITS)}


def collapse_blanks(c: Column) -> Column:
    """Blanks of any kind at the ends go, others become one space."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def word_count(c: Column) -> Column:
    """Words between blanks; 0 for an empty text, null for null."""
    t = collapse_blanks(c)
    return F.when(c.isNull(), None).when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def dash_to_hyphen(c: Column) -> Column:
    return F.translate(c, "–", "-")


def next_line_to_space(c: Column) -> Column:
    return F.translate(c, "\x85", " ")


def split_name(c: Column, strict: bool = False) -> Column:
    """train, validation or test of a split's names; others give null, or an error where ``strict``."""
    known = F.when(c.isin("train", "training"), "train").when(c.isin("validation", "dev"), "validation").when(c == "test", "test")
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown split "), c)).cast("string")) if strict else known


def split_place(c: Column) -> Column:
    out = F.lit(len(SPLITS))
    for s, i in SPLIT_ORDER.items():
        out = F.when(c == s, i).otherwise(out)
    return out


def punct_wrapped(c: Column) -> Column:
    """Whether a text begins and ends with ASCII punctuation."""
    return c.rlike(rf"^[{PUNCT}]") & c.rlike(rf"[{PUNCT}]\z")


def is_number(c: Column) -> Column:
    """A decimal number; texts such as inf and nan are none."""
    return c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z")


def is_url(c: Column) -> Column:
    """Is a web address: scheme optional, a dotted host (or localhost, or four numbers), port and path optional."""
    return c.rlike("(?i)" + patterns.URL)


def is_email(c: Column) -> Column:
    """Begins with a mail address."""
    return c.rlike("(?i)" + patterns.EMAIL)


def is_filename(c: Column) -> Column:
    """Ends like a file name."""
    return c.rlike("(?i)" + patterns.FILENAME)


def token_class(c: Column) -> Column:
    """Class of a token of a graph's text: CONST, I, VAR, MODE, EDGE, a bracket or slash, or INST."""
    odd = r"[,:/().!?\\]"
    return (
        F.when(c == "i", "I")
        .when(c.rlike(r"^[a-z]\d*\z"), "VAR")
        .when(c.rlike(r"^\d") | c.rlike(r'(?s)^".*"\z') | (c == '"') | c.isin("+", "-"), "CONST")
        .when(c == ":mode", "MODE")
        .when(c.startswith(":"), "EDGE")
        .when(c.isin("/", "(", ")"), c)
        .when(c.rlike(r"^\p{L}") & ~c.rlike(odd), "INST")
        .otherwise("CONST")
    )


def balance_quote(c: Column) -> Column:
    """A token with a quotation mark at one end only gets the other."""
    return F.when(c.startswith('"') & (~c.endswith('"') | (F.length(c) == 1)), F.concat(c, F.lit('"'))).when(c.endswith('"') & ~c.startswith('"'), F.concat(F.lit('"'), c)).otherwise(c)


#: Rules of punctuation: pattern and what it becomes, in order. Own subset of the usual corpus normalisation.
PUNCT_RULES = (
    (r"\r", ""),
    (r"[‘’‚‛`´]", "'"),
    (r"''", '"'),
    (r"[“”„‟]", '"'),
    (r"\s?…", "..."),
    (r" +", " "),
    (r"\( ", "("),
    (r" \)", ")"),
    (r"(\d) %", "$1%"),
    (r" ([:;?!])", "$1"),
)
#: Quotation marks of languages in which a comma or stop stands inside, or that use angles.
ANGLES = (r"[«»]", '"')


def normalize_punctuation(c: Column, lang: Column) -> Column:
    """Punctuation in one ASCII form; angle quotation marks too, except in languages that write them (fr, it)."""
    out = c
    for pattern, new in PUNCT_RULES:
        out = F.regexp_replace(out, pattern, new)
    out = F.when(F.coalesce(lang, F.lit("")).isin("fr", "it"), out).otherwise(F.regexp_replace(out, *ANGLES))
    # in English and German a quotation mark stands after the stop it ends with
    return F.when(lang == "en", F.regexp_replace(out, r'"([,.]+)', r'$1"')).otherwise(out)


def detokenize(c: Column, lang: Column) -> Column:
    """Blanks around punctuation as in running text; elisions of languages with an apostrophe are joined."""
    out = collapse_blanks(c)
    for pattern, new in ((r" ([.,;:!?%)\]}…]+)", "$1"), (r"([(\[{¿¡]) ", "$1"), (r" (['’](?:s|m|d|ll|re|ve|t)\b)", "$1"), (r" n't\b", "n't"), (r'(^| )" ([^"]*?) "', '$1"$2"'), (r"« ", "«"), (r" »", "»"), (r"“ ", "“"), (r" ”", "”")):
        out = F.regexp_replace(out, pattern, new)
    return F.when(F.coalesce(lang, F.lit("")).isin("fr", "it", "ca"), F.regexp_replace(out, r"(\p{L}['’]) (\p{L})", "$1$2")).otherwise(out)


def fix_text(c: Column) -> Column:
    """Entities of HTML, curly quotation marks, control characters and line ends in their plain form.

    Text read through a wrong code page needs a model of its corpus and is not mended here.
    """
    out = c
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(F.regexp_replace(out, r"\r\n?|\x{2028}|\x{2029}|\x85", "\n"), r"[\x00-\x08\x0b\x0e-\x1f\x7f\x{FEFF}]", "")
    return F.translate(out, "‘’‚‛“”„‟", "''''\"\"\"\"")


def model_length(family: Column, reported: Column) -> Column:
    """The longest input of a model family: what it reports, but for families that report no real bound."""
    cap = F.when(F.lower(family) == "bloom", 2048).when(F.lower(family).isin("mbart", "t5", "bart", "nllb"), 1024)
    return F.when((reported > 2048) & cap.isNotNull(), cap).otherwise(reported)


def task_prefix(family: Column, lang_name: Column, text: Column) -> Column:
    """Families that are told their task in words get it before the text."""
    return F.when(F.lower(family).isin("t5", "bloom"), F.concat(F.lit("translate "), lang_name, F.lit(" to <AMR>: "), text)).otherwise(text)


def prefixed(token: Column, prefix: str) -> Column:
    """Tokens get the prefix of words, but for those that begin with _ or -."""
    return F.when(token.startswith("_") | token.startswith("-"), token).otherwise(F.concat(F.lit(prefix), token))


def components(token: Column) -> Column:
    """Phrases whose mean stands for an added token: by its form, and by name for a few."""
    special = {
        "</rel>": [" )"], "<rel>": [" ("], "<lit>": ['"', ' "', " quote"], "</lit>": ['"', ' "', " quote"], "-of": [" of"],
        "amr-unknown": ["?", " who", " what", " why", " where", " when"], "amr-choice": [" or"],
        ":quant": [" relation", " quantity"], ":li": [" relation", " list", " enumeration"], ":ord": [" 1", " 2", " 3", " 4", " 5", " 6"],
        ":year2": [" year"], ":prep-": [" by", " in", " near", " on", " at", " with"], ":conj-as-if": [" as-if", " as if"], ":negation": [" no", " not"],
    }  # fixed values of the reference
    parts = F.split(F.regexp_replace(token, "^:+", ""), "-")
    spaced = F.transform(parts, lambda p: F.concat(F.lit(" "), p))
    number = F.element_at(parts, -1)
    framed = F.when((F.size(parts) > 1) & number.rlike(r"^\d+\z"), F.concat(F.slice(spaced, 1, F.size(spaced) - 1), F.array(F.concat(F.lit(" "), number.cast("int").cast("string"))))).otherwise(spaced)
    out = F.when(token.startswith(":"), F.concat(F.array(F.lit(" relation")), spaced)).otherwise(framed)
    out = F.when(token.rlike(r"^<pointer:\d+>\z"), F.array(F.lit(" pointer"), F.concat(F.lit(" "), F.regexp_extract(token, r"(\d+)", 1).cast("int").cast("string")))).otherwise(out)
    for t, phrases in special.items():
        out = F.when(token == t, F.array(*map(F.lit, phrases))).otherwise(out)
    return F.filter(out, lambda p: F.trim(p) != "")
