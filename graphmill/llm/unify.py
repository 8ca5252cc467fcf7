"""Visually identical text brought to one form, by DuckDB inside Arrow partitions.

Each Arrow batch is a table of an in-process DuckDB with one thread; embedded SQL maps it: invisible characters go
(regexp_replace), letters that only look Latin become Latin in words otherwise Latin (translate, word by word),
compatibility forms become the usual ones (translate; a join where one becomes several), accents are composed
(nfc_normalize), blanks become the space. Precomposed accents, dashes, quotation marks and words wholly in another script
stay as they are. The tables of compatibility forms come from the Unicode data of Python by rule; it holds no table of
look-alikes, so these are given for six scripts. A letter of another script that looks like no Latin one stays, and its
field is reported all the same.

Null stays null; texts of any length are mapped whole; only fields that hold something to map go through the mapping.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .garble import Model, garbled_fields

# fixed values: letters of other scripts that look like Latin letters
CYRILLIC = dict(zip("аеорсухіјѕԁһӏԛԝкґвАВЕКМНОРСТХУІЈЅԌԚԜҺӀ", "aeopcyxijsdhlqwkrbABEKMHOPCTXYIJSGQWHI"))
GREEK = dict(zip("αονιρκυτχηωγσεϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "aovipkutxnwyoecjABEZHIKMNOPTYXC"))
ARMENIAN = dict(zip("օոսհցգզյաքՕՍՏԼ", "onuhgqqjwpOUSL"))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiyAJEWMHGZRWSVSLCPKdGB"))
LISU = dict(zip("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU"))
COPTIC = dict(zip("ⲀⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥⲭ", "ABHIKMNOPCTYXopcx"))
LOOK = {**CYRILLIC, **GREEK, **ARMENIAN, **CHEROKEE, **LISU, **COPTIC}
INVISIBLE = r"\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{0000}-\x{0008}\x{000E}-\x{001B}\x{007F}-\x{0084}\x{0086}-\x{009F}"
BLANK = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
OTHER = r"\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{Coptic}\p{Lisu}\p{Georgian}\p{Hebrew}\p{Arabic}\p{Devanagari}\p{Hangul}\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}"
WORD = r"[\p{L}\p{M}\p{N}]+"


def _exempt(c: str) -> bool:
    """Dashes, quotation marks and what is a blank or invisible have rules of their own."""
    return unicodedata.category(c) in ("Pd", "Pi", "Pf", "Zs", "Cf", "Zl", "Zp", "Cc", "Cs", "Co", "Cn") or c in "ㅤﾠ"


@lru_cache(maxsize=1)
def compatibility() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility forms that become one character, and those that become several, by Unicode's own decomposition."""
    one, many = {}, {}
    for cp in range(0x80, 0x110000):
        c = chr(cp)
        if 0xAC00 <= cp <= 0xD7A3 or _exempt(c):
            continue
        k = unicodedata.normalize("NFKC", c)
        if k != unicodedata.normalize("NFC", c):
            (one if len(k) == 1 else many)[c] = k
    return one, many


def _class(chars) -> str:
    """A character class of RE2 for a set of characters."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{b:X}}}" if b > a else "") for a, b in out)


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(maxsize=1)
def _sql() -> tuple[str, str]:
    """(the rows that hold something to map, the mapped rows), over a table t(row_id, field, s)."""
    one, many = compatibility()
    compat = _class([*one, *many])
    foreign = _class([chr(c) for c in range(0x370, 0x590) if chr(c).isalpha() and chr(c) not in LOOK])
    mixed = f"""(regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(w, '[{OTHER}]')
      AND (NOT regexp_matches(w, '[{foreign}]') OR length(regexp_replace(w, '[^\\p{{Latin}}]', '', 'g')) >= length(regexp_replace(w, '[^{OTHER}]', '', 'g'))))"""
    suspect = f"""SELECT row_id, field, s FROM t WHERE s IS NOT NULL AND regexp_matches(s, '[^\\x00-\\x7F]|[\\x00-\\x08\\x0E-\\x1B\\x7F]') AND (
      regexp_matches(s, '[{compat}{INVISIBLE}{BLANK}]') OR nfc_normalize(s) <> s OR regexp_matches(s, '\\pL[\\x{{0300}}-\\x{{036F}}]')
      OR (regexp_matches(s, '[{OTHER}]') AND len(list_filter(regexp_extract_all(s, '{WORD}'), lambda w: {mixed})) > 0))"""
    look = f"translate(w, {_text(''.join(LOOK))}, {_text(''.join(LOOK.values()))})"
    mapped = f"""WITH hit AS ({suspect}),
    seen AS (SELECT row_id, field, regexp_replace(s, '[{INVISIBLE}]', '', 'g') AS s FROM hit),
    latin AS (SELECT row_id, field, CASE WHEN regexp_matches(s, '[{OTHER}]')
        THEN array_to_string(list_transform(regexp_extract_all(s, '{WORD}|[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: CASE WHEN {mixed} THEN {look} ELSE w END), '') ELSE s END AS s FROM seen),
    single AS (SELECT row_id, field, CASE WHEN regexp_matches(s, '[{_class(one)}]') THEN translate(s, {_text(''.join(one))}, {_text(''.join(one.values()))}) ELSE s END AS s FROM latin),
    spread AS (SELECT row_id, field, string_agg(coalesce(v, c), '' ORDER BY i) AS s
        FROM (SELECT row_id, field, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS i FROM single WHERE regexp_matches(s, '[{_class(many)}]'))
        LEFT JOIN several ON c = k GROUP BY row_id, field),
    whole AS (SELECT row_id, field, s FROM single WHERE NOT regexp_matches(s, '[{_class(many)}]') UNION ALL SELECT row_id, field, s FROM spread)
    SELECT row_id, field, regexp_replace(nfc_normalize(s), '[{BLANK}]', ' ', 'g') AS s FROM whole"""
    return suspect, mapped


def _connection():
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    _, many = compatibility()
    con.register("several_", pa.table({"k": list(many), "v": list(many.values())}))
    con.execute("CREATE TABLE several AS SELECT * FROM several_")
    return con


def _unify_sql(con, batch: pa.Table, what: int) -> pa.Table:
    con.register("t", batch)
    try:
        return con.sql(_sql()[what]).to_arrow_table()
    finally:
        con.unregister("t")


def unify(texts: list[str | None]) -> list[str | None]:
    """The mapping of single texts, on the driver; for tests and small lists."""
    out = _unify_sql(_connection(), pa.table({"row_id": pa.array(range(len(texts)), pa.int64()), "field": pa.array(["s"] * len(texts)), "s": pa.array(texts, pa.string())}), 1)
    new = dict(zip(out.column("row_id").to_pylist(), out.column("s").to_pylist()))
    return [new.get(i, t) for i, t in enumerate(texts)]


def _long(batch: pa.RecordBatch, fields: tuple[str, ...]) -> pa.Table:
    n = batch.num_rows
    ids = batch.column(0)
    return pa.concat_tables([pa.table({"row_id": ids, "field": pa.array([f] * n, pa.string()), "s": batch.column(1 + k).cast(pa.string())}) for k, f in enumerate(fields)])


def suspects(df: DataFrame, fields: tuple[str, ...] = ("sentence", "penmanstr"), id_col: str = "row_id") -> DataFrame:
    """row_id, field of each field that holds something to map."""

    def run(batches):
        con = _connection()
        for b in batches:
            out = _unify_sql(con, _long(b, fields), 0)
            yield from out.select(["row_id", "field"]).cast(pa.schema([("row_id", pa.int64()), ("field", pa.string())])).combine_chunks().to_batches()

    return df.select(df[id_col].cast("long").alias("row_id"), *(df[f].cast("string") for f in fields)).mapInArrow(run, "row_id long, field string")


def unified(df: DataFrame, fields: tuple[str, ...] = ("sentence", "penmanstr"), id_col: str = "row_id") -> DataFrame:
    """row_id and the fields, each in its one form."""

    def run(batches):
        con = _connection()
        for b in batches:
            out = _unify_sql(con, _long(b, fields), 1)
            new = dict(zip(zip(out.column("row_id").to_pylist(), out.column("field").to_pylist()), out.column("s").to_pylist()))
            ids = b.column(0).to_pylist()
            cols = [pa.array([new.get((i, f), v) for i, v in zip(ids, b.column(1 + k).to_pylist())], pa.string()) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["row_id", *fields])

    return df.select(df[id_col].cast("long").alias("row_id"), *(df[f].cast("string") for f in fields)).mapInArrow(run, "row_id long, " + ", ".join(f"`{f}` string" for f in fields))


def lookalike_fields(df: DataFrame, sources: DataFrame, model: Model | None = None) -> DataFrame:
    """row_id, field of the fields with look-alike text; garbled fields, whose odd characters have another cause, are left out."""
    garbled = garbled_fields(df, sources, model=model).select("row_id", "field")
    return suspects(df).join(garbled, ["row_id", "field"], "left_anti")
