"""Queries p2 to p10 by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, wide_table
from . import copies, garble, leaks, mixing, overlap, personal, related, tokens, unify


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return wide_table(spark, d, "prepare_dataset")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_links(copies.keyed(_samples(spark, d)))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(copies.keyed(_samples(spark, d))).select("keep_id", "copies", "collided")


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.deduplicated(_samples(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(_samples(spark, d))


def p4_containment(spark: SparkSession, d: str) -> DataFrame:
    return overlap.class_overlaps(_samples(spark, d))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_samples(spark, d), table(spark, d, "sources"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return related.torn(_samples(spark, d))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return related.assign_splits(_samples(spark, d))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return related.assign_splits(_samples(spark, d)).groupBy("new_split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group_id").alias("groups"))


def _token_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return *(wide_table(spark, d, t) for t in ("prepare_dataset", "documents")), table(spark, d, "langs"), table(spark, d, "sources")


def p3_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_budget(*_token_tables(spark, d))


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_rows(*_token_tables(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return unify.lookalike_fields(_samples(spark, d), table(spark, d, "sources"))


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    return unify.unified(_samples(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return garble.garbled_fields(_samples(spark, d), table(spark, d, "sources")).select("row_id", "field")


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return garble.garbled_fields(_samples(spark, d), table(spark, d, "sources"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(wide_table(spark, d, "documents"), table(spark, d, "test_items")).select("item_id", "doc_id")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(wide_table(spark, d, "documents"), table(spark, d, "test_items"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Passages with one word more, less or changed."""
    return leaks.leaks(wide_table(spark, d, "documents"), table(spark, d, "test_items"), edits=1)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(wide_table(spark, d, "documents"), table(spark, d, "sources"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(wide_table(spark, d, "documents"), table(spark, d, "sources"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find_mentions(wide_table(spark, d, "documents"), table(spark, d, "name_lexicon")).select("doc_id", "kind", "start_pos")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(wide_table(spark, d, "documents"), table(spark, d, "name_lexicon"))


_ALL = (p2_found, p2_groups, p2_records, p3_rows, p3_budget, p4_found, p4_containment, p4_report, p5_found, p5_splits, p5_shares, p6_found, p6_unified, p7_found, p7_restored, p8_found, p8_passages, p8_near, p9_mix, p9_shares, p10_found, p10_redacted)
QUERIES = {f.__name__: f for f in _ALL}

_NOBODY = ", ".join("'" + x.replace("'", "''") + "'" for x in related.NOBODY)
SQL = {
    "p5_found": f"""
WITH RECURSIVE own AS (
  SELECT row_id, regexp_replace(id, '\\.[^.]*$', '') AS d,
         trim(regexp_replace(lower(trim(metadata['author'])), '^@', '')) AS a,
         CASE WHEN lower(trim(split_type)) IN ('train', 'training') THEN 'train'
              WHEN lower(trim(split_type)) IN ('validation', 'dev') THEN 'validation' ELSE lower(trim(split_type)) END AS split
  FROM prepare_dataset),
docs AS (SELECT row_id, min(row_id) OVER (PARTITION BY d) AS doc, split, CASE WHEN a NOT IN ({_NOBODY}) THEN a END AS a FROM own),
edge AS (SELECT DISTINCT x.doc AS u, y.doc AS v FROM (SELECT DISTINCT doc, a FROM docs WHERE a IS NOT NULL) x JOIN (SELECT DISTINCT doc, a FROM docs WHERE a IS NOT NULL) y USING (a) WHERE x.doc <> y.doc),
reach(u, v) AS (SELECT DISTINCT doc, doc FROM docs UNION SELECT reach.u, edge.v FROM reach JOIN edge ON reach.v = edge.u),
root AS (SELECT u AS doc, min(v) AS group_id FROM reach GROUP BY u),
rows_ AS (SELECT group_id, row_id, split FROM docs JOIN root USING (doc))
SELECT group_id, row_id FROM rows_ WHERE group_id IN (SELECT group_id FROM rows_ GROUP BY 1 HAVING min(split) <> max(split))""",
    "p8_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM test_items),
dw AS (SELECT doc_id, array_to_string(w[k : k + 14], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS k FROM d)),
iw AS (SELECT item_id, array_to_string(w[k : k + 14], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 13)) AS k FROM i))
SELECT DISTINCT item_id, doc_id FROM dw JOIN iw USING (x)""",
    "p8_passages": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM test_items),
dw AS (SELECT doc_id, k, array_to_string(w[k : k + 14], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS k FROM d)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 14], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 13)) AS k FROM i))
SELECT item_id, doc_id, count(DISTINCT k) AS windows, min(k) - 1 AS first_word, max(k) + 14 AS end_word FROM dw JOIN iw USING (x) GROUP BY item_id, doc_id""",
}
