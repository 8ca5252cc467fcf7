"""Queries of corpus preparation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import prepare
from ..session import table
from .base import PREPARED, SPLIT, normalised, squeezed, unwrapped, words

N_LANGS = 4
QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _deduplicated(spark: SparkSession, d: str, *carry: str) -> DataFrame:
    rows = unwrapped(normalised(spark, d)).withColumn("chars", F.length("s"))
    return prepare.first_of_sentence_values(rows, *carry)


@_query(f"WITH {PREPARED} SELECT split, count(*)::bigint AS n, sum(length(s))::bigint AS chars FROM s2 GROUP BY split")
def prep_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: blanks, texts in punctuation, repeated sentences, sizes."""
    return _deduplicated(spark, d, "split", "chars").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").cast("long").alias("chars"))


@_query(f"SELECT row_id, md5({squeezed('sentence')}) AS hash, length({squeezed('sentence')})::bigint AS chars, {words('sentence')}::bigint AS words FROM prepare_dataset WHERE sentence IS NOT NULL")
def prep_normalize_ws(spark: SparkSession, d: str) -> DataFrame:
    t = X.collapse_blanks(F.col("sentence"))
    return table(spark, d, "prepare_dataset").filter("sentence is not null").select("row_id", F.md5(t).alias("hash"), F.length(t).cast("long").alias("chars"), X.word_count(F.col("sentence")).alias("words"))


@_query(f"WITH {PREPARED} SELECT row_id FROM s1")
def prep_bracket_filter(spark: SparkSession, d: str) -> DataFrame:
    return unwrapped(normalised(spark, d)).select("row_id")


@_query(f"WITH {PREPARED} SELECT row_id, split FROM s2")
def prep_dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return _deduplicated(spark, d, "row_id", "split")


@_query(f"WITH {PREPARED} SELECT a.split, a.n::bigint AS n_before, coalesce(b.n, 0)::bigint AS n_after, (a.n - coalesce(b.n, 0))::bigint AS dropped FROM (SELECT split, count(*) AS n FROM s1 GROUP BY 1) a LEFT JOIN (SELECT split, count(*) AS n FROM s2 GROUP BY 1) b USING (split)")
def prep_drop_count(spark: SparkSession, d: str) -> DataFrame:
    before = unwrapped(normalised(spark, d)).groupBy("split").agg(F.count(F.lit(1)).alias("n_before"))
    after = _deduplicated(spark, d, "split").groupBy("split").agg(F.count(F.lit(1)).alias("k"))
    n = F.coalesce("k", F.lit(0))
    return before.join(after, "split", "left").select("split", "n_before", n.alias("n_after"), (F.col("n_before") - n).alias("dropped"))


_DEALT = f"dealt AS (SELECT row_id, id, split, ((row_number() OVER (PARTITION BY split ORDER BY length(penmanstr), row_id) - 1) % {N_LANGS})::int AS assigned FROM s0 WHERE src_lang_idx = 0)"


@_query(f"WITH {PREPARED}, {_DEALT} SELECT row_id, split, assigned FROM dealt")
def prep_stratified_lang(spark: SparkSession, d: str) -> DataFrame:
    return prepare.assigned_languages(normalised(spark, d), N_LANGS).select("row_id", "split", "assigned")


@_query(f"WITH {PREPARED}, {_DEALT} SELECT split, assigned, count(*)::bigint AS n FROM dealt GROUP BY ALL")
def prep_lang_counts(spark: SparkSession, d: str) -> DataFrame:
    return prepare.assigned_languages(normalised(spark, d), N_LANGS).groupBy("split", "assigned").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {PREPARED}, {_DEALT} SELECT s0.row_id, s0.split, s0.src_lang_idx FROM s0 JOIN (SELECT id, split, arg_min(assigned, row_id) AS assigned FROM dealt GROUP BY ALL) USING (id, split) WHERE src_lang_idx = assigned")
def prep_rows_of_assigned(spark: SparkSession, d: str) -> DataFrame:
    return prepare.rows_of_assigned(normalised(spark, d), N_LANGS).select("row_id", "split", "src_lang_idx")


@_query(f"WITH {PREPARED} SELECT DISTINCT split, id FROM s2")
def prep_kept_ids(spark: SparkSession, d: str) -> DataFrame:
    return _deduplicated(spark, d, "split", "id").distinct()


@_query(f"SELECT {SPLIT} AS split, split_type, count(*)::bigint AS n FROM prepare_dataset GROUP BY ALL")
def split_name_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "prepare_dataset").groupBy(X.split_name(F.col("split_type")).alias("split"), "split_type").agg(F.count(F.lit(1)).alias("n"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split(X.next_line_to_space(F.col("text")), "\n")).alias("line_no", "line"))


_LINES = "lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, (generate_subscripts(string_split(t, chr(10)), 1) - 1)::int AS line_no FROM (SELECT doc_id, replace(text, chr(133), ' ') AS t FROM documents WHERE text IS NOT NULL))"


@_query(f"WITH {_LINES} SELECT doc_id, line_no, md5(line) AS hash FROM lines")
def nel_fix_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "line_no", F.md5("line").alias("hash"))


@_query(f"WITH {_LINES} SELECT doc_id, md5(string_agg(CASE WHEN starts_with(line, '# ::snt ') THEN {squeezed('line')} ELSE line END, chr(10) ORDER BY line_no)) AS hash, count_if(starts_with(line, '# ::snt '))::bigint AS rewritten FROM lines GROUP BY doc_id")
def snt_line_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Within one array a document: nothing is exploded or shuffled."""
    lines = F.split(X.next_line_to_space(F.col("text")), "\n")
    new = F.transform(lines, lambda x: F.when(x.startswith("# ::snt "), X.collapse_blanks(x)).otherwise(x))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(F.array_join(new, "\n")).alias("hash"), F.size(F.filter(lines, lambda x: x.startswith("# ::snt "))).cast("long").alias("rewritten"))


@_query(f"WITH {_LINES} SELECT len, count(*)::bigint AS n FROM (SELECT {words('line')}::bigint AS len FROM lines WHERE starts_with(line, '# ::snt ')) GROUP BY len")
def len_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Words of the sentence lines, their key included."""
    return _lines(spark, d).filter(F.col("line").startswith("# ::snt ")).groupBy(X.word_count(F.col("line")).alias("len")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT doc_id, md5(replace(text, '–', '-')) AS hash, (length(text) - length(replace(text, '–', '')))::bigint AS dashes FROM documents WHERE text IS NOT NULL")
def dash_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(X.dash_to_hyphen(t)).alias("hash"), (F.length(t) - F.length(F.translate(t, "–", ""))).cast("long").alias("dashes"))


@_query("SELECT row_id, metadata['id'] AS meta_id, metadata['snt'] IS NOT DISTINCT FROM snt AS same_snt, id || '__' || row_id AS uid FROM prepare_dataset")
def meta_uid(spark: SparkSession, d: str) -> DataFrame:
    meta = F.col("metadata")
    return table(spark, d, "prepare_dataset").select("row_id", F.element_at(meta, "id").alias("meta_id"), F.element_at(meta, "snt").eqNullSafe(F.col("snt")).alias("same_snt"), F.concat("id", F.lit("__"), "row_id").alias("uid"))


@_query()
def fix_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "prepare_dataset").select("row_id", X.fix_text(F.col("sentence")).alias("sentence"))


def _with_lang(spark: SparkSession, d: str) -> DataFrame:
    langs = table(spark, d, "langs").select("src_lang_idx", "lang")
    return table(spark, d, "prepare_dataset").join(langs, "src_lang_idx", "left")


@_query()
def punct_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _with_lang(spark, d).select("row_id", X.normalize_punctuation(F.col("sentence"), F.col("lang")).alias("sentence"))


@_query()
def detokenize(spark: SparkSession, d: str) -> DataFrame:
    return _with_lang(spark, d).select("row_id", X.detokenize(F.col("sentence"), F.col("lang")).alias("sentence"))


