"""Queries on tokens, vocabularies, lengths and arrays, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import patterns
from ..functions import text as X
from ..session import table
from .base import SPLIT, words

QUERIES, SQL = {}, {}
MIN_FREQ = 5
PAD, SPECIALS = 0, [0, 1, 2]


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "prepare_dataset").withColumn("split", X.split_name(F.col("split_type")))


# --- tokens --------------------------------------------------------------------------------------------------------------
def _sql(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


@_query(rf"""
SELECT regexp_matches(t, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') AS is_number, regexp_matches(t, {_sql(patterns.URL)}) AS is_url,
  regexp_matches(t, {_sql(patterns.EMAIL)}) AS is_email, regexp_matches(t, {_sql(patterns.FILENAME)}) AS is_filename, count(*)::bigint AS n
FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS t FROM documents WHERE text IS NOT NULL) GROUP BY ALL""")
def token_forms(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, web and mail addresses and file names among the tokens of documents."""
    t = F.col("t")
    tokens = table(spark, d, "documents").filter("text is not null").select(F.explode(F.split(F.translate("text", "\n", " "), " ")).alias("t"))
    return tokens.groupBy(X.is_number(t).alias("is_number"), X.is_url(t).alias("is_url"), X.is_email(t).alias("is_email"), X.is_filename(t).alias("is_filename")).agg(F.count(F.lit(1)).alias("n"))


_GRAPH_TOKEN = r'"[^"]*"|[()/]|[^\s()"/]+'
_GRAPH_TOKENS = f"(SELECT unnest(regexp_extract_all(penmanstr, '{_GRAPH_TOKEN}')) AS t FROM prepare_dataset)"


def _graph_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "prepare_dataset").select(F.explode(F.regexp_extract_all("penmanstr", F.lit(_GRAPH_TOKEN), F.lit(0))).alias("t"))


@_query(rf"""
SELECT CASE WHEN t = 'i' THEN 'I' WHEN regexp_matches(t, '^[a-z]\d*$') THEN 'VAR'
  WHEN regexp_matches(t, '^\d') OR (starts_with(t, '"') AND ends_with(t, '"')) OR t IN ('+', '-') THEN 'CONST'
  WHEN t = ':mode' THEN 'MODE' WHEN starts_with(t, ':') THEN 'EDGE' WHEN t IN ('/', '(', ')') THEN t
  WHEN regexp_matches(t, '^\pL') AND NOT regexp_matches(t, '[,:/().!?\\]') THEN 'INST' ELSE 'CONST' END AS class, count(*)::bigint AS n
FROM {_GRAPH_TOKENS} GROUP BY ALL""")
def token_classify(spark: SparkSession, d: str) -> DataFrame:
    return _graph_tokens(spark, d).groupBy(X.token_class(F.col("t")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@_query(rf"""SELECT CASE WHEN starts_with(t, '"') AND (NOT ends_with(t, '"') OR length(t) = 1) THEN t || '"' WHEN ends_with(t, '"') AND NOT starts_with(t, '"') THEN '"' || t ELSE t END AS token, count(*)::bigint AS n
FROM (SELECT unnest(string_split(replace(penmanstr, chr(10), ' '), ' ')) AS t FROM prepare_dataset) WHERE contains(t, '"') GROUP BY ALL""")
def quote_balance(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "prepare_dataset").select(F.explode(F.split(F.translate("penmanstr", "\n", " "), " ")).alias("t")).filter(F.col("t").contains('"'))
    return tokens.groupBy(X.balance_quote(F.col("t")).alias("token")).agg(F.count(F.lit(1)).alias("n"))


# --- vocabularies --------------------------------------------------------------------------------------------------------
_WORD = r"[\p{L}\p{N}]+"
_WORDS = f"(SELECT {SPLIT} AS split, row_id, unnest(regexp_extract_all(lower(sentence), '{_WORD}')) AS token FROM prepare_dataset)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).select("split", "row_id", F.explode(F.regexp_extract_all(F.lower("sentence"), F.lit(_WORD), F.lit(0))).alias("token"))


def _frequent(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).filter("split = 'train'").groupBy("token").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= MIN_FREQ)


_FREQUENT = f"frequent AS (SELECT token, count(*)::bigint AS freq FROM {_WORDS} WHERE split = 'train' GROUP BY token HAVING count(*) >= {MIN_FREQ})"


@_query(f"WITH {_FREQUENT} SELECT token, freq FROM frequent")
def vocab_frequent(spark: SparkSession, d: str) -> DataFrame:
    return _frequent(spark, d)


@_query(f"SELECT DISTINCT token FROM {_WORDS} WHERE split = 'test' AND token NOT IN (SELECT token FROM {_WORDS} WHERE split = 'train')")
def vocab_difference(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d)
    return w.filter("split = 'test'").select("token").distinct().join(w.filter("split = 'train'").select("token").distinct(), "token", "left_anti")


@_query(f'''SELECT token, CASE WHEN starts_with(token, '_') OR starts_with(token, '-') THEN token ELSE 'Ġ' || token END AS prefixed, count(*)::bigint AS n FROM (SELECT t AS token FROM {_GRAPH_TOKENS} WHERE NOT starts_with(t, '"')) GROUP BY ALL''')
def vocab_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _graph_tokens(spark, d).filter(~F.col("t").startswith('"')).groupBy(F.col("t").alias("token"), X.prefixed(F.col("t"), "Ġ").alias("prefixed")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_FREQUENT} SELECT w.split, count(*)::bigint AS tokens, count(f.token)::bigint AS known FROM {_WORDS} w LEFT JOIN frequent f USING (token) WHERE w.split IS NOT NULL GROUP BY 1")
def vocab_membership(spark: SparkSession, d: str) -> DataFrame:
    """Words are counted by split and token before they meet the vocabulary: the join sees each once."""
    counts = _words(spark, d).filter("split is not null").groupBy("split", "token").agg(F.count(F.lit(1)).alias("k"))
    known = _frequent(spark, d).select("token", F.lit(True).alias("in"))
    return counts.join(known, "token", "left").groupBy("split").agg(F.sum("k").alias("tokens"), F.coalesce(F.sum(F.when(F.col("in"), F.col("k"))), F.lit(0)).alias("known"))


@_query(f"SELECT token, count_if(split = 'train')::bigint AS n_train, count_if(split = 'test')::bigint AS n_test FROM {_WORDS} GROUP BY token")
def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).groupBy("token").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))


_ROLE_TOKENS = rf"(SELECT DISTINCT t AS token FROM {_GRAPH_TOKENS} WHERE regexp_matches(t, '^(:[A-Za-z]|[a-z]+-\d\d$)'))"


@_query(f"""
SELECT token, CASE token WHEN ':quant' THEN ' relation| quantity' WHEN ':li' THEN ' relation| list| enumeration' WHEN ':ord' THEN ' 1| 2| 3| 4| 5| 6'
  WHEN ':year2' THEN ' year' WHEN ':negation' THEN ' no| not' ELSE
  CASE WHEN starts_with(token, ':') THEN ' relation| ' || replace(regexp_replace(token, '^:+', ''), '-', '| ')
  ELSE ' ' || regexp_replace(replace(token, '-', '| '), '\\| 0*(\\d+)$', '| \\1') END END AS components
FROM {_ROLE_TOKENS}""")
def smart_init_components(spark: SparkSession, d: str) -> DataFrame:
    tokens = _graph_tokens(spark, d).filter(F.col("t").rlike(r"^(:[A-Za-z]|[a-z]+-\d\d\z)")).select(F.col("t").alias("token")).distinct()
    return tokens.select("token", F.array_join(X.components(F.col("token")), "|").alias("components"))


# --- lengths -------------------------------------------------------------------------------------------------------------
_LENGTHS = f"(SELECT {SPLIT} AS split, {words('sentence')}::bigint AS sent, {words('penmanstr')}::bigint AS label FROM prepare_dataset WHERE sentence IS NOT NULL)"
MOST = 64


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d).filter("sentence is not null and split is not null")
    return rows.select("split", X.word_count(F.col("sentence")).alias("sent"), X.word_count(F.col("penmanstr")).alias("label"))


@_query(f"SELECT split, count(*)::bigint AS n, max(sent)::bigint AS max_sent, max(label)::bigint AS max_label, count_if(sent > {MOST})::bigint AS over_sent, count_if(label > {MOST})::bigint AS over_label FROM {_LENGTHS} WHERE split IS NOT NULL GROUP BY split")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max("sent").alias("max_sent"), F.max("label").alias("max_label"), F.count_if(F.col("sent") > MOST).alias("over_sent"), F.count_if(F.col("label") > MOST).alias("over_label"))


@_query(f"SELECT split, sent AS len, count(*)::bigint AS n FROM {_LENGTHS} WHERE split IS NOT NULL GROUP BY ALL")
def length_counts(spark: SparkSession, d: str) -> DataFrame:
    """The sorted list of lengths, run-length coded: as large as the lengths that occur, not as the rows."""
    return _lengths(spark, d).groupBy("split", F.col("sent").alias("len")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT split, max(sent)::bigint AS longest, round(quantile_cont(sent, 0.95), 6) AS p95, round(quantile_cont(sent, 0.99), 6) AS p99 FROM {_LENGTHS} WHERE split IS NOT NULL GROUP BY split")
def len_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact, with linear interpolation, from counts of lengths."""
    counts = length_counts(spark, d)
    q = F.percentile("len", F.array(F.lit(0.95), F.lit(0.99)), F.col("n"))
    return counts.groupBy("split").agg(F.max("len").alias("longest"), q.alias("q")).select("split", "longest", F.round(F.col("q")[0], 6).alias("p95"), F.round(F.col("q")[1], 6).alias("p99"))


@_query("SELECT family, reported, (CASE WHEN reported > 2048 THEN CASE family WHEN 'bloom' THEN 2048 WHEN 'mbart' THEN 1024 WHEN 't5' THEN 1024 WHEN 'bart' THEN 1024 ELSE reported END ELSE reported END)::bigint AS length FROM (SELECT unnest(['bloom', 'mbart', 't5', 'bart', 'other']) AS family), (SELECT unnest([512::bigint, 2048, 1000000]) AS reported)")
def model_lengths(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.createDataFrame([(f, r) for f in ("bloom", "mbart", "t5", "bart", "other") for r in (512, 2048, 1_000_000)], "family string, reported bigint")
    return grid.select("family", "reported", X.model_length(F.col("family"), F.col("reported")).cast("long").alias("length"))


# --- arrays: lengths of words stand for token ids ------------------------------------------------------------------------
_IDS = f"(SELECT row_id, coalesce(src_lang_idx, -1) AS lang, list_transform(regexp_extract_all(sentence, '{_WORD}'), lambda w: length(w)::int) AS ids FROM prepare_dataset WHERE sentence IS NOT NULL)"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "prepare_dataset").filter("sentence is not null")
    return rows.select("row_id", F.coalesce("src_lang_idx", F.lit(-1)).alias("lang"), F.transform(F.regexp_extract_all("sentence", F.lit(_WORD), F.lit(0)), F.length).alias("ids"))


def _joined(c) -> F.Column:
    return F.array_join(c.cast("array<string>"), ",")


@_query(f"SELECT row_id, array_to_string(ids[1 : 14], ',') AS short FROM {_IDS}")
def truncate(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select("row_id", _joined(A.truncated(F.col("ids"), 16, 2)).alias("short"))


@_query(f"SELECT row_id, array_to_string(ids[1 : len(ids) - 1], ',') AS inputs, array_to_string(ids[2 :], ',') AS labels FROM {_IDS}")
def shift_labels(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select("row_id", _joined(A.without_last(F.col("ids"))).alias("inputs"), _joined(A.without_first(F.col("ids"))).alias("labels"))


@_query(f"SELECT row_id, array_to_string(list_filter(ids, lambda x: x NOT IN (0, 1, 2)), ',') AS ids, array_to_string(list_transform(ids, lambda x: CASE WHEN x = 2 THEN -100 ELSE x END), ',') AS masked FROM {_IDS}")
def remove_special(spark: SparkSession, d: str) -> DataFrame:
    ids = F.col("ids")
    return _ids(spark, d).select("row_id", _joined(A.without_special(ids, SPECIALS)).alias("ids"), _joined(A.replaced(ids, 2, A.IGNORED)).alias("masked"))


@_query(f"SELECT row_id, array_to_string(ids || list_transform(range((m - len(ids))::bigint), lambda x: 0), ',') AS padded FROM (SELECT *, max(len(ids)) OVER (PARTITION BY row_id // 32) AS m FROM {_IDS})")
def pad_batch(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 32 successive rows, padded to their longest: an aggregate a batch, joined back."""
    rows = _ids(spark, d).withColumn("b", F.expr("row_id div 32"))
    longest = rows.groupBy("b").agg(F.max(F.size("ids")).alias("m"))
    return rows.join(longest, "b").select("row_id", _joined(A.padded(F.col("ids"), F.col("m"), PAD)).alias("padded"))


@_query(f"SELECT row_id, array_to_string(list_transform(ids, lambda x: CASE x WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 30 ELSE 3 END), ',') AS mapped FROM {_IDS}")
def id_map(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select("row_id", _joined(A.mapped(F.col("ids"), {1: 10, 2: 20, 3: 30}, 3)).alias("mapped"))


@_query("""
SELECT p.lang, sum(len(list_filter(list_zip(p.ids, g.ids), lambda z: z[2] <> -100 AND z[1] = z[2])))::bigint AS equal, sum(len(list_filter(g.ids, lambda x: x <> -100)))::bigint AS counted
FROM (SELECT row_id, lang, ids FROM %s) p JOIN (SELECT row_id, list_transform(ids, lambda x: CASE WHEN x = 2 THEN -100 WHEN x > 7 THEN 7 ELSE x END) AS ids FROM %s) g USING (row_id) GROUP BY 1""" % (_IDS, _IDS))
def masked_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Places where a prediction (the ids) equals a label (long ones clipped, 2 ignored)."""
    labels = F.transform("ids", lambda x: F.when(x == 2, A.IGNORED).when(x > 7, 7).otherwise(x))
    equal, counted = A.matches(F.col("ids"), F.col("labels"))
    return _ids(spark, d).withColumn("labels", labels).groupBy("lang").agg(F.sum(equal).alias("equal"), F.sum(counted).alias("counted"))


@_query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::bigint AS best FROM embeddings")
def argmax(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", A.argmax(F.col("embedding")).alias("best"))


@_query("""
WITH x AS (SELECT label, unnest(embedding)::double AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings),
m AS (SELECT label, dim, avg(v) AS v FROM x GROUP BY ALL) SELECT (dim - 1)::int AS dim, round(avg(v), 6) AS v FROM m GROUP BY dim""")
def vector_mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    """The mean over components of the mean of each component's vectors."""
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return x.groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("v")).groupBy("dim").agg(F.round(F.avg("v"), 6).alias("v"))


@_query("SELECT row_id, 'translate ' || lang_name || ' to <AMR>: ' || sentence AS prompt FROM prepare_dataset JOIN langs USING (src_lang_idx)")
def task_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "prepare_dataset").join(table(spark, d, "langs"), "src_lang_idx")
    return rows.select("row_id", X.task_prefix(F.lit("t5"), F.col("lang_name"), F.col("sentence")).alias("prompt"))
