"""Queries on graphs, with SQL where counting in the text gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import graphs as G
from ..session import wide_table
from .base import BLANKS

QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BARE = f"regexp_replace(regexp_replace(penmanstr, '{BLANKS}', ' ', 'g'), '\"[^\"]*\"', '\"\"', 'g')"


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    return wide_table(spark, d, "prepare_dataset").select("row_id", G.decode_graph("penmanstr").alias("g"))


def _triples(spark: SparkSession, d: str) -> DataFrame:
    return G.triples_of(wide_table(spark, d, "prepare_dataset"), "row_id", "penmanstr")


@_query()
def penman_triples(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d)


@_query(rf"SELECT row_id, len(regexp_extract_all({_BARE}, '/'))::bigint AS nodes, len(regexp_extract_all({_BARE}, '(?:^|[\s()])(:[^\s()]+)'))::bigint AS edges FROM prepare_dataset")
def penman_counts(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter("g.triples", lambda t: t["role"] == ":instance"))
    return _decoded(spark, d).select("row_id", n.cast("long").alias("nodes"), (F.size("g.triples") - n).cast("long").alias("edges"))


@_query(rf"SELECT concept, count(*)::bigint AS n FROM (SELECT unnest(regexp_extract_all({_BARE}, '/\s*([^\s()]+)', 1)) AS concept FROM prepare_dataset) GROUP BY 1")
def penman_concepts(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d).filter("role = ':instance'").groupBy(F.col("target").alias("concept")).agg(F.count(F.lit(1)).alias("n"))


@_query(r"SELECT role, literal, count(*)::bigint AS n FROM (SELECT regexp_extract(x, '^(\S+)', 1) AS role, regexp_extract(x, '(\"[^\"]*\")$', 1) AS literal FROM (SELECT unnest(regexp_extract_all(penmanstr, ':[^\s()\"]+\s+\"[^\"]*\"')) AS x FROM prepare_dataset)) GROUP BY ALL")
def penman_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Roles with a literal."""
    return _triples(spark, d).filter(F.col("target").startswith('"')).groupBy("role", F.col("target").alias("literal")).agg(F.count(F.lit(1)).alias("n"))


@_query()
def penman_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between variables of one graph, by role and concepts; within each row's array, so nothing is joined."""
    g = _decoded(spark, d)
    concept = F.map_from_entries(F.array_distinct(F.transform(F.filter("g.triples", lambda t: t["role"] == ":instance"), lambda t: F.struct(t["source"], t["target"]))))
    own = g.filter("g.triples is not null").select(F.explode("g.triples").alias("t"), concept.alias("c")).filter("t.role <> ':instance'")
    edge = own.select("t.role", F.element_at("c", F.col("t.source")).alias("source"), F.element_at("c", F.col("t.target")).alias("target")).filter("target is not null")
    return edge.groupBy("role", "source", "target").agg(F.count(F.lit(1)).alias("n"))


@_query(r"SELECT target, count(*)::bigint AS n FROM (SELECT '+' AS target, unnest(regexp_extract_all(penmanstr, '(?i):wiki\s')) FROM prepare_dataset WHERE NOT contains(penmanstr, ':WIKI')) GROUP BY 1")
def wiki_rewrite(spark: SparkSession, d: str) -> DataFrame:
    t = _decoded(spark, d).select(F.explode(G.without_wiki(F.col("g.triples"))).alias("t")).filter("t.role = ':wiki'")
    return t.groupBy("t.target").agg(F.count(F.lit(1)).alias("n"))


@_query()
def wiki_free_graphs(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(spark, d).select("row_id", G.encode_graph(G.without_wiki(F.col("g.triples"))).alias("graph"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d).filter("role = ':instance'").select("row_id", "pos", F.col("source").alias("variable"), F.col("target").alias("concept"))


_NODES = rf"""n AS (SELECT row_id, regexp_extract(x, '^\(\s*([^\s/()]+)', 1) AS variable, regexp_extract(x, '/\s*([^\s()]+)$', 1) AS concept, k
FROM (SELECT row_id, unnest(regexp_extract_all({_BARE}, '\(\s*[^\s/()]+\s*/\s*[^\s()]+')) AS x, generate_subscripts(regexp_extract_all({_BARE}, '\(\s*[^\s/()]+\s*/\s*[^\s()]+'), 1) AS k FROM prepare_dataset))"""


@_query(f"WITH {_NODES}, u AS (SELECT row_id, variable, min(k) AS k FROM n GROUP BY ALL) SELECT row_id, variable, (row_number() OVER (PARTITION BY row_id ORDER BY k) - 1)::bigint AS pointer FROM u")
def pointer_numbering(spark: SparkSession, d: str) -> DataFrame:
    first = _nodes(spark, d).groupBy("row_id", "variable").agg(F.min("pos").alias("p"))
    return first.select("row_id", "variable", (F.row_number().over(Window.partitionBy("row_id").orderBy("p")) - 1).cast("long").alias("pointer"))


@_query(f"""WITH {_NODES}, m AS (SELECT row_id, k, lower(regexp_extract(concept, '(\\pL)', 1)) AS p FROM n), c AS (SELECT *, row_number() OVER (PARTITION BY row_id, p ORDER BY k) AS i FROM m)
SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY k) - 1)::bigint AS node, CASE WHEN p = '' THEN 'x' ELSE p END || CASE WHEN i > 1 THEN i::varchar ELSE '' END AS name FROM c""")
def varname_allocation(spark: SparkSession, d: str) -> DataFrame:
    """New names of variables: the concept's first letter, numbered from the second on; a graph is a few dozen nodes."""
    n = _nodes(spark, d).withColumn("p", F.lower(F.regexp_extract("concept", r"(\p{L})", 1)))
    i = F.row_number().over(Window.partitionBy("row_id", "p").orderBy("pos"))
    node = F.row_number().over(Window.partitionBy("row_id").orderBy("pos")) - 1
    n = n.withColumn("i", i)
    name = F.concat(F.when(F.col("p") == "", "x").otherwise(F.col("p")), F.when(F.col("i") > 1, F.col("i").cast("string")).otherwise(""))
    return n.select("row_id", node.cast("long").alias("node"), name.alias("name"))


@_query()
def linearize_tokens(spark: SparkSession, d: str) -> DataFrame:
    return wide_table(spark, d, "prepare_dataset").select("row_id", G.linear_tokens("penmanstr").alias("tokens"))


@_query(r"SELECT row_id, len(regexp_extract_all(penmanstr, ':polarity\s+-'))::bigint AS negations FROM prepare_dataset")
def negation_token(spark: SparkSession, d: str) -> DataFrame:
    t = wide_table(spark, d, "prepare_dataset").select("row_id", G.linear_tokens("penmanstr").alias("t"))
    return t.select("row_id", F.size(F.filter("t", lambda x: x == ":negation")).cast("long").alias("negations"))


@_query("SELECT 'ok' AS status, count(*)::bigint AS n, 0::bigint AS imperfect FROM prepare_dataset")
def roundtrip_failures(spark: SparkSession, d: str) -> DataFrame:
    """Graphs that do not come back from their own tokens with every triple; status and number."""
    t = wide_table(spark, d, "prepare_dataset").select("penmanstr", G.linear_tokens("penmanstr").alias("t"))
    back = t.select("penmanstr", G.decode_token_list("t").alias("b"))
    m = back.select("b.status", G.match_graphs(G.encode_graph("b.triples"), "penmanstr").alias("m"))
    whole = (F.col("m.matched") == F.col("m.n_gold")) & (F.col("m.matched") == F.col("m.n_pred"))
    return m.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(~whole).alias("imperfect"))


@_query()
def decode_status(spark: SparkSession, d: str) -> DataFrame:
    p = wide_table(spark, d, "predictions").select("system", G.decode_any("penman_str").alias("r"))
    return p.groupBy("system", "r.status").agg(F.count(F.lit(1)).alias("n"))


@_query()
def repair_graph(spark: SparkSession, d: str) -> DataFrame:
    p = wide_table(spark, d, "predictions").select("pred_id", G.decode_any("penman_str").alias("r"))
    return p.select("pred_id", "r.status", G.encode_graph("r.triples").alias("graph"))


@_query()
def delinearize(spark: SparkSession, d: str) -> DataFrame:
    """Graph text in tags and back."""
    line = F.array_join(G.linear_tokens("penmanstr"), " ")
    return wide_table(spark, d, "prepare_dataset").select("row_id", G.delinearized(G.literals_tagged(line)).alias("text"))


@_query("SELECT 1::bigint AS parts, count(*)::bigint AS n FROM prepare_dataset WHERE left(ltrim(penmanstr), 1) = '('")
def connected_parts(spark: SparkSession, d: str) -> DataFrame:
    """Graphs by the number of their parts, by least-label spreading within each row's arrays; no join at all."""
    g = _decoded(spark, d).filter("g.triples is not null")
    nodes = F.array_distinct(F.transform(F.filter("g.triples", lambda t: t["role"] == ":instance"), lambda t: t["source"]))
    edges = F.filter("g.triples", lambda t: (t["role"] != ":instance") & F.array_contains(F.col("nodes"), t["target"]))
    own = g.withColumn("nodes", nodes).withColumn("edges", F.transform(edges, lambda t: F.struct(t["source"].alias("s"), t["target"].alias("t"))))
    # sets of variables: each edge joins the sets that hold its ends
    start = F.transform("nodes", lambda v: F.array(v))
    merge = lambda acc, e: F.concat(F.filter(acc, lambda s: ~F.array_contains(s, e["s"]) & ~F.array_contains(s, e["t"])), F.array(F.array_distinct(F.flatten(F.filter(acc, lambda s: F.array_contains(s, e["s"]) | F.array_contains(s, e["t"]))))))
    parts = F.size(F.aggregate("edges", start, merge))
    return own.select(parts.cast("long").alias("parts")).groupBy("parts").agg(F.count(F.lit(1)).alias("n"))
