"""The driver's contract on the smallest tables: every query runs, and equals its SQL where it has one."""

import glob
import os

import pytest

import __spark_entry__ as entry

SMALL = entry.SMALL
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
#: Queries without SQL, by reason: graphs, arrays and models that SQL doesn't express; their tests are in the other files.
NO_SQL = {"p1_found", "p1_loaded", "p1_reasons", "fix_text", "punct_normalize", "detokenize", "penman_triples", "penman_edges", "wiki_free_graphs", "linearize_tokens", "roundtrip_failures", "decode_status", "repair_graph", "delinearize", "connected_parts", "match_counts", "evaluate_systems"}


def core():
    from graphmill.plans import catalog

    return catalog.QUERIES, catalog.SQL


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def values(frame):
    def one(v):
        if v is None or v != v or type(v).__name__ in ("NAType", "NaTType"):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(v, 9) if isinstance(v, float) else v

    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(map(one, r))) for r in frame.itertuples(index=False))


def test_names():
    q, s = core()
    assert set(q) - set(s) == NO_SQL and set(s) <= set(q)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["split", "n", "chars"] and df.count() == 3


@pytest.mark.parametrize("name", sorted(core()[0]))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    got = df.toPandas()
    assert len(set(df.columns)) == len(df.columns)
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert values(got) == values(want)


def test_bootstrap_has_the_usual_replicates(spark):
    """The registered queries draw as many replicates as the reference, 1000."""
    from graphmill.operators import scoring
    from graphmill.session import table

    pairs = scoring.one_per_pair(table(spark, SMALL, "pair_counts"))
    assert values(entry.queries()["bootstrap_ci"](spark, SMALL).toPandas()) == values(scoring.intervals(pairs, 1000).toPandas())
    bars = {r["label"]: r["below"] for r in entry.queries()["ci_error_bars"](spark, SMALL).collect()}
    assert bars == {"system " + r["system"]: round(r["result"] - r["ci_low"], 6) for r in scoring.intervals(pairs, 1000).filter("metric = 'fscore'").collect()}
    assert values(entry.queries()["significance_table"](spark, SMALL).toPandas()) == values(scoring.significance(pairs, 1000).toPandas())
