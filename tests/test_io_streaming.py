import json
import os

import pytest
from pyspark.sql import functions as F

from graphmill.functions import graphs
from graphmill.sources import corpus, predictions, sinks
from graphmill.streaming import corpus as streaming

BLOCKS = """# ::id demo.1 ::date 2024-01-01
# ::snt The cat wants to sleep.
(w / want-01
   :ARG0 (c / cat)
   :ARG1 (s / sleep-01
            :ARG0 c))

# ::id demo.2
# ::snt Broken.
(w / want-01

# ::id demo.3
(x / y)
"""
ROW = ("a\tb\nc \"d\"", "f.txt", "f.1", "f.txt__f.1", '(a / b\n   :op1 "x")', "ok", "(a / b)")


@pytest.fixture
def root(tmp_path):
    for split in ("train", "dev", "other"):
        os.makedirs(tmp_path / "en" / split)
        (tmp_path / "en" / split / "one.txt").write_text(BLOCKS)
    (tmp_path / "en" / "train" / "two.txt").write_text("\n\n# ::id demo.9\n# ::snt Nine.\n(n / nine)\n\n")
    (tmp_path / "en" / "train" / "ignored.md").write_text("(no / text)")
    return str(tmp_path / "en")


def test_blocks_with_other_line_ends(spark, tmp_path):
    plain = "# ::id a.1\n# ::snt One.\n(a / b\n   :c (d / e))\n\n# ::id a.2\n# ::snt Two.\n(f / g)\n"
    want = [b.strip() for b in plain.split("\n\n")]
    for name, text in (("crlf", plain.replace("\n", "\r\n")), ("blanks", plain.replace("\n\n", "\n  \t\n")), ("cr", plain.replace("\n", "\r"))):
        os.makedirs(tmp_path / name / "train")
        (tmp_path / name / "train" / "x.txt").write_bytes(text.encode())
        got = corpus.read_blocks(spark, str(tmp_path / name)).orderBy("block_no").collect()
        assert [r["block"] for r in got] == want and len({r["block_no"] for r in got}) == 2
        rows = corpus.read_corpus(spark, str(tmp_path / name)).orderBy("block_no").collect()
        assert [r["sentence"] for r in rows] == ["One.", "Two."] and [r["error"] for r in rows] == [None, None]


def test_read_corpus(spark, root):
    rows = corpus.read_corpus(spark, root, 3).collect()
    assert {r["split"] for r in rows} == {"train", "validation"}
    train = {(os.path.basename(r["file"]), r["block_no"]): r for r in rows if r["split"] == "train"}
    assert set(train) == {("one.txt", 0), ("one.txt", 1), ("one.txt", 2), ("two.txt", 0)}
    first = train["one.txt", 0]
    assert first["metadata"] == {"id": "demo.1", "date": "2024-01-01", "snt": "The cat wants to sleep."}
    assert first["sentence"] == "The cat wants to sleep." and first["penmanstr"].startswith("(w / want-01\n") and first["error"] is None and first["src_lang_idx"] == 3
    assert train["one.txt", 1]["error"] and train["one.txt", 2]["error"] == "no id or sentence"
    assert train["two.txt", 0]["sentence"] == "Nine."
    with pytest.raises(Exception, match="one.txt"):
        corpus.read_corpus(spark, root, strict=True).collect()
    assert corpus.read_corpora(spark, [root, root]).select("src_lang_idx").distinct().count() == 2


def test_read_lines(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a\x85b\nc\u2028d\n\ne", newline="")
    got = [r["line"] for r in corpus.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == ["a b", "c", "d", "", "e"]


def test_splits_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "i int, split string")
    sinks.write_splits(df, str(tmp_path / "p"))
    assert sorted(map(tuple, corpus.read_splits(spark, str(tmp_path / "p"), ("train",)).select("i", "split").collect())) == [(1, "train"), (2, "test")]
    with pytest.raises(ValueError, match="validation"):
        corpus.read_splits(spark, str(tmp_path / "p"), ("validation",))
    sinks.write_splits(df, str(tmp_path / "j"), as_json=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([ROW, (*ROW[:4], None, None, ROW[6])], predictions.SCHEMA)
    path = str(tmp_path / "preds")
    sinks.write_predictions(df, path)
    back = predictions.read_predictions(spark, path).collect()
    assert len(back) == 2 and tuple(max(back, key=lambda r: len(r["penman_str"] or ""))) == ROW
    both = predictions.read_systems(spark, [path, path], ["x", "y"])
    assert {r["system"]: r["count"] for r in both.groupBy("system").count().collect()} == {"x": 2, "y": 2}
    with pytest.raises(ValueError):
        predictions.read_systems(spark, [path], ["x", "y"])


def test_statistics(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"tok": {"train": {"n": 3, "max": 9}}, "dataset": {"dev": {"n": 1}}}))
    got = {(r["tokenizer"], r["split"]): r["stats"] for r in predictions.read_statistics(spark, str(tmp_path / "s.json")).collect()}
    assert got == {("tok", "train"): {"n": "3", "max": "9"}, ("dataset", "dev"): {"n": "1"}}


def test_other_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a.1", "(a / b)", 0.25, "train")], "id string, penman_str string, p double, split string")
    sinks.write_blocks(df, str(tmp_path / "b"), key_cols=("id",))
    assert [r["block"] for r in corpus.read_blocks(spark, str(tmp_path / "b")).collect()] == ["# ::id a.1\n(a / b)"]
    sinks.write_table(df, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).collect()[0]["p"] == "0.250000"
    sinks.write_document(df, str(tmp_path / "d"))
    assert json.loads(spark.read.text(str(tmp_path / "d")).collect()[0][0])["id"] == "a.1"
    info = sinks.processing_info(df.unionAll(df), df, {"dedupe": True}).collect()[0]
    assert (info["num_dropped"], info["final_sizes"], json.loads(info["options"])) == (1, {"train": 1}, {"dedupe": True})


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "done")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "uid string, n int")
    assert sinks.append_new(df, path, "uid") == 2
    assert sinks.append_new(df.union(spark.createDataFrame([("c", 3)], df.schema)), path, "uid") == 1
    assert sinks.append_new(df, path, "uid") == 0
    assert spark.read.parquet(path).count() == 3


def test_sql_functions(spark):
    graphs.register(spark)
    row = spark.sql("""SELECT penman_decode(t).top AS top, penman_linearize(t)[1] AS p, penman_repair(substr(t, 1, 20)).status AS s, penman_match(t, t).matched AS m, penman_encode(penman_decode(t).triples) AS e FROM (SELECT '(a / b :ARG0 (c / d))' AS t)""").collect()[0]
    assert tuple(row) == ("a", "<pointer:0>", "fixed", 4, "(a / b :ARG0 (c / d))")
    assert [tuple(r) for r in spark.sql("SELECT * FROM penman_triples('(a / b :x 1)')").collect()] == [(0, "a", ":instance", "b"), (1, "a", ":x", "1")]
    nulls = spark.sql("SELECT penman_decode(t).error AS e, penman_repair(t).status AS s, penman_linearize(t) AS l, penman_match(t, t).backed_off AS b FROM (SELECT cast(null AS string) AS t)").collect()[0]
    assert nulls["e"] and nulls["s"] == "backoff" and nulls["l"] is None and nulls["b"]


def test_wiki(spark):
    df = spark.createDataFrame([('(a / b :wiki "X" :name (n / name))',)], "t string").select(graphs.decode_graph("t").alias("g"))
    assert df.select(graphs.encode_graph(graphs.without_wiki(F.col("g.triples")))).collect()[0][0] == "(a / b :wiki + :name (n / name))"


def test_stream_of_blocks(spark, root):
    out = streaming.stream_blocks(spark, os.path.join(root, "train"))
    q = out.writeStream.format("memory").queryName("blocks").start()
    q.processAllAvailable()
    q.stop()
    got = {r["metadata"]["id"]: r["status"] for r in spark.sql("SELECT * FROM blocks").collect()}
    assert got == {"demo.1": "ok", "demo.2": "fixed", "demo.3": "ok", "demo.9": "ok"}


def test_stream_of_statuses(spark, tmp_path):
    rows = [("x", "ok", "2024-01-01 01:00:00"), ("x", None, "2024-01-01 02:00:00"), ("x", "ok", "2024-01-05 02:00:00"), ("y", "ok", "2024-01-01 03:00:00")]
    df = spark.createDataFrame(rows, "system string, status string, run_at string").withColumn("run_at", F.to_timestamp("run_at"))
    df.write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "p"))
    q = streaming.status_windows(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((str(r["start"])[:10], r["system"], r["status"], r["n"]) for r in spark.sql("SELECT * FROM windows").collect())
    assert got == [("2024-01-01", "x", "none", 1), ("2024-01-01", "x", "ok", 1), ("2024-01-01", "y", "ok", 1), ("2024-01-05", "x", "ok", 1)]


def test_stream_of_beams(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1, -0.1, "a"), (1, 1, 0, -9.0, "b")], "sample_id long, beam_idx int, status int, score double, graph string")
    df.write.parquet(str(tmp_path / "b"))
    q = streaming.best_so_far(spark.readStream.schema(df.schema).parquet(str(tmp_path / "b"))).writeStream.outputMode("complete").format("memory").queryName("best").start()
    q.processAllAvailable()
    q.stop()
    assert [r["graph"] for r in spark.sql("SELECT * FROM best").collect()] == ["b"]
