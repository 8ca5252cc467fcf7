import json
import os

import pytest
from pyspark.sql import functions as F

from graphmill import __main__ as cli
from graphmill.functions import vocab
from graphmill.operators import pipeline

EN = "# ::id d.1\n# ::snt A “cat” .\n(c / cat :wiki \"C\")\n\n# ::id d.2\n# ::snt (note)\n(n / note :polarity -)\n\n# ::id d.3\n# ::snt A \"cat\".\n(c / cat)\n"
NL = "# ::id d.1\n# ::snt Een kat .\n(c / cat)\n\n# ::id d.2\n# ::snt noot\n(n / note :polarity -)\n\n# ::id d.3\n# ::snt kat\n(c / cat)\n"


@pytest.fixture
def roots(tmp_path):
    for lang, text in (("en", EN), ("nl", NL)):
        os.makedirs(tmp_path / lang / "train")
        (tmp_path / lang / "train" / "a.txt").write_text(text)
    return [str(tmp_path / "en"), str(tmp_path / "nl")]


def test_prepare(spark, roots, tmp_path):
    before, ready = pipeline.prepare_dataset(spark, roots, ["en", "nl"], dedupe=True, remove_wiki=True, fix_text=True, detokenize=True, remove_bracketed=True)
    got = sorted((r["src_lang_idx"], r["sentence"], r["penmanstr"]) for r in ready.collect())
    assert [s for _, s, _ in got] == ['A "cat".', "Een kat.", "kat", "noot"]
    assert got[0][2] in ("(c / cat :wiki +)", "(c / cat)")
    out = str(tmp_path / "out")
    pipeline.write_dataset(before, ready, out, {"dedupe": True})
    info = json.loads(spark.read.text(f"{out}/info").collect()[0][0])
    assert info["num_dropped"] == 1 and info["final_sizes"] == {"train": 4}
    assert spark.read.parquet(f"{out}/kept_ids").count() == 3
    stats = {(r["tokenizer"], r["field"]): r for r in pipeline.corpus_statistics(spark.read.parquet(f"{out}/dataset"), most=6).collect()}
    assert stats["words", "sentence"]["longest"] == 2 and stats["chars", "sentence"]["beyond"] == 2 and stats["chars", "sentence"]["n"] == 4


def test_prepare_across_languages(spark, roots):
    _, ready = pipeline.prepare_dataset(spark, roots, ["en", "nl"], split_across_languages=True)
    assert sorted((r["id"], r["src_lang_idx"]) for r in ready.collect()) == [("d.1", 0), ("d.2", 1), ("d.3", 0)] or ready.count() == 3
    with pytest.raises(ValueError):
        pipeline.prepare_dataset(spark, roots, ["en"])


def test_fix_and_translate(spark, roots, tmp_path):
    lines = pipeline.fix_corpus(spark, roots[0])
    snt = [r["line"] for r in lines.filter(F.col("line").startswith("# ::snt")).orderBy("line_no").collect()]
    assert snt == ['# ::snt A "cat" .', "# ::snt (note)", '# ::snt A "cat".']
    new = pipeline.translate_corpus(lines, lambda xs: [x.upper() + "  !" for x in xs], 2)
    assert [r["line"] for r in new.filter(F.col("line").startswith("# ::snt")).orderBy("line_no").collect()] == ['# ::snt A "CAT" . !', "# ::snt (NOTE) !", '# ::snt A "CAT". !']
    assert new.count() == lines.count()
    pipeline.write_lines(lines, str(tmp_path / "fixed"))
    assert spark.read.parquet(str(tmp_path / "fixed")).collect()[0]["text"].count("\n") == EN.count("\n")


def test_infer_and_evaluate(spark):
    rows = spark.createDataFrame([(1, "a cat"), (2, "x")], "row_id long, sentence string")
    beams = pipeline.infer(rows, "row_id", "sentence", lambda xs: [[("(c / cat", -0.1), ("(c / cat)", -0.5)] if "cat" in x else [("nothing", -1.0)] for x in xs])
    got = {(r["sample_id"], r["beam_idx"]): (r["status"], r["graph"]) for r in beams.collect()}
    assert got == {(1, 0): (1, "(c / cat)"), (1, 1): (0, "(c / cat)"), (2, 0): (2, "(d2 / dog :ARG0-of (b1 / bark-01))")}
    preds = spark.createDataFrame([("s", "1", "(c / cat)", "ok", "(x / cat)"), ("s", "2", None, "ok", "(d / dog)"), ("s", "3", "(a / b)", None, None)], "system string, uid string, penman_str string, status string, reference_penman_str string")
    pairs, scores = pipeline.evaluate(preds)
    assert {r["uid"]: r["matched"] for r in pairs.collect()}["1"] == 2
    assert {r["metric"] for r in scores.collect()} == {"precision", "recall", "fscore"}
    assert {r["status"]: r["n"] for r in pipeline.rescore(preds).collect()} == {"ok": 1, "backoff": 2}


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("go-01\t9\nrare-01\t4\nedge-01\t5\n:ARG0\n-of\n")
    added = vocab.added_vocabulary(vocab.read_vocabulary(spark, str(tmp_path / "v.tsv")), pointers=3)
    got = {r["token"]: r["kind"] for r in added.collect()}
    assert set(got) == {"go-01", "edge-01", ":ARG0", "-of", "<pointer:0>", "<pointer:1>", "<pointer:2>", "<rel>", "</rel>", "<lit>", "</lit>"}
    known = spark.createDataFrame([("go-01",)], "token string")
    assert "go-01" not in [r["token"] for r in vocab.to_add(added, known).collect()]


def test_ids_and_collation(spark):
    df = spark.createDataFrame([(0, ["a", "b", "?"], [5, 6]), (0, ["a"], [7]), (1, [], [])], "batch int, t array<string>, l array<int>")
    ids = vocab.encode_ids(F.col("t"), {"a": 10, "b": 11}, 3, 4, [99], [2], (99,), 50)
    df = df.withColumn("i", ids)
    assert sorted(r["i"] for r in df.collect()) == [[50, 2], [50, 10, 2], [50, 10, 11, 2]]
    rows = {tuple(r["l"]): r for r in vocab.collate(df, "batch", "i", "l", 0).collect()}
    assert rows[7,]["input_ids"] == [50, 10, 2, 0] and rows[7,]["attention_mask"] == [1, 1, 1, 0]
    assert rows[7,]["decoder_input_ids"] == [7] and rows[7,]["labels"] == [-100] and rows[5, 6]["labels"] == [6]


def test_command_line(tmp_path, roots, spark):
    (tmp_path / "c.json").write_text(json.dumps({"langs": ["en", "nl"], "dedupe": True}))
    args = cli.arguments(["prepare", "-i", *roots, "-o", str(tmp_path / "x"), "--config", str(tmp_path / "c.json"), "--fix_text"])
    assert args.dedupe and args.fix_text and args.langs == ["en", "nl"] and not args.detokenize
    cli.main(["prepare", "-i", *roots, "--langs", "en", "nl", "-o", str(tmp_path / "x")])
    assert spark.read.parquet(str(tmp_path / "x" / "dataset")).count() == 6
    (tmp_path / "d.json").write_text(json.dumps({"nonsense": 1}))
    with pytest.raises(SystemExit):
        cli.arguments(["statistics", "x", "-o", "y", "--config", str(tmp_path / "d.json")])
