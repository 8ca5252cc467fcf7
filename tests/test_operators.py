import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphmill.functions import arrays, text
from graphmill.operators import batching, prepare, ranking, resume, scoring


def column(spark, f, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


# --- text
def test_blanks_and_words(spark):
    values = ("  a  b\t\nc ", "", "   ", None, "a b", "\x1cx\x85y")
    assert column(spark, text.collapse_blanks, *values) == ["a b c", "", "", None, "a b", "x y"]
    assert column(spark, text.word_count, *values) == [3, 0, 0, None, 2, 2]


def test_splits(spark):
    assert column(spark, text.split_name, "train", "training", "dev", "validation", "test", "valid", None) == ["train", "train", "validation", "validation", "test", None, None]
    with pytest.raises(Exception, match="unknown split valid"):
        column(spark, lambda c: text.split_name(c, True), "valid")


def test_punct_wrapped(spark):
    values = ("(a)", "a.", '"a."', ".", "", "(a)\n", "«a»", None)
    assert column(spark, text.punct_wrapped, *values) == [True, False, True, True, False, False, False, None]


def test_forms(spark):
    assert column(spark, text.is_number, "1", "-1.5", ".5", "1e3", "inf", "nan", "1_0", "", None) == [True, True, True, True, False, False, False, False, None]
    assert column(spark, text.is_url, "http://a.com/x?y", "a.com", "localhost:80/x", "10.0.0.1", "no", "a b.com") == [True, True, True, True, False, False]
    assert column(spark, text.is_email, "A.b@c.org", "a@b", "x a@b.org") == [True, False, False]
    assert column(spark, text.is_filename, "a.txt", ".txt", "a", "x y.z", "a.") == [True, True, False, True, False]


def test_token_class(spark):
    got = column(spark, text.token_class, "i", "b2", "b", "12", '"x"', "+", "-", ":mode", ":ARG0", "/", "(", ")", "go-02", "a.b", "_x", "Über")
    assert got == ["I", "VAR", "VAR", "CONST", "CONST", "CONST", "CONST", "MODE", "EDGE", "/", "(", ")", "INST", "CONST", "CONST", "INST"]


def test_quotes_and_prefixes(spark):
    assert column(spark, text.balance_quote, '"a', 'a"', '"a"', "a", '"', None) == ['"a"', '"a"', '"a"', "a", '""', None]
    assert column(spark, lambda c: text.prefixed(c, "#"), "a", "_a", "-of", "") == ["#a", "_a", "-of", "#"]


def test_components(spark):
    got = column(spark, text.components, ":prep-on-behalf", "go-02", "cat", "<pointer:07>", ":quant", "<rel>", "a--b", "-of")
    assert got == [[" relation", " prep", " on", " behalf"], [" go", " 2"], [" cat"], [" pointer", " 7"], [" relation", " quantity"], [" ("], [" a", " b"], [" of"]]


def test_cleaning(spark):
    assert column(spark, text.fix_text, "a&amp;b &lt;c&gt; “x” it’s\r\ny\x00﻿", None, "") == ['a&b <c> "x" it\'s\ny', None, ""]
    assert column(spark, lambda c: text.normalize_punctuation(c, F.lit("es")), "«hola» , ( x )… 5 %") == ['"hola" , (x)... 5%']
    assert column(spark, lambda c: text.normalize_punctuation(c, F.lit("en")), 'he said "so".') == ['he said "so."']
    assert column(spark, lambda c: text.detokenize(c, F.lit("en")), 'It \'s ( a ) " test " , do n\'t !') == ['It\'s (a) "test", don\'t!']
    assert column(spark, lambda c: text.detokenize(c, F.lit("fr")), "l' eau") == ["l'eau"]


# --- arrays
def test_arrays(spark):
    df = spark.createDataFrame([(1, [3, 1, 3, 2]), (2, []), (3, None), (4, [-100, 0, 5])], "i int, a array<int>")
    rows = {r["i"]: r for r in df.select("i", arrays.argmax(F.col("a")).alias("best"), arrays.without_last(F.col("a")).alias("x"), arrays.without_first(F.col("a")).alias("y"), arrays.truncated(F.col("a"), 3, 1).alias("t"), arrays.padded(F.col("a"), F.lit(5), 9).alias("p"), arrays.without_special(F.col("a"), [3, 5]).alias("s"), arrays.mapped(F.col("a"), {3: 30}, 0).alias("m")).collect()}
    assert rows[1]["best"] == 0 and rows[2]["best"] == -1 and rows[3]["best"] is None and rows[4]["best"] == 2
    assert rows[1]["x"] == [3, 1, 3] and rows[1]["y"] == [1, 3, 2] and rows[2]["x"] == [] and rows[2]["y"] == []
    assert rows[1]["t"] == [3, 1] and rows[1]["p"] == [3, 1, 3, 2, 9] and rows[2]["p"] == [9] * 5
    assert rows[1]["s"] == [1, 2] and rows[4]["s"] == [0] and rows[1]["m"] == [30, 0, 30, 0]
    equal, counted = arrays.matches(F.col("a"), F.transform("a", lambda x: F.when(x == 1, -100).otherwise(x)))
    assert [tuple(r) for r in df.filter("i = 1").select(equal, counted).collect()] == [(3, 3)]


# --- ranking
@pytest.mark.parametrize("seed", range(2))
def test_grouped_rank(spark, seed):
    rng = random.Random(seed)
    rows = [(i, None if rng.random() < 0.1 else 0 if rng.random() < 0.4 else rng.randrange(5), rng.randrange(20)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g int, x int").repartition(7)
    got = {r["i"]: r["rank"] for r in ranking.grouped_rank(df, ["g"], [F.desc("x"), F.col("i")]).collect()}
    by = defaultdict(list)
    for i, g, x in rows:
        by[g].append((-x, i))
    assert got == {i: k for g in by for k, (_, i) in enumerate(sorted(by[g]))}
    whole = {r["i"]: r["rank"] for r in ranking.grouped_rank(df, [], [F.col("i")]).collect()}
    assert whole == {i: i for i in range(500)}
    assert ranking.grouped_rank(df.limit(0), ["g"], [F.col("i")]).count() == 0


def test_keep_first_and_assignment(spark):
    rows = [(4, "a.1", 1, "train", "same", "(a / b)"), (2, "a.2", 0, "test", "same", "(a / bbb)"), (3, "a.3", 0, "train", "same", "(a / bb)"), (1, "a.4", None, "train", "same", "(a / b)"), (5, "a.1", 0, "train", "other", "(a / b)")]
    df = spark.createDataFrame(rows, "row_id long, id string, src_lang_idx int, split string, s string, penmanstr string")
    assert sorted(r["row_id"] for r in prepare.first_of_sentence(df).collect()) == [3, 5]
    assigned = {r["row_id"]: r["assigned"] for r in prepare.assigned_languages(df, 2).collect()}
    assert assigned == {5: 0, 3: 1, 2: 0}
    assert sorted(r["row_id"] for r in prepare.rows_of_assigned(df, 2).collect()) == [2, 5]


# --- batches
@pytest.mark.parametrize(("group", "shuffle", "keep"), [(g, s, k) for g in (True, False) for s in (True, False) for k in (True, False)])
def test_language_batches(spark, group, shuffle, keep):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, None]), rng.randrange(1, 50), rng.randrange(1, 90)) for i in range(203)] + [(900, 9, 3, 3)]
    df = spark.createDataFrame(rows, "idx long, lang int, in_len int, out_len int")
    got = batching.language_batches(df, 8, 3, group, keep, shuffle).collect()
    lang, batches = {i: g for i, g, _, _ in rows}, defaultdict(list)
    for r in got:
        batches[r["batch"]].append(r["idx"])
    assert all(len({lang[i] for i in b}) == 1 for b in batches.values())
    sizes = [len(batches[b]) for b in sorted(batches)]
    full = sum(n // 8 for n in Counter(lang.values()).values())
    assert sizes[:full] == [8] * full and sorted(batches) == list(range(len(batches)))
    assert len(got) == (204 if keep else 8 * full) and len({r["idx"] for r in got}) == len(got)
    out = {i: o for i, _, _, o in rows}
    if group:
        assert all([out[i] for i in b] == sorted((out[i] for i in b), reverse=True) for b in (sorted(x, key=lambda i: next(r["place"] for r in got if r["idx"] == i)) for x in list(batches.values())[:6]))
    assert batching.mixed_batches(spark.createDataFrame([(r["batch"], r["lang"]) for r in got], "batch long, lang int")).count() == 0


def test_batches_to_predict(spark):
    df = spark.createDataFrame([(i, i % 2, 5, None) for i in range(11)], "idx long, lang int, in_len int, out_len int")
    got = sorted((r["batch"], r["place"], r["idx"]) for r in batching.language_batches(df, 4).collect())
    assert [i for _, _, i in got] == [0, 2, 4, 6, 1, 3, 5, 7, 8, 10, 9]


def fold(lengths, budget):
    out, batch, longest, n = [], -1, 0, 0
    for x in lengths:
        x = max(1, x or 1)
        if batch < 0 or max(longest, x) * (n + 1) > budget:
            batch, longest, n = batch + 1, x, 1
        else:
            longest, n = max(longest, x), n + 1
        out.append(batch)
    return out


@pytest.mark.parametrize("chunk", [7, 60, 1000])
def test_budget_batches(spark, chunk):
    rng = random.Random(chunk)
    rows = [(g, k, rng.choice([None, 0, 1, 2, 3, 9, 30])) for g, n in (("a", 200), ("b", 1), ("c", 13)) for k in range(n)]
    df = spark.createDataFrame(rows, "group string, idx long, length int").repartition(3)
    got = {(r["group"], r["idx"]): r["batch"] for r in batching.budget_batches(df, 20, chunk).collect()}
    want = {}
    for g in "abc":
        own = [x for h, _, x in rows if h == g]
        want.update({(g, k): b for k, b in enumerate(fold(own, 20))})
    assert got == want


def test_main_language(spark):
    df = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 2, 2), (0, 1, 3), (1, None, 0)], "batch long, lang int, pos long")
    assert {r["batch"]: r["lang"] for r in batching.main_language(df).collect()} == {0: 1, 1: None}


# --- resuming
def test_resume(spark):
    work = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "uid string, n int")
    done = spark.createDataFrame([("b", "x"), ("b", "y"), (None, "z")], "uid string, graph string")
    assert sorted(r["n"] for r in resume.unfinished(work, done, "uid").collect()) == [1, 3, 4]
    assert [r["n"] for r in resume.first_unfinished(work, done, "uid", "n", 2).collect()] == [1, 3]
    assert resume.merged(work, done).count() == 7
    last = resume.with_reference(work, done.withColumn("pos", F.monotonically_increasing_id()), "uid", "pos", "graph")
    assert {r["n"]: r["reference"] for r in last.collect()} == {1: None, 2: "y", 3: None, 4: None}


def test_best_of_beam(spark):
    beams = spark.createDataFrame([(1, 0, 1, -0.1, "a"), (1, 1, 0, -9.0, "b"), (1, 2, 0, -2.0, "c"), (1, 3, 0, -2.0, "d"), (2, 0, 2, -1.0, "e")], "sample_id long, beam_idx int, status int, score double, graph string")
    assert sorted((r["sample_id"], r["graph"]) for r in resume.best_of_beam(beams).collect()) == [(1, "c"), (2, "e")]


# --- scores
PAIRS = "system string, uid string, matched long, n_pred long, n_gold long, backed_off boolean"


def test_scores(spark):
    df = spark.createDataFrame([("x", "1", 3, 4, 6, False), ("x", "2", 0, 0, 0, True), ("x", "1", 2, 4, 6, False), ("y", "1", 6, 6, 6, False)], PAIRS)
    one = scoring.one_per_pair(df)
    assert one.count() == 3
    pair = {(r["system"], r["uid"]): (r["precision"], r["recall"], r["fscore"]) for r in scoring.pair_scores(one).collect()}
    assert pair["x", "1"] == (75.0, 50.0, 60.0) and pair["x", "2"] == (0.0, 0.0, 0.0)
    micro = {r["system"]: r["fscore"] for r in scoring.micro_scores(one, "system").collect()}
    assert micro == {"x": 60.0, "y": 100.0}


def test_bootstrap(spark):
    rng = random.Random(4)
    rows = [(s, str(i), m, 10, 10, False) for s, p in (("a", 7), ("b", 7), ("c", 3)) for i in range(150) for m in [max(0, min(10, round(rng.gauss(p, 2))))]]
    df = spark.createDataFrame(rows, PAIRS)
    ci = {(r["system"], r["metric"]): r for r in scoring.intervals(df, 300).collect()}
    for r in ci.values():
        assert r["ci_low"] < r["result"] < r["ci_high"]
    f = [m / 10 for s, _, m, *_ in rows if s == "a"]
    mean = sum(f) / len(f)
    error = 100 * math.sqrt(sum((x - mean) ** 2 for x in f)) / len(f)
    width = ci["a", "fscore"]["ci_high"] - ci["a", "fscore"]["ci_low"]
    assert 0.7 < width / (2 * 1.96 * error) < 1.4
    sig = {(r["system_1"], r["system_2"]): r["pval"] for r in scoring.significance(df, 300).collect()}
    assert set(sig) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert scoring.intervals(df.limit(0), 20).count() == 0


def test_poisson_weights(spark):
    w = [r[0] for r in spark.range(20_000).select(scoring.poisson(scoring.draw(F.lit(1), F.col("id")))).collect()]
    assert abs(sum(w) / len(w) - 1) < 0.03 and abs(w.count(0) / len(w) - math.exp(-1)) < 0.02
