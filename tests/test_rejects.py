import pytest

from graphmill.operators import rejects

G = "(a / b)"
Q = '"(a / b :op1 ""x"")"'


def line(*, sentence="s", penman=G, status="ok", reference=G, extra=()):
    return "\t".join([sentence, "f.txt", "f.1", "f.txt__f.1", penman, status, reference, *extra])


CASES = [
    (line(), None), (line(penman=Q, reference=Q), None), (line(penman="", status=""), None), (line(sentence='"a\tb\nc ""d"" e"'), None), (line(sentence=""), None), (line(sentence='""'), None), (line(sentence='""""'), None),
    (line(sentence='"open'), "quoting"), (line(sentence='in"ner'), "quoting"), (line(sentence='"a"b'), "quoting"), (line(sentence='"a" '), "quoting"), (line(sentence='"a "b" c"'), "quoting"), (line(reference='"(a / b)'), "quoting"), (line(sentence='a"'), "quoting"),
    (line(extra=("x",)), "columns"), ("a\tb", "columns"), ("", "columns"), (None, "columns"),
    (line(status="OK"), "value"), (line(penman="(a / b"), "value"), (line(reference=""), "value"), (line(reference="nothing"), "value"), (line(status="ok "), "value"),
    (line(sentence='"open', extra=("x",)), "quoting"), (line(status="bad", extra=("x",)), "columns"), (line(sentence="é" * 100_000), None),
]


def test_lines(spark):
    rows = [(i, raw, "clash", i) for i, (raw, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "rec_id long, raw string, reason string, status int").repartition(3)
    got = {r["rec_id"]: r for r in rejects.parse_lines(df).collect()}
    assert {i: got[i]["reason"] for i in got} == {i: reason for i, (_, reason) in enumerate(CASES)}
    assert got[3]["sentence"] == 'a\tb\nc "d" e'
    assert got[1]["penman_str"] == '(a / b :op1 "x")'
    assert all(got[i][f] is None for i in got if got[i]["reason"] for f in rejects.FIELDS)
    assert {r["rec_id"]: r["reason"] for r in rejects.parse_lines(df, keep_fields=False).collect()} == {i: got[i]["reason"] for i in got}


@pytest.mark.parametrize("seed", range(5))
def test_structural_index_against_one_by_one(seed):
    import random

    import numpy as np

    rng = random.Random(seed)
    records = ["".join(rng.choice('ab"\t\n') for _ in range(rng.randrange(12))) for _ in range(300)]

    def slow(raw):
        fields, at = [], 0
        while True:
            if raw[at : at + 1] == '"':
                k = at + 1
                while True:
                    k = raw.find('"', k)
                    if k < 0:
                        return None
                    if raw[k : k + 2] == '""':
                        k += 2
                        continue
                    break
                if k + 1 < len(raw) and raw[k + 1] != "\t":
                    return None
                end = k + 1
            else:
                end = raw.find("\t", at)
                end = len(raw) if end < 0 else end
                if '"' in raw[at:end]:
                    return None
            fields.append(raw[at:end])
            if end >= len(raw):
                return fields
            at = end + 1

    data = "".join(records).encode()
    ends = np.concatenate([[0], np.cumsum([len(r.encode()) for r in records])])
    of, tabs, broken = rejects.structural_index(np.frombuffer(data, np.uint8), ends)
    for i, raw in enumerate(records):
        want = slow(raw)
        assert broken[i] == (want is None), repr(raw)
        if want is not None:
            assert (of == i).sum() + 1 == len(want), repr(raw)


def test_rows_and_empty_tables(spark):
    schema = "pred_id long, sentence string, fname string, sentid string, uid string, penman_str string, status string, reference_penman_str string, rec_id int, reason string"
    rows = [(1, G, None, G), (2, None, None, G), (3, "", "", G), (4, G, "done", G), (5, G, "ok", None), (6, G, "ok", ""), (7, "(x", "ok", G), (8, G, "ok", G), (8, G, "ok", G)]
    df = spark.createDataFrame([(i, "s", "f", "f.1", "u", p, s, r, 0, "x") for i, p, s, r in rows], schema)
    empty = spark.createDataFrame([], "rec_id long, raw string")
    assert sorted(r["rec_id"] for r in rejects.unusable(df, empty).collect()) == [4, 5, 6, 7]
    assert rejects.loaded(df, empty).count() == 5
    assert rejects.unusable(df.limit(0), empty).count() == 0


def test_split_records(monkeypatch):
    def split(text):
        data = text.encode()
        return [data[a:b].decode() for a, b in rejects.split_records(data)]

    assert split("") == [] and split("\n\n") == []
    assert split("a\tb\nc\r\n\nd") == ["a\tb", "c", "d"]
    assert split('"a\nb"\tc\n"x ""y"" z"\n') == ['"a\nb"\tc', '"x ""y"" z"']
    # a broken record is its first line; those after it are whole again
    assert split('a\n"open\tb\n"c\nd"\te\nf') == ["a", '"open\tb', '"c\nd"\te', "f"]
    assert split('in"ner\tx\n"a\nb"\tc\n') == ['in"ner\tx', '"a\nb"\tc']
    assert split('a\n"never closed\nb\nc') == ["a", '"never closed', "b", "c"]
    rows = [f'{i}\t"{"x" * (i % 7)}\n""q""\té"' for i in range(200)]
    for width in (1, 16, 64, 1 << 20):
        monkeypatch.setattr(rejects, "WINDOW", width)
        assert split("\n".join(rows)) == rows
        assert split("\n".join([*rows[:50], 'br"oken', *rows[50:]])) == [*rows[:50], 'br"oken', *rows[50:]]


def test_read_records(spark, tmp_path):
    good, bad = CASES[3][0], line(sentence='in"ner')
    (tmp_path / "a.tsv").write_text("\n".join(["\t".join(rejects.FIELDS), good, bad, good]) + "\n")
    (tmp_path / "b.tsv").write_text("")
    rows = rejects.read_records(spark, str(tmp_path)).selectExpr("cast(rec_no as bigint) AS rec_id", "raw")
    got = {r["rec_id"]: (r["reason"], r["sentence"]) for r in rejects.parse_lines(rows).collect()}
    assert got == {0: (None, 'a\tb\nc "d" e'), 1: ("quoting", None), 2: (None, 'a\tb\nc "d" e')}
