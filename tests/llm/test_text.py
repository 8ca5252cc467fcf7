import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import garble, leaks, mixing, pages, personal, tokens, unify

SOURCES = "source string, id_prefix string, domain string, target_share double, max_repeat int"


# --- tokens
def test_trie_equals_greedy():
    rng = random.Random(3)
    for _ in range(60):
        vocab = {bytes([c]) for c in b"abc"} | {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(12))}
        trie = tokens.Trie(vocab)
        for _ in range(40):
            text = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(30)))
            assert trie.count(text) == tokens.greedy_count(text, vocab)


def test_trie_without_single_bytes():
    vocab = {b"abc", b"a"}
    trie = tokens.Trie(vocab)
    for text in (b"", b"a", b"ab", b"abc", b"abab", b"bbb", b"ababc", b"abcab"):
        assert trie.count(text) == tokens.greedy_count(text, vocab), text


def test_trie_of_incomplete_vocabularies():
    """Tokens that aren't reached byte by byte: dead stretches hold certain tokens."""
    assert tokens.Trie({b"ab", b"abcd", b"x"}).count(b"abcx") == 3
    rng = random.Random(9)
    for _ in range(3000):
        vocab = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 9))}
        text = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(40)))
        assert tokens.Trie(vocab).count(text) == tokens.greedy_count(text, vocab), (vocab, text)


def test_counts_of_a_tokenizer():
    ranks = tokens.read_vocabulary()
    c = tokens.Counts(ranks)
    for text in ("", " ", "the cat  sat\n\n  on \t the mat ", "héllo wörld 12345 x.y", "a\n      :b (c / d)", "word" * 1000):
        longest, merged = c.of(text)
        assert merged == len(c.coder.encode_ordinary(text))
        assert longest == sum(tokens.greedy_count(p.encode(), set(ranks)) for p in c.pieces.findall(text))
    assert c.of(None) == (0, 0)


def test_token_budget(spark):
    samples = spark.createDataFrame([(1, "News1.1", 0, "a cat", "(a / b)", "x"), (2, "zzz.1", None, None, "(a / b)", "x"), (3, "NEWS2.1", 9, "", "", "x")], "row_id long, id string, src_lang_idx int, sentence string, penmanstr string, source string")
    docs = spark.createDataFrame([(1, "a cat", "en", "news"), (2, None, None, None), (3, "a cat", "EN", "other")], "doc_id long, text string, lang string, source string")
    langs = spark.createDataFrame([(0, "en")], "src_lang_idx int, lang string")
    sources = spark.createDataFrame([("news", "news", "press", 1.0, 1)], SOURCES)
    got = {(r["tbl"], r["field"], r["source"], r["lang"], r["domain"]): (r["n_texts"], r["merged_tokens"]) for r in tokens.token_budget(samples, docs, langs, sources).collect()}
    assert got["documents", "text", "news", "en", "press"] == (1, 2)
    assert got["documents", "text", "unknown", "unknown", "unknown"] == (1, 0)
    assert got["documents", "text", "other", "en", "unknown"] == (1, 2)
    assert got["prepare_dataset", "sentence", "news", "en", "press"] == (1, 2)
    assert got["prepare_dataset", "sentence", "news", "unknown", "press"] == (1, 0)
    assert tokens.token_budget(samples.limit(0), docs.limit(0), langs, sources).count() == 0


# --- look-alikes
def test_unify():
    pairs = [("ｔｈｅ １２", "the 12"), ("hарру", "happy"), ("Мαrϲh", "March"), ("Ꭺpple", "Apple"), ("ꓮpple", "Apple"), ("ⲟpen", "open"), ("a​b­c", "abc"), ("a b c", "a b c"), ("pintó", "pintó"), ("𝐩𝐨𝐞𝐭", "poet"), ("Horkĳas", "Horkijas"), ("ﬁn", "fin")]
    same = ["plain", "é – “x” «y» it’s", "Жимлодар", "Κορδέναλ и", "", None, "tab\tline\nend\r\n", "Brândavel", "x" * 50_000]
    assert unify.unify([a for a, _ in pairs]) == [b for _, b in pairs]
    assert unify.unify(same) == same
    assert unify.unify([b for _, b in pairs]) == [b for _, b in pairs]


def test_unify_tables(spark):
    df = spark.createDataFrame([(1, "ｔｈｅ", "(a / b)", "x"), (2, None, None, "x"), (3, "", "(a / b)", "x"), (3, "ok", "ok", "x")], "row_id long, sentence string, penmanstr string, field string")
    assert sorted(map(tuple, unify.suspects(df).collect())) == [(1, "sentence"), (3, "penmanstr")]
    assert sorted(r["sentence"] or "" for r in unify.unified(df.filter("row_id < 3")).collect()) == ["", "the"]
    assert unify.suspects(df.limit(0)).count() == 0
    for c in ("½", "…", "²"):
        assert unify.unify([c]) == [unicodedata.normalize("NFKC", c)]


# --- wrong encodings
SENTENCES = {1: ["Según el Consejo de Córdoba, la cocinera compró el jardín y después pintó la montaña", "El médico limpió la cabaña en España", "La niña señaló el corazón común", "«El ratón dañó la lámpara»"], 3: ["Die Köchin verkaufte die schöne Brücke für die Bäuerin", "Der Gärtner prüfte das nützliche Gerät während der Übung", "Die Ärztin erwähnte die Hütte"], 0: ["According to the Brândavel Council – the driver found the “lamp” in Ãlmeris", "The cook sold the fence in Zélkimar"]}


def corpus(spark, damage=0.1, seed=1):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(1500):
        lang = rng.choice(list(SENTENCES))
        text = rng.choice(SENTENCES[lang])
        bad = text
        if rng.random() < damage:
            page = rng.choice(["cp1252", "latin_1", "mac_roman", "cp437", "cp1250", "cp1251"])
            bad = pages.garble(text, page)
            bad = pages.garble(bad, page) if page == "cp1252" and rng.random() < 0.3 else bad
            if bad != text:
                truth[i] = text
        rows.append((i, f"nws.{i}", lang if i % 50 else None, bad, None if i % 7 == 0 else text, "clash", "clash"))
    return spark.createDataFrame(rows, "row_id long, id string, src_lang_idx int, sentence string, snt string, lang string, text string").repartition(4), truth


def test_garbled_text_is_found_and_restored(spark):
    df, truth = corpus(spark)
    sources = spark.createDataFrame([("news", "nws", "press", 1.0, 1)], SOURCES)
    got = {r["row_id"]: r for r in garble.garbled_fields(df, sources).collect()}
    assert set(got) == set(truth)
    right = sum(got[i]["restored"] == truth[i] for i in truth)
    assert right >= 0.98 * len(truth)
    assert all(r["field"] == "sentence" for r in got.values())


def test_lost_bytes_and_empty(spark):
    df, _ = corpus(spark, 0.0)
    sources = spark.createDataFrame([("news", "nws", "press", 1.0, 1)], SOURCES)
    model = garble.learn(df, sources)
    bad, whole, text = garble.restore("La coc�n compr� el jardín", 3, "news", model)
    assert bad
    assert garble.restore(None, 1, "x", model) == (False, False, None)
    assert garble.restore("", 1, "x", model) == (False, False, "")
    assert garble.restore("Brândavel “É”", 1, "x", model)[0] is False
    assert garble.garbled_fields(df.limit(0), sources).count() == 0
    assert garble.garbled_fields(df, sources).count() == 0


@pytest.mark.parametrize("page", pages.PAGES)
def test_ciphers_invert(page):
    text = "Señor Übermut – “zwölf” Жимлодар"
    bad = pages.garble(text, page)
    assert any(z == text[2:3] for m in pages._RUN.finditer(bad) for _, _, plains in pages.readings(m[0]) for i, z in plains if pages.CIPHERS[i] == (page, 1))


SPANISH = ["el niño", "la canción", "mañana", "también", "el corazón", "está aquí", "el jardín", "una razón", "el café", "según él", "la acción", "un año", "dieciséis", "la región", "más allá", "el señor", "después", "la música"]
RUSSIAN = ["старый дом", "новая книга", "большой город", "красный стол", "хороший день", "он читает", "она пишет", "мы говорим", "вчера вечером", "завтра утром", "маленький ребёнок", "белый снег", "теплый ветер", "дорога домой", "под деревом"]


def permuted(text):
    """Read through a page that nobody knows: the upper half of cp1252 in another order."""
    high = [c for c in (bytes([b]).decode("latin-1") for b in range(161, 256))]
    order = random.Random(77).sample(high, len(high))
    return text.translate({ord(a): b for a, b in zip(high, order)})


def swapped_corpus(spark, damages, words, lang=1, n=6000):
    """Three of four rows are clean text of source nws; the others are damaged, each source by its own page, and clean in between."""
    rng = random.Random(8)
    rows, truth = [], {}
    names = list(damages)
    for i in range(n):
        text = f"{rng.choice(words)} y {rng.choice(words)} en {rng.choice(words)}"
        name = names[i // 4 % len(names)] if i % 4 == 0 else "nws"
        bad = damages[name](text) if name != "nws" and i % 40 else text
        if bad != text:
            truth[i] = text
        rows.append((i, f"{name}.{i}", lang, bad, None, "x", "x"))
    df = spark.createDataFrame(rows, "row_id long, id string, src_lang_idx int, sentence string, snt string, lang string, text string").repartition(4)
    return df, truth, spark.createDataFrame([(n, n, "press", 1.0, 1) for n in (*names, "nws")], SOURCES)


def read_as(written, page):
    return lambda text: text.encode(written, "replace").decode(page, "replace")


@pytest.mark.parametrize(
    ("words", "damages"),
    [
        (SPANISH, {"a": read_as("cp1252", "cp437"), "b": read_as("cp1252", "mac_roman"), "c": read_as("latin-1", "cp850"), "d": read_as("mac_roman", "cp1252"), "e": read_as("latin-1", "cp1251")}),
        (SPANISH, {"a": permuted, "b": read_as("cp1252", "iso8859_3")}),
        (RUSSIAN, {"a": read_as("cp1251", "latin-1"), "b": read_as("koi8-r", "cp1251")}),
    ],
)
def test_swapped_pages_are_found_and_restored(spark, words, damages):
    """A source read through another single-byte page: one letter for one other, alone among ASCII letters or in whole words; also by a page unknown to all."""
    df, truth, sources = swapped_corpus(spark, damages, words)
    got = {r["row_id"]: r["restored"] for r in garble.garbled_fields(df, sources).collect()}
    missed, more = set(truth) - set(got), set(got) - set(truth)
    assert len(missed) <= 0.02 * len(truth) and len(more) <= 0.01 * len(truth)
    assert sum(got.get(i) == t for i, t in truth.items()) >= 0.97 * len(truth)


# --- leaks
def test_leaks_exact(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(40))) for k in range(20)] + [(50, "too short"), (51, None), (52, "")]
    items.append((53, items[0][1]))
    docs, want = [], set()
    for i in range(200):
        body = [rng.choice(words) for _ in range(rng.randrange(80))]
        if rng.random() < 0.4:
            k = rng.randrange(20)
            n = rng.choice([10, 14, 15, 16, 30])
            a = rng.randrange(40 - n)
            body[5:5] = items[k][1].upper().split()[a : a + n]
        docs.append((i, ", ".join(body)))
    docs += [(900, None), (901, ""), (902, items[3][1]), (902, items[3][1])]
    shingles = {}
    for k, t in items:
        w = leaks.words_of(t)
        for a in range(len(w) - 14):
            shingles.setdefault(tuple(w[a : a + 15]), set()).add(k)
    for i, t in docs:
        w = leaks.words_of(t)
        for a in range(len(w) - 14):
            want |= {(k, i) for k in shingles.get(tuple(w[a : a + 15]), ())}
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int").repartition(3)
    q = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, doc_id int")
    got = {(r["item_id"], r["doc_id"]) for r in leaks.leaks(d, q).collect()}
    assert got == want
    assert {(r["item_id"], r["doc_id"]) for r in leaks.leaks(d, q, block=90).collect()} == want
    plan = leaks.leaks(d, q, block=90)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the documents are scanned once
    near = {(r["item_id"], r["doc_id"]) for r in leaks.leaks(d, q, edits=1).collect()}
    other = {(r["item_id"], r["doc_id"]) for r in leaks.leaks(d, q, edits=1, block=90).collect()}
    assert near == other and near >= want
    long = spark.createDataFrame([(1, " ".join(["filler words here"] * 150_000) + " " + items[2][1] + " end" * 90_000)], "doc_id long, text string")
    assert {(r["item_id"], r["first_word"], r["end_word"]) for r in leaks.leaks(long, q).collect()} == {(2, 450_000, 450_040)}
    assert leaks.leaks(d.limit(0), q).count() == 0 and leaks.leaks(d, q.limit(0)).count() == 0


@pytest.mark.parametrize("edits", [1, 2])
def test_recall_at_an_edit_distance(edits):
    rng = np.random.default_rng(edits)
    base = rng.integers(0, 1 << 62, size=(400, 15)).astype(np.uint64)
    index = leaks.Index([(i, b) for i, b in enumerate(base)], 15, edits)
    changed = base.copy()
    for row in changed:
        for k in rng.choice(15, size=edits, replace=False):
            row[k] = rng.integers(0, 1 << 62)
    codes = changed.reshape(-1)
    hits = index.hits(codes, np.arange(0, len(codes), 15))
    assert len(hits) >= 0.95 * 400
    assert all(i == j for i, j in hits)


def test_within():
    a = np.array(list("kitten"))
    assert leaks.within(a, np.array(list("sitten")), 1) and not leaks.within(a, np.array(list("sitting")), 2) and leaks.within(a, np.array(list("sitting")), 3)


# --- mixing
def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, " ".join("word" for _ in range(rng.randrange(1, 200))), s, "x") for i, s in enumerate(["big"] * 700 + ["mid"] * 200 + ["small"] * 40 + ["none"] * 20 + [None] * 5)] + [(5000, "", "big", "x"), (5001, None, "mid", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string").repartition(4)
    sources = spark.createDataFrame([("big", "b", "x", 0.5, 1), ("mid", "m", "x", 0.3, 2), ("small", "s", "x", 0.2, 4), ("absent", "a", "x", 0.1, 3)], SOURCES)
    rows = mixing.mix(d, sources, block=200).collect()
    total = sum(r["tokens"] for r in rows)
    share = lambda rs, s: sum(r["tokens"] for r in rs if r["source"] == s) / sum(r["tokens"] for r in rs)
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(share(rows, s) - w) < 0.02
        first = sorted(rows, key=lambda r: (r["slot"], r["position"]))
        cut, n = 0, 0
        while n < total // 3:
            n += first[cut]["tokens"]
            cut += 1
        assert abs(share(first[:cut], s) - w) < 0.06
    most = {"big": 1, "mid": 2, "small": 4}
    seen = {}
    for r in rows:
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
        assert seen[r["doc_id"]] <= most[r["source"]]
    assert len({(r["doc_id"], r["pass"]) for r in rows}) == len(rows)
    got = {r["source"]: r for r in mixing.shares(d, sources).collect()}
    assert set(got) == {"big", "mid", "small"} and abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9
    assert mixing.mix(d.limit(0), sources).count() == 0 and mixing.shares(d, sources.limit(0)).count() == 0
    capped = {r["source"]: r["most_repeats"] for r in mixing.shares(d, sources, total=10**9).collect()}
    assert capped == most


def test_schedule_has_every_block(spark):
    """Also of a source with a very small share, whose points may come late."""
    for small in (0.00013, 0.0007, 0.0021):
        quota = {"a": (0.6, 10**7, 6 * 10**6, 1), "b": (0.4 - small, 10**7, int((0.4 - small) * 10**7), 1), "c": (small, 10**6, max(2000, int(small * 10**7)), 1)}
        got = {r["source"]: r["n"] for r in mixing.slots(spark, quota, 1000).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert all(got[s] >= -(-q[2] // 1000) for s, q in quota.items())


def test_sources_that_may_not_be_taken(spark):
    d = spark.createDataFrame([(1, "a b c", "x"), (2, "a b c", "y"), (3, "a b", "z")], "doc_id long, text string, source string")
    sources = spark.createDataFrame([("x", "x", "d", 0.5, 0), ("y", "y", "d", 0.3, None), ("z", "z", "d", 0.2, 2)], SOURCES)
    assert {r["source"] for r in mixing.mix(d, sources).collect()} == {"y", "z"}


# --- personal data
LEXICON = {"tovela": 1, "kasnor": 1, "marnick": 2, "holsted": 2}


def found(text, names=None):
    return [(text[a:b], kind) for a, b, kind in personal.mentions(text, names or personal.Names(LEXICON))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dear Tovela Marnick, hi", [("Tovela Marnick", "name")]), ("Signed, Tovela J. Marnick-Holsted", [("Tovela J. Marnick-Holsted", "name")]), ("Dr. Marnick, Tovela signed", [("Marnick, Tovela", "name")]),
        ("Marnick, Tovela Holsted", [("Tovela Holsted", "name")]), ("TOVELA MARNICK", [("TOVELA MARNICK", "name")]), ("Tovela came", []), ("a tovela marnick", []), ("x Tovela\nMarnick", [("Tovela\nMarnick", "name")]), ("Tovela. Marnick", []), ("with Tovela van der Marnick.", [("Tovela van der Marnick", "name")]), ("Tovela de la Marnick", [("Tovela de la Marnick", "name")]),
        ("to a.b+c@mail.example.net.", [("a.b+c@mail.example.net", "email")]), ("(x_1@lab.test)", [("x_1@lab.test", "email")]), ("r.x (at) mail[dot]example[dot]net)", [("r.x (at) mail[dot]example[dot]net", "email")]), ("z9 at example dot org, ok", [("z9 at example dot org", "email")]),
        ("q[at]post dot invalid. Next", [("q[at]post dot invalid", "email")]), ("ruth_59 @ mail[dot]example", [("ruth_59 @ mail[dot]example", "email")]), ("ARG0@node are", []), ("Follow @graphwatch for", []), ("met at 23:22.", []), ("write to Ab at c1@d.test", [("c1@d.test", "email")]), ("mailto:a@b.test", [("a@b.test", "email")]),
        ("on +49 (0)30 00002221, x", [("+49 (0)30 00002221", "phone")]), ("(890) 555-0157.", [("(890) 555-0157", "phone")]), ("+1 693 555 0182", [("+1 693 555 0182", "phone")]), ("890.555.0157.", [("890.555.0157", "phone")]), ("07700 900547", [("07700 900547", "phone")]), ("06-00002168", [("06-00002168", "phone")]), ("0031600000862", [("0031600000862", "phone")]),
        ("Version 2.2.0.10 was frozen on 2009-04-12.", []), ("range 949-438", []), ("195180195", []), ("791,325 triples", []), ("Ticket 191/10", []), ("section 555-12", []),
        ("is 666-80-9091, x", [("666-80-9091", "id_number")]), ("no. 00097.51.53.", [("00097.51.53", "id_number")]), ("000000-0000", [("000000-0000", "id_number")]), ("NX8790640.", [("NX8790640", "id_number")]), ("QQ 51 45 02 C,", [("QQ 51 45 02 C", "id_number")]), ("Z5ZZ51091", [("Z5ZZ51091", "id_number")]), ("00000513U", [("00000513U", "id_number")]),
        ("passport number is AB 12345678.", [("AB 12345678", "id_number")]),
        ("at 207 Quarrystone Street, Flat B, tel", [("207 Quarrystone Street, Flat B", "address")]), ("41 Old Fenwater St. #12 last", [("41 Old Fenwater St. #12", "address")]), ("Vive en Avda. de los Tilos Grises, n.º 74.", [("Avda. de los Tilos Grises, n.º 74", "address")]), ("naar Oude Kwartelstraat 43-B.", [("Oude Kwartelstraat 43-B", "address")]), ("lautet Mohnstr. 12a.", [("Mohnstr. 12a", "address")]), ("to 9 Old Fenwater Terrace. Dr. X", [("9 Old Fenwater Terrace.", "address")]), ("el camino verde 12", []), ("de weg in 12", []), ("the Road", []),
        ("", []), (None, []),
    ],
)
def test_mentions(text, want):
    assert [] == want if text is None else found(text) == want


@pytest.mark.parametrize("number", ["020 7946 0958", "612 345 678", "91 123 45 67", "06 12 34 56 78", "030 1234567", "0151 23456789", "0612345678", "600123456", "5305550107", "555 123 4567", "030 / 123 45 67", "12345678", "(020) 7946 0958"])
def test_phones_after_cues(number):
    for text in ("Tel. {}.", "my phone number is {}, thanks", "Telefonnummer: {}", "teléfono {} x", "telefoon {}!", "bereikbaar op 0{}" if number[0] in "69" and len(number) == 9 else "Fax:\n{}"):
        want = "0" + number if "0{}" in text else number
        assert found(text.format(number)) == [(want, "phone")]
    assert personal.redact(f"Tel. {number}.", personal.Names(LEXICON)) == "Tel. [PHONE]."


def test_phones_without_cues_and_what_is_none():
    for number in ("020 7946 0958", "612 345 678", "91 123 45 67", "06 12 34 56 78", "030 1234567", "0151 23456789", "0612345678", "555 123 4567"):
        assert found(f"at {number}, x") == [(number, "phone")]
    for text in ("call on 12.05.2019", "met 01.02.2019 10:30", "hotel 12345678", "€ 612 345 678", "call 12 000 000 people", "of 612 345 678 900", "600123456", "5305550107", "phone 1234567"):
        assert found(text) == []
    assert found("phone 020 7946 0958 / 0161 496 0000 x") == [("020 7946 0958", "phone"), ("0161 496 0000", "phone")]
    assert [k for _, k in found("phone or passport: 612345678")] == ["id_number"] and [k for _, k in found("passport by phone: 612345678")] == ["phone"]


def test_accounts_and_schemes():
    assert found("IBAN DE89 3704 0044 0532 0130 00, and") == [("DE89 3704 0044 0532 0130 00", "id_number")]
    assert found("GB82WEST12345698765432") == [("GB82WEST12345698765432", "id_number")] and found("ref GB83WEST12345698765432") == []
    assert found("card 4111 1111 1111 1111.") == [("4111 1111 1111 1111", "id_number")] and found("card 4111 1111 1111 1112.") == []
    assert found("see https://user:pw@host.org/x") == [] and found("ftp://me@host.example.org") == []
    long = "a" * 60 + "@" + ".".join(["part"] * 60) + ".org"
    assert found(f"to {long}, x") == [(long, "email")]


def test_learned_words_are_a_sized_set():
    """Of words that weren't learned hardly any is taken for one, however many were."""
    n = 20_000
    bits = bytearray((1 << 20) // 8)
    for i in range(n):
        for p in personal._positions(f"word{i}", personal.GIVEN, 1 << 20):
            bits[p >> 3] |= 1 << (p & 7)
    bits = bytes(bits)
    assert (1 << 20) >= personal.PER_WORD * n and all(personal._has(bits, f"word{i}", personal.GIVEN) for i in range(n))
    assert sum(personal._has(bits, f"other{i}", personal.GIVEN) for i in range(100_000)) <= 5


def test_names_with_other_capitals():
    names = personal.Names({**LEXICON, "şahin": 2, "o'brien": 2, "łucja": 1})
    for text in ("Łucja Şahin", "Tovela O'Brien"):
        assert found(f"met {text}, x", names) == [(text, "name")]


def test_redact():
    names = personal.Names(LEXICON)
    assert personal.redact("é Tovela Marnick: a@b.test, +1 693 555 0182", names) == "é [NAME]: [EMAIL], [PHONE]"
    assert personal.redact(None, names) is None and personal.redact("", names) == ""
    long = "plain words " * 20_000 + "Kasnor Holsted"
    assert personal.redact(long, names).endswith("[NAME]")


def test_names_are_learned(spark):
    texts = ["I met Tovela Unkfam today.", "Then Newgiv Marnick came.", "Dear Newgiv Unkfam, hello", "Dear Marnick, Tovela, hello", "Dear all. Dear you. Dear me", "", None, "Tovela Unkfam"]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, start_pos int, kind string")
    lexicon = spark.createDataFrame([("Tovela", "given"), ("Marnick", "family"), (None, "given")], "token string, kind string")
    got = sorted((r["doc_id"], r["start_pos"]) for r in personal.find_mentions(docs, lexicon).collect())
    assert got == [(0, 6), (1, 5), (2, 5), (3, 5), (7, 0)]
    assert {r["doc_id"]: r["text"] for r in personal.redacted(docs, lexicon).collect()}[2] == "Dear [NAME], hello"
    assert personal.find_mentions(docs.limit(0), lexicon).count() == 0
    assert personal.find_mentions(docs, lexicon.limit(0)).count() == 0
