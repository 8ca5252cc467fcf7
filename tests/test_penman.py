import itertools
import random

import pytest

from graphmill.functions import linear, match, penman, repair

GRAPH = '(w / want-01\n   :ARG0 (c / cat)\n   :ARG1 (s / sleep-01\n            :ARG0 c))'


def random_graph(rng, n):
    names = [f"v{i}" for i in range(n)]
    edges = [(names[rng.randrange(i)], rng.choice([":ARG0", ":op1", ":mod-of"]), names[i]) for i in range(1, n)]
    extra = [(rng.choice(names), ":quant", str(rng.randrange(9))) for _ in range(rng.randrange(3))]
    return [t for i, v in enumerate(names) for t in [(v, penman.INSTANCE, rng.choice(["cat", "go-01"]))] + [e for e in edges if e[0] == v]] + extra


def test_decode_in_text_order():
    g = penman.decode(GRAPH)
    assert g.top == "w"
    assert g.triples == [("w", ":instance", "want-01"), ("w", ":ARG0", "c"), ("c", ":instance", "cat"), ("w", ":ARG1", "s"), ("s", ":instance", "sleep-01"), ("s", ":ARG0", "c")]


def test_inverse_roles():
    g = penman.decode("(d2 / dog :ARG0-of (b1 / bark-01))", invert=True)
    assert ("b1", ":ARG0", "d2") in g.triples
    assert ("c", ":consist-of", "w") in penman.decode("(c / cup :consist-of (w / wood))", invert=True).triples


def test_backoff_prints_from_its_first_source():
    assert penman.encode(penman.BACKOFF_TRIPLES, indent=None) == "(d2 / dog :ARG0-of (b1 / bark-01))"


@pytest.mark.parametrize("seed", range(40))
def test_encode_decode_round_trip(seed):
    t = random_graph(random.Random(seed), 1 + seed % 9)
    text = penman.encode(t, t[0][0])
    assert sorted(penman.decode(text, True).triples) == sorted((b, r[:-3], a) if r.endswith("-of") and r != ":quant" else (a, r, b) for a, r, b in t)
    assert penman.is_graph(text)


@pytest.mark.parametrize(
    ("text", "good"),
    [
        (GRAPH, True), ("(a / b)", True), ("(a/b :op1 \"x (y) :z\" :polarity - :ARG0 a)", True), ('(a / b :op1 "")', True), (" (a / b)\n", True),
        ("", False), (None, False), ("()", False), ("(a / )", False), ("(a / b", False), ("(a / b))", False), ("(a / b) (c / d)", False), ("x (a / b)", False), ("(a / b) done", False),
        ("(a / b :ARG0)", False), ("(a / b :ARG0 :ARG1 c)", False), ('(a / b :op1 "x)', False), ("(a / b c)", False), ("(a b)", False), ("(/ b)", False), ("(a / b / c)", False),
        ("(a / b : c)", False), ("(a / b :ARG0 ((c / d)))", False), ('(a / b :op1 "x" "y")', False), ("a / b", False), ("(a / b :ARG0 (c / d)) :ARG9", False),
    ],
)
def test_is_graph(text, good):
    assert penman.is_graph(text) is good


def test_is_graph_deep_text():
    n = 20_000
    assert penman.is_graph("(a / b :c " * n + "(a / b)" + ")" * n)
    assert len(penman.decode("(a / b :c " * 2000 + "(a / b)" + ")" * 2000).triples) == 2001 + 2000


def test_decode_errors():
    for bad in ("", "(a / b", "(a / b))", "x", "(a / b) (c / d)", "(a / b (c / d))"):
        with pytest.raises(penman.DecodeError):
            penman.decode(bad)


def test_encode_needs_a_connected_graph():
    with pytest.raises(penman.DecodeError):
        penman.encode([("a", ":instance", "b"), ("c", ":instance", "d")])


def test_linearize():
    want = "( <pointer:0> want-01 :ARG0 ( <pointer:1> cat ) :ARG1 ( <pointer:2> sleep-01 :ARG0 <pointer:1> ) )"
    assert " ".join(linear.linearize(GRAPH)) == want
    assert linear.linearize('(a / go-02 :polarity - :op1 "x – y")') == ["(", "<pointer:0>", "go-02", ":negation", ":op1", '"x - y"', ")"]
    assert '"x' in linear.linearize('(a / b :op1 "x y")', tear_literals=True)


@pytest.mark.parametrize("seed", range(30))
def test_round_trip_through_tokens(seed):
    t = random_graph(random.Random(seed), 1 + seed % 9)
    text = penman.encode(t, t[0][0])
    back = repair.decode_tokens(linear.linearize(text))
    assert back.status == repair.OK
    a, b = penman.decode(penman.encode(back.triples), True), penman.decode(text, True)
    c = match.match(a.triples, b.triples, a.top, b.top)
    assert c.matched == c.n_pred == c.n_gold


def _same(tokens, text):
    d = repair.decode_tokens(tokens if isinstance(tokens, list) else tokens.split())
    assert d.status == repair.OK
    assert sorted(d.triples) == sorted(penman.decode(text).triples)


def test_repairs():
    whole = "(w / want-01 :ARG0 (c / cat))"
    _same("( <pointer:0> want-01 :ARG0 ( <pointer:1> cat", whole)
    _same("( <pointer:0> want-01 :ARG0 ( <pointer:1> cat ) ) ) )", whole)
    _same("( <pointer:0> want-01 / want-02 :ARG0 ( <pointer:1> cat ) )", whole)
    _same("( <pointer:0> want-01 : ARG0 ( <pointer:1> cat ) )", whole)
    _same("( <pointer:0>want-01 :ARG0 ( <pointer:1>cat ) )", whole)
    _same("<s> ( <pointer:0> want-01 :ARG0 ( <pointer:1> cat ) ) </s>", whole)
    _same("( <pointer:0> want-01 :ARG1 :ARG0 ( <pointer:1> cat ) :ARG2 )", whole)
    _same("( <pointer:0> want-01 :time 10:30 :quant 303.3 :mode imperative )", '(w / want-01 :time "10:30" :quant 303.3 :mode imperative)')


def test_second_definition_is_a_new_variable():
    d = repair.decode_tokens("( a / and :op1 ( b / cat ) :op2 ( b / dog :mod b ) )".split())
    assert ("z1000", ":instance", "dog") in d.triples
    assert ("z1000", ":mod", "z1000") in d.triples


def test_names_of_variables_count_by_letter():
    d = repair.decode_tokens("( <pointer:0> and :op1 ( <pointer:1> apple ) :op2 ( <pointer:2> ant ) )".split())
    assert [t[0] for t in d.triples if t[1] == ":instance"] == ["a", "a2", "a3"]


@pytest.mark.parametrize("tokens", [[], ["( "], "( <pointer:0> want-01 :ARG0 <pointer:7> )".split(), "( <pointer:0> want-01 :ARG0 <pointer:0>".split(), None])
def test_backoff(tokens):
    assert repair.decode_tokens(tokens).status == repair.BACKOFF
    assert repair.decode_tokens(tokens).triples == penman.BACKOFF_TRIPLES


def test_parts_are_connected():
    t = [("a", ":instance", "x"), ("b2", ":instance", "y"), ("b", ":instance", "z"), ("b2", ":mod", "b")]
    new, status = repair.connect(t)
    assert status == repair.FIXED
    assert new[:2] == [("a4", ":op1", "a"), ("a4", ":op2", "b")]
    penman.encode(new, "a4")
    with pytest.raises(penman.DecodeError):
        repair.connect(t, strict_names=True)


def test_decode_text_has_three_states():
    assert repair.decode_text(GRAPH).status == repair.OK
    assert repair.decode_text(GRAPH[:-1]).status == repair.FIXED
    assert repair.decode_text("sorry, no graph").status == repair.BACKOFF
    assert repair.decode_text(None).status == repair.BACKOFF


def test_delinearize():
    d = linear.delinearize
    assert d("<rel> <pointer:6> take-into-ac count-04 :ARG0 <pointer:1> </rel>") == "( <pointer:6> take-into-account-04 :ARG0 <pointer:1> )"
    assert d("<rel> <pointer:0> go-02 :negation </rel>") == "( <pointer:0> go-02 :polarity - )"
    assert d(":name <rel> <pointer:1> name :op1 <lit> New York </lit> </rel>") == ':name ( <pointer:1> name :op1 "New_York" )'
    assert d(":quant -54 7 </rel>") == ":quant -547 )"
    assert d(":value <lit> http : // a . com / b </lit>".replace(" : // a . com / b", "://a.com/ b")) == ':value "http://a.com/b"'
    assert d(":op1 0 <rel> <pointer:3> cat </rel>") == ":op10 ( <pointer:3> cat )"
    assert d(":ARG0 -of <rel> <pointer:3> cat </rel>") == ":ARG0-of ( <pointer:3> cat )"
    assert d(":op10 :year1990", roles=(":op1", ":op10", ":year", ":year2")) == ":op10 :year 1990"
    assert d("") == ""


def test_split_except_quotes():
    assert linear.split_except_quotes('<rel><pointer:0>end-01 "25 bis" x</rel>') == ["<rel>", "<pointer:0>", "end-01", '"25 bis"', "x", "</rel>"]


def test_tagged():
    assert linear.tagged('( <pointer:0> name :op1 "New_York" )', ()) == "<rel><pointer:0> name :op1<lit> New York</lit></rel>"
    assert "a_b.txt" in linear.tagged('"a_b.txt"', ())
    assert linear.tagged("( x :quant -70 :mod y )", (":quant", ":mod", "-70")) == "<rel> x:quant -70:mod y</rel>"


def test_vocabulary_tokens():
    v = {":ARG0", ":prep-", "want-01", "<pointer:0>", "Ġcat"}
    got = linear.vocabulary_tokens(["(", "<pointer:0>", "want-01", ":ARG0-of", ":prep-by", "cat", "run-02", '"a_b"', ")"], v, lambda s: s.split() or [s], "Ġ")
    assert got == ["<rel>", "<pointer:0>", "want-01", ":ARG0", "-of", ":prep-", "by", "Ġcat", "run", "-02", "<lit>", "a", "b", "</lit>", "</rel>"]


@pytest.mark.parametrize("seed", range(25))
def test_match_invariants(seed):
    rng = random.Random(seed)
    a, b = random_graph(rng, 1 + seed % 8), random_graph(rng, 1 + (seed * 3) % 8)
    same = match.match(a, a)
    assert same.matched == same.n_pred == same.n_gold
    names = {f"v{i}": f"x{9 - i}" for i in range(9)}
    renamed = [(names[s], r, names.get(t, t)) for s, r, t in a]
    assert match.match(renamed, a).matched == same.n_gold
    ab, ba = match.match(a, b), match.match(b, a)
    assert (ab.n_pred, ab.n_gold) == (ba.n_gold, ba.n_pred)
    if ab.proved and ba.proved:
        assert ab.matched == ba.matched
    assert match.scores(match.Counts(0, 0, 0)) == (0.0, 0.0, 0.0)


def brute_match(a, b):
    """The best of all mappings of variables."""
    x, y = match._Parts(a, None), match._Parts(b, None)
    if len(x.vars) > len(y.vars):
        x, y = y, x
    best = 0
    for to in itertools.permutations(range(len(y.vars)), len(x.vars)):
        score = sum(sum((x.unary[i] & y.unary[j]).values()) for i, j in enumerate(to))
        score += sum(min(k, y.edges.get((r, to[s], to[t]), 0)) for (r, s, t), k in x.edges.items())
        best = max(best, score)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_match_against_all_mappings(seed):
    rng = random.Random(100 + seed)
    for _ in range(5):
        a, b = random_graph(rng, rng.randrange(1, 7)), random_graph(rng, rng.randrange(1, 7))
        c = match.match(a, b)
        assert c.proved and c.matched == brute_match(a, b)
