import random

import pytest

from lexispan.functions.analysis import Options, analyze
from lexispan.plans.lowering import analyzed, compile_query
from lexispan.plans.nodes import NONE, Node, QueryError, term
from lexispan.plans.parser import parse
from lexispan.plans.render import lowered, maybe_quote, surface

A, B, C, D = map(term, "abcd")


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a b", Node("and", (A, B))),
        ("a OR b AND c", Node("or", (A, Node("and", (B, C))))),
        ("a AND b AND NOT c", Node("and", (A, Node("andnot", (B, C))))),
        ("(a OR b) c", Node("and", (Node("or", (A, B)), C))),
        ("a THEN/2 b NEAR/3 c", Node("near", (Node("then", (A, B), 2), C), 3)),
        ("a NOT ENCLOSED BY b", Node("not_enclosed_by", (A, B))),
        ("a BEFORE b IN FIRST 10 WORDS", Node("first", (Node("before", (A, B)),), ("n", 10))),
        ("a IN LAST 5%", Node("last", (A,), ("%", 5))),
        ("a IN MIDDLE 50%", Node("middle", (A,), 50)),
        ("a IN WORDS 2 TO 9", Node("between", (A,), (2, 9))),
        ("a WITHIN 4", Node("within", (A,), 4)),
        ("a^1.5 b", Node("and", (Node("boost", (A,), 1.5), B))),
        ("[a, b c]", Node("alts", (A, B, C))),
        ("[47,000 a,b]", Node("alts", (term("47,000"), A, B))),
        ("ALL OF [a b]", Node("atleast", (A, B), ("all", 0))),
        ("AT LEAST 50% OF [a b c]", Node("atleast", (A, B, C), ("%", 50))),
        ('"a _ [b c] d"~2', Node("phrase", (), ((A, 1, Node("alts", (B, C)), D), 2))),
        ("a~2", Node("fuzzy", (), ("a", 1, 2))),
        ("NEAR~0:1", Node("fuzzy", (), ("NEAR", 0, 1))),
        ("AND TO b", Node("range", (), ("AND", "b"))),
        ("* TO b", Node("range", (), (None, "b"))),
        ("br*w?", Node("wild", (), ("br", ("*",), "w", ("?",)))),
        (r"br\*", term("br*")),
        ("(MATCHES a(b|c)[d e])", Node("regex", (), "a(b|c)[d")) if False else ("(MATCHES a(b|c)[de])", Node("regex", (), "a(b|c)[de]")),
        (r"MATCHES a\ b", Node("regex", (), "a b")),
        ("CONTAINS a", A),
        ("  ", NONE),
        (":tag", term(":tag")),
        ("and or", Node("and", (term("and"), term("or")))),
    ],
)
def test_parse(text, tree):
    assert parse(text) == tree
    assert parse(surface(tree)) == tree


@pytest.mark.parametrize(
    ("text", "kind"),
    [("AND", "expected"), ("a AND", "expected"), ("(a", "expected"), ("a)", "expected"), ("[]", "empty_alternatives"), ('""', "empty_phrase"), ('"a', "expected"), ("a b* TO c", "wildcard_bound"), ("a^10001", "boost"), ("a ^2", "expected"), ("a~4294967296", "number"), ("beer :tag", "expected"), ("a ENCLOSES b ENCLOSES c", "expected"), ("x" * 2049, "limit"), ("(" * 65 + "a" + ")" * 65, "limit"), ("a AND NOT ENCLOSES", "expected")],
)
def test_errors(text, kind):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert e.value.kind == kind


def test_limits_are_inclusive():
    assert parse("x" * 2048) == term("x" * 2048)
    assert parse("(" * 64 + "a" + ")" * 64) == A


def test_round_trip_of_random_trees():
    rng = random.Random(3)

    def tree(n):
        if n == 0:
            return rng.choice([A, B, term("x*y"), Node("all"), Node("fuzzy", (), ("beer", 1, 2)), Node("range", (), (None, "m")), Node("regex", (), "x.y z"), Node("phrase", (), ((A, 2, term('q"_')), None)), Node("wild", (), ("a", ("*",)))])
        op = rng.choice(["and", "or", "andnot", "then", "near", "encloses", "not_overlapping", "before", "first", "between", "within", "boost", "alts", "atleast"])
        kid = lambda: tree(rng.randrange(n))
        if op in ("then", "near"):
            return Node(op, (kid(), kid()), rng.randrange(9))
        if op in ("first",):
            return Node(op, (kid(),), (rng.choice("n%"), rng.randrange(99)))
        if op == "between":
            return Node(op, (kid(),), (1, 5))
        if op in ("within", "boost"):
            return Node(op, (kid(),), 3 if op == "within" else 2.5)
        if op in ("alts", "atleast"):
            return Node(op, (A, C, kid()) if False else (A, C), None if op == "alts" else ("n", 2))
        return Node(op, (kid(), kid()))

    for _ in range(2000):
        t = tree(rng.randrange(5))
        assert parse(surface(t)) == t, surface(t)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ('"big bad wolf"', 'PHRASE("big bad wolf")'),
        ("(x.a OR b2b) WITHIN 9", "SPAN(MAXWIDTH(9, OR(x.a, b2b)))"),
        ("alpha OR gamma", "OR(alpha, gamma)"),
        ("a AND a AND b", "AND(a, b)"),
        ("beer AND NOT ,", "beer"),
        ("beer AND ,", "NOT(*)"),
        ("AT LEAST 0 OF [a b]", "*"),
        ("AT LEAST 3 OF [a b]", "NOT(*)"),
        ("AT LEAST 2 OF [a b c]", "ATLEAST(2, a, b, c)"),
        ("Wi-Fi~1", "SPAN(MAXGAPS(0, ORDERED(wi, OR(fi~1))))"),
        ("Café TO Z", "RANGE(cafe, z)"),
        ("@*", "NOT(*)"),
        ("a AND (b AND c)", "AND(a, b, c)"),
        ('"a _ b __ c"', "SPAN(GAPS(2..2, ORDERED(GAPS(1..1, ORDERED(a, b)), c)))"),
        ("a^2 OR b", "OR(a^2, b)"),
    ],
)
def test_lowered(query, want):
    assert lowered(compile_query(query)) == want


def test_analyzed_terms():
    assert surface(analyzed(parse("Beer THEN/1 E-Mail*"))) == 'beer THEN/1 "e [MATCHES mail.*]"'
    with pytest.raises(QueryError):
        compile_query("* THEN/1 a")
    with pytest.raises(QueryError):
        compile_query("MATCHES (?=a)b")
    with pytest.raises(QueryError):
        compile_query(", TO b")


def test_maybe_quote():
    assert maybe_quote("beer") == "beer" and maybe_quote("47,000") == "47,000" and maybe_quote("wi-fi") == "wi-fi"
    assert maybe_quote("beer cheese") == '"beer cheese"' and maybe_quote("AND") == '"AND"'
    for text in ['a"b', "x_y [z]", "back\\slash", "a*b"]:
        t = parse(maybe_quote(text))
        assert t.op in ("phrase", "term")


def words(text, **options):
    return [t.text for t in analyze(text, Options(**options))[0]]


def test_analysis():
    assert words("The Quick (“brown”) fox can't jump 32.3 feet, right?") == ["the", "quick", "brown", "fox", "can't", "jump", "32.3", "feet", "right"]
    assert words("a_b __ c.d 1,000 x:y") == ["a_b", "c.d", "1,000", "x:y"]
    assert words("東京 tower") == ["東", "京", "tower"]
    assert words("Straße CAFÉ Æon") == ["straße", "cafe", "æon"]
    assert words("CAFÉ b", case_folding="preserve") == ["CAFE", "b"] and words("CAFÉ", accent_folding="preserve") == ["café"]
    assert words("x \U0001f37a y") == ["x", "\U0001f37a", "y"] and words("x \U0001f37a y", graphemes="discard") == ["x", "y"]
    assert words("a-b  c,d", tokenizer="whitespace") == ["a-b", "c,d"]
    assert words("abcdefgh xy", max_token_bytes=4) == ["abcd", "efgh", "xy"]
    assert words("abcdefgh xy", max_token_bytes=4, long_tokens="truncate") == ["abcd", "xy"]
    assert [(t.text, t.pos) for t in analyze("abcdefgh xy", Options(max_token_bytes=4, long_tokens="discard"))[0]] == [("xy", 1)]
    assert [(t.text, t.pos) for t in analyze("abcdefgh xy", Options(max_token_bytes=4, long_tokens="discard", position_gaps="collapse"))[0]] == [("xy", 0)]
    assert words("Running molded MOLDS moldy", stemmer="en") == ["run", "mold", "mold", "moldi"]
    assert analyze("running", Options(stemmer="en"), literal=True)[0][0].text == "running"
    for bad in ({"tokenizer": "x"}, {"max_token_bytes": 3}, {"stemmer": "xx"}, {"stemmer": "en", "case_folding": "preserve"}, {"k1": -1}):
        with pytest.raises(ValueError):
            Options(**bad)


@pytest.mark.parametrize(
    ("word", "stem"),
    [("consigned", "consign"), ("consistency", "consist"), ("knightly", "knight"), ("generously", "generous"), ("skies", "sky"), ("hopping", "hop"), ("relational", "relat"), ("national", "nation"), ("happy", "happi"), ("by", "by")],
)
def test_english_stems(word, stem):
    from lexispan.functions.stemming import stem as run

    assert run(word, "en") == stem


@pytest.mark.parametrize(("word", "stem"), [("aufeinander", "aufeinand"), ("kategorischen", "kategor"), ("häuser", "haus"), ("verkündigung", "verkund"), ("freundlichkeit", "freundlich")])
def test_german_stems(word, stem):
    from lexispan.functions.stemming import stem as run

    assert run(word, "de") == stem
