import random
from itertools import permutations, product

import numpy as np
import pytest

from lexispan.functions.analysis import DEFAULT, Options, analyze
from lexispan.operators import matching, spans
from lexispan.operators.highlighting import highlight, highlight_ansi
from lexispan.operators.scoring import TermScorer, idf
from lexispan.plans.lowering import compile_query
from lexispan.plans.nodes import Node, term


def least(found):
    return sorted(s for s in set(found) if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in found))


def antichain(rng, n=3):
    return [(s, e, 0 if s == e else None) for s, e in least([(a, a + rng.randrange(3)) for a in (rng.randrange(12) for _ in range(rng.randrange(n + 1)))])]


def test_operators_agree_with_their_definitions():
    rng = random.Random(1)
    for _ in range(4000):
        parts = [antichain(rng) for _ in range(rng.choice([2, 3]))]
        chains = [c for c in product(*parts) if all(x[1] < y[0] for x, y in zip(c, c[1:], strict=False))]
        assert [(s, e) for s, e, _ in spans.ordered(parts)] == least([(c[0][0], c[-1][1]) for c in chains])
        for s, e, gaps in spans.ordered(parts):
            fits = [c for c in chains if (c[0][0], c[-1][1]) == (s, e)]
            assert gaps in [e - s + 1 - sum(x[1] - x[0] + 1 for x in c) for c in fits]
        assert [(s, e) for s, e, _ in spans.union(parts)] == least([x[:2] for p in parts for x in p])
        a, b = parts[:2]
        assert [(s, e) for s, e, _ in spans.hulls(a, b)] == least([(min(x[0], y[0]), max(x[1], y[1])) for x in a for y in b])
        inside, meets = lambda x, y: y[0] <= x[0] and x[1] <= y[1], lambda x, y: x[0] <= y[1] and y[0] <= x[1]
        for op, test in (("encloses", lambda x, y: inside(y, x)), ("enclosed_by", inside), ("overlapping", meets), ("before", lambda x, y: y[0] > x[0]), ("after", lambda x, y: y[0] < x[0])):
            want = [x for x in a if any(test(x, y) for y in b)]
            assert spans.related(op, a, b) == want
            if op not in ("before", "after"):
                assert spans.related("not_" + op, a, b) == [x for x in a if x not in want]


def test_gap_limits_apply_after_minimality():
    a, b = [(1, 8, 0), (4, 10, 0), (11, 12, 0)], [(4, 6, 0), (9, 12, 0)]
    found = spans.union([spans.ordered(list(p)) for p in permutations([a, b])])
    assert [s for s in found if s[2] is not None and s[2] <= 3] == []


def test_same_child_takes_different_intervals():
    a = term("a")
    at = {a: [0, 2, 7]}
    assert [(s, e) for s, e, _ in spans.evaluate(Node("unordered", (a, a)), at.__getitem__, 8)] == [(0, 2), (2, 7)]
    assert [(s, e) for s, e, _ in spans.evaluate(Node("maxgaps", (Node("unordered", (a, a)),), 1), at.__getitem__, 8)] == [(0, 2)]


def test_long_chains_stay_small():
    node = term("a")
    for _ in range(66):
        node = Node("maxgaps", (Node("unordered", (node, term("b"))),), 3)
    assert spans.evaluate(node, lambda leaf: [0, 1, 2], 3) == []


def found(query, text, options=DEFAULT):
    tokens, _ = analyze(text, options)
    node = compile_query(query, options)
    terms = [None] * (tokens[-1].pos + 1 if tokens else 0)
    for t in tokens:
        terms[t.pos] = t.text
    return matching.holds(node, terms)


@pytest.mark.parametrize(
    ("query", "text", "want"),
    [
        ("beer", "craft beer", True),
        ("br* AND NOT bear", "brew brewer beer", True),
        ('"craft _ festival"', "craft beer festival", True),
        ('"craft festival"', "craft beer festival", False),
        ('"craft festival"~1', "craft beer festival", True),
        ("festival NEAR/1 craft", "craft beer festival", True),
        ("festival THEN/1 craft", "craft beer festival", False),
        ("beer NEAR/5 beer", "beer", False),
        ("beer NEAR/5 beer", "beer and beer", True),
        ("a BEFORE b", "b x a", False),
        ("a AFTER b", "b x a", True),
        ("(a THEN/9 d) ENCLOSES b", "a b c d", True),
        ("(a THEN/9 d) NOT ENCLOSES b", "a b c d", False),
        ("b ENCLOSED BY (a THEN/9 d)", "a b c d", True),
        ("c IN FIRST 2 WORDS", "a b c d", False),
        ("c IN LAST 50%", "a b c d", True),
        ("b IN MIDDLE 50%", "a b c d", True),
        ("a IN WORDS 1 TO 1", "a b", True),
        ("(a AND d) WITHIN 3", "a b c d", False),
        ("AT LEAST 2 OF [a x b]", "a b", True),
        ("beeer~1", "beer", True),
        ("xeer~1", "beer", False),
        ("xeer~0:1", "beer", True),
        ("ale TO cat", "beer", True),
        ("MATCHES be.", "beer", False),
        ("*", "", False),
        ("*", "x", True),
        ("AT LEAST 0 OF [a b] IN FIRST 9 WORDS", "a", False),
    ],
)
def test_queries(query, text, want):
    assert found(query, text) is want


def test_scores_have_the_published_bits():
    s = TermScorer(idf(100, 10), 0.7, 1.2, 0.75, np.float32(80))
    for tf, length, bits in [(1, 1, 1076504444), (5, 17, 1078667167), (20, 80, 1079147600), (42, 250, 1078943558), (2**32 - 1, 1024, 1079969742)]:
        assert int(np.float32(s.score(tf, length)).view(np.uint32)) == bits


def test_highlights():
    q = compile_query
    assert highlight("Beer and wine", q("beer"), "[", "]") == "[Beer] and wine"
    assert highlight("a beer beer", q("beer OR a"), "[", "]") == "[a] [beer] [beer]"
    assert highlight("the craft beer", q('"craft beer"'), "[", "]") == "the [craft beer]"
    en = Options(stemmer="en")
    assert highlight("Jumping, jumped", compile_query("jump", en), options=en) == "<b>Jumping</b>, <b>jumped</b>"
    assert highlight("x < beer", q("beer~1"), "<i title='$QUERY_PART' class=$QUERY_LABEL>", "</i>") == "x < <i title='beer~1' class=beer-1>beer</i>"
    assert "\x1b[" in highlight_ansi("a beer", q("beer")) and highlight_ansi("a\nred", q("red")).endswith("\x1b[1;31mred\x1b[0m")
    assert highlight("wine", q("beer OR wine AND x"), "[", "]") == "[wine]"


@pytest.mark.parametrize(
    ("query", "want"),
    [("a AND b", {"a"}), ("a OR b", {"a", "b"}), ("a OR b*", None), ("NOTE AND NOT b", {"note"}), ('"a b" OR c', {"a", "c"}), ("AT LEAST 2 OF [a b c]", {"a", "b", "c"}), ("*", None), ("a* NEAR/2 b IN LAST 5%", {"b"}), ("AT LEAST 0 OF [a b] WITHIN 3", None)],
)
def test_anchors_are_necessary(query, want):
    got = matching.anchors(compile_query(query))
    assert (set(got) if got is not None else None) == want
