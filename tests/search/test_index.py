import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lexispan import catalogue
from lexispan.functions.analysis import Options, native_terms, terms, terms_of
from lexispan.index import BindingError, SearchIndex, same_analysis, search_join, sum_scores
from lexispan.operators import matching
from lexispan.sql import register, rewrite


def ids(df):
    return sorted(r[0] for r in df.collect())


def index(spark, rows, options=Options(), where=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows, 1)], "id int, body string")
    return SearchIndex("ix", df, "id", "body", where, options)


def test_matches(spark):
    ix = index(spark, ["craft beer", "wine", "beer festival", None, "", "..."])
    assert ids(ix.search("beer").rows()) == [1, 3]
    assert ids(ix.search("*").rows()) == [1, 2, 3]
    assert ids(ix.search("* AND NOT beer").rows()) == [2]
    assert ids(ix.search("beer", "wine").rows()) == [1, 2, 3]
    assert [r[0] for r in ix.df.select(ix.match("beer")).collect()] == [True, False, True, None, False, False]
    assert ids(ix.df.where(ix.match_any([None, "wine"]))) == [2] and ids(ix.df.where(ix.match_any([]))) == []
    assert ids(ix.df.where(ix.match_all(["craft", "beer"]))) == [1]


def test_partial_index_and_stemmer(spark):
    ix = index(spark, ["molded", "MOLDS", "moldy", "wine"], Options(stemmer="en"), "id <> 2")
    assert ids(ix.search("mold").rows()) == [1]
    with pytest.raises(BindingError):
        same_analysis(ix, index(spark, ["x"]))


def test_published_scores(spark):
    ix = index(spark, ["rare", "rare rare rare", "common"])
    assert [r.id for r in ix.search("rare").topk(5, full=True).collect()] == [2, 1]
    fruit = index(spark, ["apple banana cherry", "apple banana banana cherry", "apple"])
    best = fruit.search("banana").max_score().first()[0]
    assert best == max(r.score for r in fruit.search("banana").score(full=True).collect())
    dense = index(spark, ["common rare", "common", "common"])
    assert [(r.term) for r in dense.search("common OR rare").inspect(0.5).collect()] == ["rare"]
    got = {r.id: r.score for r in dense.search("common").score().collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0}


def test_sum_of_indexes_is_null_without_a_match(spark):
    df = spark.createDataFrame([(1.5, None), (None, None), (1.0, 2.0)], "a float, b float")
    assert [r[0] for r in df.select(sum_scores(F.col("a"), F.col("b"))).collect()] == [1.5, None, 3.0]


TEXTS = ["The Café isn't 1,000 km x:y a_b __ z", "Straße ÆON naïve", "東京 tower", "ok \U0001f37a µm ª", "w" * 600, None, "", "a" * 130 + " b"]


@pytest.mark.parametrize("options", [Options(), Options(tokenizer="whitespace"), Options(case_folding="preserve"), Options(accent_folding="preserve"), Options(max_token_bytes=8, long_tokens="discard"), Options(max_token_bytes=8, position_gaps="collapse", long_tokens="discard"), Options(max_token_bytes=16)])
def test_native_and_general_analysis_agree(spark, options):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert [r[0] for r in df.select(terms(F.col("t"), options)).collect()] == [terms_of(t, options) for t in TEXTS]
    if options.max_token_bytes == 256:
        assert [r[0] for r in df.limit(2).select(native_terms(F.col("t"), options)).collect()] == [terms_of(t, options) for t in TEXTS[:2]]


def test_columns_agree_with_python(spark):
    texts = ["craft beer festival welcomes local beer fans", "brew brewer beer bear cat cot dog", "alpha beta gamma delta epsilon", "", "beer"]
    ix = index(spark, texts)
    for q in ["beer~1", "br*", "a TO c", '"beer festival"', '"craft _ festival"', "craft NEAR/2 festival", "beer THEN/4 beer", "(craft THEN/3 welcomes) ENCLOSES beer", "AT LEAST 2 OF [cat beer zzz] WITHIN 4", "beta IN FIRST 50% AND NOT beer", "fans IN LAST 1 WORDS", "MATCHES b.*r NEAR/1 c*"]:
        node = ix.compile(q)
        assert ids(ix.search(q).rows()) == [i for i, t in enumerate(texts, 1) if matching.holds(node, terms_of(t, Options()))], q


def test_intervals(spark):
    ix = index(spark, ["brew beer brewing beer"])
    assert sorted((r.s, r.e) for r in ix.search("brew* THEN/1 beer").intervals().collect()) == [(0, 1), (2, 3)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plain_rows_stay_in_the_jvm(spark):
    """One branch has the plain texts and no Python; each branch analyzes once, whatever the query asks of the terms."""
    for q in ['"a b" OR a NEAR/2 c', "a AND NOT b", "a~1 OR b*", "a THEN/9 b"]:
        text = plan(index(spark, ["a b c"]).search(q).rows().select("id"))
        assert text.count("ArrowEvalPython") == 1 and text.count("regexp_extract_all(") == 1, q
        usual, other = text[text.index("Union") :].split("regexp_extract_all(")[1], text[text.index("ArrowEvalPython") :]
        assert "ArrowEvalPython" not in usual.split("Generate")[0] and "NOT _plain" in other
    scored = plan(index(spark, ["a b c"]).search("a OR b").score(full=True))
    assert scored.count("ArrowEvalPython") == 1 and scored.count("regexp_extract_all(") == 1
    spans = plan(index(spark, ["a b c"]).search("(a THEN/3 c) ENCLOSES b").rows())
    assert spans.count("regexp_extract_all(") == 1


def test_prefilter_loses_nothing(spark):
    texts = ["Bèer x", "beér", "xbeery", "BEER wine", "wine", "東京 beer", "be er", "a_beer beer", "b" * 200 + " beer"]
    ix = index(spark, texts)
    for q in ["beer", "beer OR wine", "beer AND wine", "be*", "*ee*", "b?er", "beer~1", "AT LEAST 1 OF [beer wine]", "wine AND NOT beer", "* AND NOT beer", "beer THEN/1 wine", "(beer OR wine) IN FIRST 1 WORDS"]:
        node = ix.compile(q)
        assert ids(ix.search(q).rows()) == [i for i, t in enumerate(texts, 1) if matching.holds(node, terms_of(t, Options()))], q


def test_near_in_long_documents(spark):
    """Every pair of places is not looked at: 20,000 of each word take no longer than one pass."""
    ix = index(spark, ["a b " * 20000, "a " + "x " * 30 + "b", "b " + "x " * 20 + "a", "a " * 3])
    assert ids(ix.search("a NEAR/25 b").rows()) == [1, 3]
    assert ids(ix.search("a THEN/40 b").rows()) == [1, 2]
    assert ids(ix.search("a NEAR/0 a").rows()) == [4]
    assert ids(ix.search('"a a a"').rows()) == [4]


def test_join_driven_queries(spark):
    docs = spark.createDataFrame([(1, "craft beer"), (2, "wine"), (3, "beer and wine"), (4, None)], "id int, body string")
    q = spark.createDataFrame([("beer",), ("wine",), ("beer wine",), (None,)], "query string")
    got = sorted((r.id, r.query) for r in search_join(docs, "body", q, "query").collect())
    assert got == [(1, "beer"), (2, "wine"), (3, "beer"), (3, "beer wine"), (3, "wine")]


def test_sql(spark):
    assert rewrite("SELECT 'a ==> b' FROM t WHERE lower(x) ==> 'q' -- y ==> z") == "SELECT 'a ==> b' FROM t WHERE search_match(lower(x), 'q') -- y ==> z"
    register(spark)
    row = spark.sql("SELECT search_match('Craft Beer', 'beer') a, ql_lowered('x OR x') b, maybe_quote('a b') c, tokenize('A b') d, highlight('a b', '[', ']', 'b') e, highlight('a b', '[', ']', '(') f").first()
    assert tuple(row) == (True, "x", '"a b"', ["a", "b"], "a [b]", "a b")


def test_sql_operands_and_arrays(spark):
    assert rewrite("SELECT 1 FROM t WHERE lower(trim(x)) ==> concat('a', f(y)) AND z==>ANY(array('p', q)) OR (a.b) ==> ALL (c)") == (
        "SELECT 1 FROM t WHERE search_match(lower(trim(x)), concat('a', f(y))) AND search_match_any(z, array('p', q)) OR search_match_all((a.b), c)"
    )
    with pytest.raises(ValueError):
        rewrite("==> 'x'")
    register(spark)
    row = spark.sql("SELECT search_match_any('a b', array('a', NULL)) a, search_match_any('a b', array('c', NULL)) b, search_match_all('a b', array('c', NULL)) c, search_match_all('a b', array('a', NULL)) d, search_match_any('a b', array()) e, search_match_all('a', CAST(NULL AS array<string>)) f").first()
    assert tuple(row) == (True, None, False, None, False, None)


def test_sql_scores(spark):
    from lexispan.sql import search_sql

    ix = index(spark, ["rare", "rare rare rare", "common", "common", "common"])
    rows = search_sql(spark, "SELECT id, full_score FROM search_scores('ix', 'rare') WHERE full_score = max_score('ix', 'rare')", indexes=[ix]).collect()
    assert [r.id for r in rows] == [2]
    assert [r.term for r in search_sql(spark, "SELECT term FROM score_inspect('ix', 'rare OR common')", indexes=[ix]).collect()] == []
    with pytest.raises(BindingError):
        search_sql(spark, "SELECT * FROM search_scores('other', 'x')", indexes=[ix])


def test_ansi_colours():
    from lexispan.operators.highlighting import color, highlight_ansi
    from lexispan.plans.lowering import compile_query

    mark = lambda text, q: highlight_ansi(text, compile_query(q))
    assert mark("a red b", "red") == "a \x1b[1;31mred\x1b[0m b" and mark("grey", "grey") == "\x1b[1;90mgrey\x1b[0m"
    assert color(["yellow"], True) == "30;43" and color(["purple"], True) == "97;45"
    assert color(["dark red"], False) in ("1;31", "1;32", "1;33", "1;34", "1;35", "1;36", "1;91", "1;94")
    out = mark("beer\r\nfestival", '"beer festival"')
    assert re.fullmatch("(\x1b\\[[\\d;]+m)beer\x1b\\[0m\r\n\\1festival\x1b\\[0m", out)


def test_materialized(spark, tmp_path):
    ix = index(spark, ["craft beer", "wine"]).materialize(str(tmp_path / "ix"))
    assert ids(ix.search("beer").rows()) == [1]


@pytest.mark.parametrize("name", ["phrase_slop", "overlapping", "not_enclosed_by", "bm25_dense", "stream_match", "query_table_join", "long_token_discard", "middle_pct"])
def test_catalogue_against_duckdb(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "part", "pages", "conversations", "benchmark", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.sql(catalogue.oracle_sql()[name])
    got = catalogue.queries()[name](spark, sf)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))
