"""Named queries over the driver's tables, each with the same result in DuckDB's SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import analysis
from .functions.analysis import DEFAULT, WORDS, Options
from .index import SearchIndex, search_join, sum_scores
from .operators import matching
from .plans import render
from .plans.lowering import compile_query
from .sources.tables import read
from .sql import classify, ql_parse, search_sql, snippet
from .streaming.filters import search_stream

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, options: Options = DEFAULT, columns: tuple[str, ...] = (), where: str | None = None) -> SearchIndex:
    return SearchIndex("documents_text", table(spark, sf_dir, "documents").select("doc_id", "text", *columns), "doc_id", "text", where, options)


# SQL building blocks

_RE = WORDS.replace("'", "''")


def tokens(name: str = "documents", key: str = "doc_id", text: str = "text", fold: str = "lower(strip_accents({}))", where: str = "true") -> str:
    """CTEs raw (key, w), tok (key, pos, term) and len (key, n)."""
    return f"""raw AS (SELECT {key}, list_filter(regexp_extract_all({text}, '{_RE}'), lambda x: regexp_matches(x, '[A-Za-z0-9À-ÖØ-öø-ÿ]')) AS w FROM {name} WHERE {text} IS NOT NULL AND {where}),
tok AS MATERIALIZED (SELECT {key}, generate_subscripts(w, 1) - 1 AS pos, {fold.format("unnest(w)")} AS term FROM raw),
len AS (SELECT {key}, len(w) AS n FROM raw WHERE len(w) > 0)"""


def has(test: str, key: str = "doc_id") -> str:
    return f"{key} IN (SELECT {key} FROM tok WHERE {test})"


def is_(word: str) -> str:
    return has(f"term = '{word}'")


def pair(a: str, b: str, on: str) -> str:
    return f"doc_id IN (SELECT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id WHERE a.term = '{a}' AND b.term = '{b}' AND {on})"


def chain(a: str, b: str, gap: int) -> str:
    """Minimal intervals of a THEN/gap b as (doc_id, s, e)."""
    return f"""SELECT doc_id, s, e FROM (SELECT doc_id, s, min(e) AS e FROM (
      SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.pos < b.pos
      WHERE a.term = '{a}' AND b.term = '{b}' GROUP BY b.doc_id, b.pos) GROUP BY doc_id, s) WHERE e - s - 1 <= {gap}"""


def relation(test: str, negated: bool = False, left: str = "iv", right: str = "pt") -> str:
    return f"doc_id IN (SELECT x.doc_id FROM {left} x WHERE {'NOT ' if negated else ''}EXISTS (SELECT 1 FROM {right} y WHERE y.doc_id = x.doc_id AND {test}))"


def every(*words: str) -> str:
    """Documents with all the words, by one aggregate."""
    listed = ", ".join(f"'{w}'" for w in words)
    return f"WITH {tokens()} SELECT doc_id FROM tok WHERE term IN ({listed}) GROUP BY doc_id HAVING count(DISTINCT term) = {len(words)}"


def where(condition: str, more: str = "") -> str:
    return f"WITH {tokens()}{more} SELECT doc_id FROM len WHERE {condition}"


_IV = f", iv AS ({chain('of', 'the', 5)}), pt AS (SELECT doc_id, pos AS s, pos AS e FROM tok WHERE term = 'and')"
_IV2 = _IV + f", iv2 AS ({chain('and', 'to', 5)})"
_INSIDE = "x.s <= y.s AND y.e <= x.e"

#: name: (query, SQL)
SEARCHES: dict[str, tuple[str, str]] = {
    "match_term": ("this", where(is_("this"))),
    "match_and": ("this AND that", every("this", "that")),
    "match_or": ("from OR was", where(f"{is_('from')} OR {is_('was')}")),
    "match_and_not": ("with AND NOT by", where(f"{is_('with')} AND NOT {is_('by')}")),
    "match_all": ("*", where("true")),
    "match_none": (", AND this", where("false")),
    "implicit_and": ("This THAT with", every("this", "that", "with")),
    "at_least_count": ("AT LEAST 2 OF [from was by]", where(f"({is_('from')})::INT + ({is_('was')})::INT + ({is_('by')})::INT >= 2")),
    "at_least_percent": ("AT LEAST 50% OF [from was by]", where(f"({is_('from')})::INT + ({is_('was')})::INT + ({is_('by')})::INT >= 2")),
    "all_of": ("ALL OF [from was by]", every("from", "was", "by")),
    "alternatives": ("[from, was]", where(f"{is_('from')} OR {is_('was')}")),
    "wildcard_prefix": ("thion*", where(has("term LIKE 'thion%'"))),
    "wildcard_suffix": ("*ingre", where(has("term LIKE '%ingre'"))),
    "wildcard_single": ("t?e", where(has("term LIKE 't_e'"))),
    "regex_term": ("MATCHES th(on|er)e?", where(has("regexp_full_match(term, 'th(on|er)e?')"))),
    "range_closed": ("na TO nd", where(has("term >= 'na' AND term <= 'nd'"))),
    "range_open": ("* TO ab", where(has("term <= 'ab'"))),
    "fuzzy_default": ("thing~1", where(has("term[1:1] = 't' AND levenshtein(term[2:], 'hing') <= 1"))),
    "fuzzy_prefix0": ("thing~0:1", where(has("levenshtein(term, 'thing') <= 1"))),
    "phrase": ('"of the"', where(pair("of", "the", "b.pos = a.pos + 1"))),
    "phrase_gap": ('"of _ the"', f"WITH {tokens()} SELECT DISTINCT doc_id FROM ({chain('of', 'the', 1)}) WHERE e - s = 2"),
    "phrase_slop": ('"of the"~2', where(pair("of", "the", "b.pos BETWEEN a.pos + 1 AND a.pos + 3"))),
    "phrase_alternatives": ('"[of in] the"', where(f"{pair('of', 'the', 'b.pos = a.pos + 1')} OR {pair('in', 'the', 'b.pos = a.pos + 1')}")),
    "then": ("of THEN/2 the", where(pair("of", "the", "b.pos BETWEEN a.pos + 1 AND a.pos + 3"))),
    "near": ("with NEAR/3 this", where(pair("with", "this", "abs(b.pos - a.pos) BETWEEN 1 AND 4"))),
    "near_same_term": ("the NEAR/1 the", where(pair("the", "the", "b.pos - a.pos BETWEEN 1 AND 2"))),
    "chain_then_near": ("of THEN/5 the NEAR/2 and", where("doc_id IN (SELECT x.doc_id FROM iv x JOIN pt y ON x.doc_id = y.doc_id WHERE (y.s > x.e AND y.s - x.e <= 3) OR (y.s < x.s AND x.s - y.s <= 3))", _IV)),
    "within": ("(of AND the) WITHIN 3", where(pair("of", "the", "abs(b.pos - a.pos) BETWEEN 1 AND 2"))),
    "encloses": ("(of THEN/5 the) ENCLOSES and", where(relation(_INSIDE), _IV)),
    "not_encloses": ("(of THEN/5 the) NOT ENCLOSES and", where(relation(_INSIDE, True), _IV)),
    "enclosed_by": ("and ENCLOSED BY (of THEN/5 the)", where(relation("y.s <= x.s AND x.e <= y.e", False, "pt", "iv"), _IV)),
    "not_enclosed_by": ("and NOT ENCLOSED BY (of THEN/5 the)", where(relation("y.s <= x.s AND x.e <= y.e", True, "pt", "iv"), _IV)),
    "overlapping": ("(of THEN/5 the) OVERLAPPING (and THEN/5 to)", where(relation("x.s <= y.e AND y.s <= x.e", False, "iv", "iv2"), _IV2)),
    "not_overlapping": ("(of THEN/5 the) NOT OVERLAPPING (and THEN/5 to)", where(relation("x.s <= y.e AND y.s <= x.e", True, "iv", "iv2"), _IV2)),
    "before": ("this BEFORE that", where(pair("this", "that", "b.pos > a.pos"))),
    "after": ("this AFTER that", where(pair("this", "that", "b.pos < a.pos"))),
    "first_words": ("this IN FIRST 20 WORDS", where(has("term = 'this' AND pos < 20"))),
    "first_pct": ("this IN FIRST 10%", where("doc_id IN (SELECT doc_id FROM tok JOIN len USING (doc_id) WHERE term = 'this' AND pos < (n * 10 + 99) // 100)")),
    "last_words": ("this IN LAST 20 WORDS", where("doc_id IN (SELECT doc_id FROM tok JOIN len USING (doc_id) WHERE term = 'this' AND pos >= n - 20)")),
    "last_pct": ("this IN LAST 10%", where("doc_id IN (SELECT doc_id FROM tok JOIN len USING (doc_id) WHERE term = 'this' AND pos >= n - (n * 10 + 99) // 100)")),
    "middle_pct": ("this IN MIDDLE 20%", where("doc_id IN (SELECT doc_id FROM tok JOIN len USING (doc_id) WHERE term = 'this' AND pos >= (n * 80 + 199) // 200 AND pos < n - (n * 80 + 199) // 200)")),
    "words_between": ("this IN WORDS 5 TO 25", where(has("term = 'this' AND pos BETWEEN 4 AND 24"))),
}


def _search(query: str) -> Query:
    return lambda spark, sf: documents(spark, sf).search(query).rows().select("doc_id")


# scores


def scores_sql(words: dict[str, float], matching_: str, k1: float = 1.2, b: float = 0.75, name: str = "documents", key: str = "doc_id", text: str = "text", covered: str = "true") -> str:
    """(key, score) in REAL arithmetic, the terms in their order."""
    from .operators.scoring import BUCKETS

    bucket = "CASE " + " ".join(f"WHEN tf >= {v} THEN {v}" for v in reversed(BUCKETS[1:])) + " ELSE 1 END"
    one = []
    for w, boost in sorted(words.items()):
        one.append(f"""coalesce((SELECT ((idf * {boost}::REAL)::REAL * bk::REAL * ({k1}::REAL + 1::REAL)) / ((bk::REAL + {k1}::REAL * (1::REAL - {b}::REAL)) + ({k1}::REAL * {b}::REAL / avgdl) * len.n::REAL)
          FROM tfs WHERE tfs.{key} = len.{key} AND tfs.term = '{w}'), 0::REAL)""")
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""WITH {tokens(name, key, text, where=covered)},
st AS (SELECT count(*) AS nd, (sum(n)::REAL / count(*)::REAL)::REAL AS avgdl FROM len),
df AS (SELECT term, count(DISTINCT {key}) AS df FROM tok WHERE term IN ({listed}) GROUP BY term),
tfs AS MATERIALIZED (SELECT {key}, term, {bucket} AS bk, greatest(0, ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)))::REAL AS idf, avgdl
  FROM (SELECT {key}, term, count(*) AS tf FROM tok WHERE term IN ({listed}) GROUP BY ALL) JOIN df USING (term), st)
SELECT {key}, round(({" + ".join(one)})::DOUBLE, 4) AS score FROM len WHERE {matching_}"""


def _scored(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round(F.col("score").cast("double"), 4).alias("score"))


_FO = f"({is_('from')} OR {is_('worthless')})"
SCORES: dict[str, tuple[Query, str]] = {
    "bm25_full": (lambda s, d: _scored(documents(s, d).search("from OR worthless").score(full=True), "doc_id"), scores_sql({"from": 1.0, "worthless": 1.0}, _FO)),
    "bm25_dense": (lambda s, d: _scored(documents(s, d).search("from OR worthless").score(), "doc_id"), scores_sql({"worthless": 1.0}, _FO)),
    "bm25_boost": (lambda s, d: _scored(documents(s, d).search("from^0.5 OR worthless^2").score(), "doc_id"), scores_sql({"from": 0.5, "worthless": 2.0}, _FO)),
    "bm25_phrase": (lambda s, d: _scored(documents(s, d).search('"of the"').score(full=True), "doc_id"), scores_sql({"of": 1.0, "the": 1.0}, pair("of", "the", "b.pos = a.pos + 1"))),
    "bm25_params": (lambda s, d: _scored(documents(s, d).search("from OR was").score(full=True, k1=2.0, b=0.3), "doc_id"), scores_sql({"from": 1.0, "was": 1.0}, f"{is_('from')} OR {is_('was')}", 2.0, 0.3)),
    "bm25_term_add": (lambda s, d: _scored(documents(s, d).search("from").score(term_add=["worthless"]), "doc_id"), scores_sql({"worthless": 1.0}, is_("from"))),
    "bm25_term_replace": (lambda s, d: _scored(documents(s, d).search("from").score(term_replace=["was"]), "doc_id"), scores_sql({"was": 1.0}, is_("from"))),
    "bm25_stop_words": (lambda s, d: _scored(documents(s, d, Options(score_stop_words="from, the")).search("from^1 OR was^1").score(), "doc_id"), scores_sql({"was": 1.0}, f"{is_('from')} OR {is_('was')}")),
    "partial_index_score": (
        lambda s, d: _scored(documents(s, d, columns=("lang",), where="lang = 'en'").search("from OR was").score(full=True), "doc_id"),
        scores_sql({"from": 1.0, "was": 1.0}, f"{is_('from')} OR {is_('was')}", covered="lang = 'en'"),
    ),
}
_FULL = SCORES["bm25_full"][1]
SCORES |= {
    "bm25_topk": (lambda s, d: _scored(documents(s, d).search("from OR worthless").topk(10, full=True), "doc_id"), f"SELECT doc_id, score FROM ({_FULL}) ORDER BY score DESC, doc_id LIMIT 10"),
    "max_score": (lambda s, d: documents(s, d).search("from OR worthless").max_score().select(F.round(F.col("max_score").cast("double"), 4).alias("max_score")), f"SELECT max(score) AS max_score FROM ({_FULL})"),
}


def normalized_score(spark: SparkSession, sf: str) -> DataFrame:
    search = documents(spark, sf).search("from OR worthless")
    scored = search.score(full=True).select("doc_id", "score")
    share = F.col("score") / F.coalesce(F.col("max_score"), F.lit(1.0).cast("float"))
    return scored.join(F.broadcast(search.max_score()), how="cross").select("doc_id", F.round(share.cast("double"), 3).alias("score"))  # one row is broadcast


def score_inspect(spark: SparkSession, sf: str) -> DataFrame:
    out = documents(spark, sf).search("from^2 OR worthless OR the").inspect()
    return out.select("term", F.round(F.col("weight").cast("double"), 4).alias("weight"))


def multi_column_score(spark: SparkSession, sf: str) -> DataFrame:
    """Two indexes of one table: rows that match either, with the sum of their scores."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    a = SearchIndex("part_name", part, "p_partkey", "p_name").search("ring OR small")
    b = SearchIndex("part_type", part, "p_partkey", "p_type").search("steel")
    one, two = (x.score(full=True).select("p_partkey", F.col("score").alias(n)) for x, n in ((a, "s1"), (b, "s2")))
    both = one.join(two, "p_partkey", "full_outer")
    return both.select("p_partkey", F.round(sum_scores(F.col("s1"), F.col("s2")).cast("double"), 3).alias("score"))


# analysis


def _terms(spark: SparkSession, sf: str, options: Options = DEFAULT) -> DataFrame:
    docs = analysis.with_terms(table(spark, sf, "documents").select("doc_id", "text"), F.col("text"), options)
    return docs.select("doc_id", F.posexplode("_terms").alias("pos", "term")).where("term is not null")


def _term_counts(options: Options) -> Query:
    return lambda spark, sf: _terms(spark, sf, options).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def term_df(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with each term. A row's own terms are made distinct where it is; only those of ids that
    several rows have are grouped by id too, so that pairs of terms and documents aren't shuffled."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_again"))
    unique = repeated.isEmpty()
    if not unique:
        docs = docs.join(repeated, F.col("doc_id") == F.col("_again"), "left")
    rows = analysis.with_terms(docs, F.col("text")).select("*", F.explode(F.array_distinct("_terms")).alias("term")).where("term is not null")
    if unique:
        return rows.groupBy("term").agg(F.count("doc_id").alias("df"))
    by_id = rows.groupBy("term", "_again").agg(F.count("doc_id").alias("n"))
    return by_id.groupBy("term").agg(F.sum(F.when(F.col("_again").isNull(), F.col("n")).otherwise(1)).alias("df"))


_SHORT = Options(max_token_bytes=8, long_tokens="discard")
ANALYSIS: dict[str, tuple[Query, str]] = {
    "tokenize_terms": (lambda s, d: _terms(s, d).select("doc_id", F.col("pos").cast("long").alias("pos"), "term"), f"WITH {tokens()} SELECT doc_id, pos, term FROM tok"),
    "doc_lengths": (lambda s, d: documents(s, d).documents().select("doc_id", analysis.token_count(F.col("_terms")).cast("long").alias("n")), f"WITH {tokens()} SELECT doc_id, len(w)::BIGINT AS n FROM raw"),
    "term_df": (term_df, f"WITH {tokens()} SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term"),
    "token_counts": (_term_counts(DEFAULT), f"WITH {tokens()} SELECT term, count(*) AS n FROM tok GROUP BY term"),
    "whitespace_tokens": (
        _term_counts(Options(tokenizer="whitespace")),
        r"SELECT term, count(*) AS n FROM (SELECT lower(strip_accents(unnest(regexp_split_to_array(text, '\s+')))) AS term FROM documents) WHERE term <> '' GROUP BY term",
    ),
    "case_preserve_tokens": (_term_counts(Options(case_folding="preserve")), f"WITH {tokens(fold='strip_accents({})')} SELECT term, count(*) AS n FROM tok GROUP BY term"),
    "accent_preserve_tokens": (_term_counts(Options(accent_folding="preserve")), f"WITH {tokens(fold='lower({})')} SELECT term, count(*) AS n FROM tok GROUP BY term"),
    "long_token_discard": (
        lambda s, d: _terms(s, d, _SHORT).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("pos").cast("long").alias("last")),
        f"WITH {tokens()} SELECT term, count(*) AS n, max(pos) AS last FROM tok WHERE octet_length(encode(term)) <= 8 GROUP BY term",
    ),
    "position_collapse": (
        lambda s, d: _terms(s, d, Options(max_token_bytes=8, long_tokens="discard", position_gaps="collapse")).groupBy("term").agg(F.max("pos").cast("long").alias("last")),
        f"WITH {tokens()} SELECT term, max(p) AS last FROM (SELECT term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p FROM tok WHERE octet_length(encode(term)) <= 8) GROUP BY term",
    ),
}


# composition


def search_any_array(spark: SparkSession, sf: str) -> DataFrame:
    ix = documents(spark, sf)
    return ix.documents().where(matching.matches(compile_query("[from worthless]"), F.col("_terms")) | ix.match_any([None, "xyzzy"])).select("doc_id")


def query_table_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark item's first two terms as a query of its own."""
    q = table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(analysis.terms(F.col("text")), 1, 2), " ").alias("query"))
    return search_join(table(spark, sf, "documents").select("doc_id", "text"), "text", q.where("query <> ''"), "query").select("doc_id", "item_id")


def stream_match(spark: SparkSession, sf: str) -> DataFrame:
    """The conversations table as a stream, filtered by a search, to a table in memory."""
    import uuid

    schema = table(spark, sf, "conversations").schema
    # a stream reads a folder, or a pattern that names one file
    stream = spark.readStream.schema(schema).parquet(f"{sf}/conversations.parque[t]")
    name = f"stream_{uuid.uuid4().hex}"
    search = SearchIndex("conversations", table(spark, sf, "conversations"), "conv_id", "text").search("please OR the")
    run = search_stream(search, stream).select("conv_id", "turn").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def _highlight(spark: SparkSession, sf: str, query: str, begin: str, end: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return SearchIndex("part_name", part, "p_partkey", "p_name").search(query).highlight(begin, end).select("p_partkey", "highlight")


_PARSED = {
    "Big bad OR Wolf": ("big AND bad OR wolf", "OR(AND(big, bad), wolf)"),
    '"Big bad wolf"': ('"big bad wolf"', 'PHRASE("big bad wolf")'),
    "alpha OR (gamma OR alpha)": ("alpha OR (gamma OR alpha)", "OR(alpha, gamma)"),
    "Beer* AND NOT ale~1": ("MATCHES beer.* AND NOT ale~1", "AND(REGEX(beer.*), NOT(ale~1))"),
    "a THEN/3 [b c] IN LAST 10%": ("a THEN/3 [b c] IN LAST 10%", "SPAN(MAXGAPS(3, ORDERED(a, OR(b, c)))) IN LAST 10%"),
}
_QUOTED = {"beer": "beer", "beer cheese": '"beer cheese"', "47,000": "47,000", "AND": '"AND"', "wi-fi": "wi-fi"}


def _values(rows: dict[str, str]) -> str:
    one = lambda s: "'" + s.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({one(a)}, {one(b)})" for a, b in rows.items()) + ") t(query, result)"


def _pairs(f: Callable[[str], str | None], queries) -> Query:
    return lambda spark, sf: spark.createDataFrame([(q, f(q)) for q in queries], "query string, result string")


_CLASSES = {"beer OR ale": "supported", "beer AND": "parse", "* THEN/2 beer": "lowering"}
_THIS = where(is_("this"))
_PART = f"WITH {tokens('part', 'p_partkey', 'p_name')}"
OTHERS: dict[str, tuple[Query, str | None]] = {
    "span_intervals": (
        lambda s, d: documents(s, d).search("of THEN/2 the").intervals().select("doc_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")),
        f"WITH {tokens()} {chain('of', 'the', 2)}",
    ),
    "span_freq": (lambda s, d: documents(s, d).search("of THEN/2 the").intervals().groupBy("doc_id").agg(F.count(F.lit(1)).alias("freq")), f"WITH {tokens()} SELECT doc_id, count(*) AS freq FROM ({chain('of', 'the', 2)}) GROUP BY doc_id"),
    "normalized_score": (normalized_score, f"SELECT doc_id, round(score / max(score) OVER (), 3) AS score FROM ({_FULL.replace(', 4) AS score', ', 12) AS score')})"),
    "score_inspect": (
        score_inspect,
        f"""WITH {tokens()}, df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok WHERE term IN ('from', 'worthless', 'the') GROUP BY term), st AS (SELECT count(*) AS nd FROM len)
        SELECT term, round((CASE WHEN term = 'from' THEN 2 ELSE 1 END::REAL * ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))::REAL)::DOUBLE, 4) AS weight FROM df, st WHERE term = 'from' OR df < 0.1::REAL::DOUBLE * nd""",
    ),
    "multi_column_score": (
        multi_column_score,
        f"""SELECT p_partkey, round(sum(score), 3) AS score FROM (
        SELECT * FROM ({scores_sql({"ring": 1.0, "small": 1.0}, has("term IN ('ring', 'small')", "p_partkey"), name="part", key="p_partkey", text="p_name").replace(", 4) AS score", ", 9) AS score")})
        UNION ALL SELECT * FROM ({scores_sql({"steel": 1.0}, has("term = 'steel'", "p_partkey"), name="part", key="p_partkey", text="p_type").replace(", 4) AS score", ", 9) AS score")})) GROUP BY p_partkey""",
    ),
    "highlight_term": (lambda s, d: _highlight(s, d, "ring", "<b>", "</b>"), _PART + r" SELECT p_partkey, regexp_replace(p_name, '(?i)\b(ring)\b', '<b>\1</b>', 'g') AS highlight FROM part WHERE " + has("term = 'ring'", "p_partkey")),
    "highlight_phrase": (lambda s, d: _highlight(s, d, '"small ring"', "[", "]"), r"SELECT p_partkey, regexp_replace(p_name, '(?i)\b(small ring)\b', '[\1]', 'g') AS highlight FROM part WHERE regexp_matches(p_name, '(?i)\bsmall ring\b')"),
    "search_join_labels": (
        lambda s, d: documents(s, d).search("this").rows().select("doc_id").join(table(s, d, "labels"), "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n")),
        f"SELECT quality, count(*) AS n FROM ({_THIS}) JOIN labels USING (doc_id) GROUP BY quality",
    ),
    "search_outer_join": (
        lambda s, d: table(s, d, "labels").select("doc_id").join(documents(s, d).search("this").rows().select("doc_id", F.lit(True).alias("hit")), "doc_id", "left").groupBy("hit").agg(F.count(F.lit(1)).alias("n")),
        f"SELECT hit, count(*) AS n FROM labels LEFT JOIN (SELECT doc_id, true AS hit FROM ({_THIS})) USING (doc_id) GROUP BY hit",
    ),
    "search_agg_by_lang": (
        lambda s, d: documents(s, d, columns=("lang",)).search("from").rows().groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")),
        f"WITH {tokens()} SELECT lang, count(*) AS n, max(doc_id) AS last FROM documents WHERE {is_('from')} GROUP BY lang",
    ),
    "search_rollup": (
        lambda s, d: documents(s, d, columns=("lang", "source")).search("from").rows().rollup("lang", "source").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {tokens()} SELECT lang, source, count(*) AS n FROM documents WHERE {is_('from')} GROUP BY ROLLUP (lang, source)",
    ),
    "search_window_rank": (
        lambda s, d: documents(s, d, columns=("lang",)).search("from").rows().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("r <= 3").select("lang", "doc_id", "r"),
        f"WITH {tokens()} SELECT lang, doc_id, r FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE {is_('from')}) WHERE r <= 3",
    ),
    "search_union": (lambda s, d: documents(s, d).search("this").rows().select("doc_id").union(documents(s, d).search("worthless").rows().select("doc_id")).distinct(), where(f"{is_('this')} OR {is_('worthless')}")),
    "search_except": (lambda s, d: documents(s, d).search("this").rows().select("doc_id").subtract(documents(s, d).search("by").rows().select("doc_id")), where(f"{is_('this')} AND NOT {is_('by')}")),
    "search_any_array": (search_any_array, where(f"{is_('from')} OR {is_('worthless')}")),
    "search_two_columns": (
        lambda s, d: table(s, d, "part").where(SearchIndex("n", table(s, d, "part"), "p_partkey", "p_name").match("ring") | SearchIndex("t", table(s, d, "part"), "p_partkey", "p_type").match("steel")).select("p_partkey"),
        r"SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)\bring\b') OR regexp_matches(p_type, '(?i)\bsteel\b')",
    ),
    "query_table_join": (
        query_table_join,
        f"""WITH {tokens()}, q AS (SELECT item_id, list_transform(list_filter(regexp_extract_all(text, '{_RE}'), lambda x: regexp_matches(x, '[A-Za-z0-9À-ÖØ-öø-ÿ]'))[1:2], lambda x: lower(strip_accents(x))) AS w FROM benchmark)
        SELECT DISTINCT a.doc_id, item_id FROM q JOIN tok a ON a.term = w[1] JOIN tok b ON b.term = w[2] AND b.doc_id = a.doc_id""",
    ),
    "search_pages_html": (lambda s, d: SearchIndex("pages", table(s, d, "pages").select("page_id", "html"), "page_id", "html").search('"charset utf 8"').rows().select("page_id"), "SELECT page_id FROM pages WHERE regexp_matches(html, 'charset=\"utf-8\"')"),
    "search_conversations": (
        lambda s, d: SearchIndex("conv", table(s, d, "conversations"), "conv_id", "text", "role = 'user'").search("the").rows().select("conv_id", "turn"),
        f"SELECT conv_id, turn FROM conversations WHERE role = 'user' AND list_contains(list_transform(regexp_extract_all(text, '{_RE}'), lambda x: lower(strip_accents(x))), 'the')",
    ),
    "search_part_names": (lambda s, d: SearchIndex("n", table(s, d, "part"), "p_partkey", "p_name").search("small ring").rows().select("p_partkey", "p_name"), r"SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)\bsmall\b') AND regexp_matches(p_name, '(?i)\bring\b')"),
    "search_sql_operator": (
        lambda s, d: (table(s, d, "part").createOrReplaceTempView("part_to_search"), search_sql(s, "SELECT p_partkey FROM part_to_search WHERE p_name ==> 'small AND ring'"))[1],
        r"SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)\bsmall\b') AND regexp_matches(p_name, '(?i)\bring\b')",
    ),
    "search_sql_any": (
        lambda s, d: (table(s, d, "part").createOrReplaceTempView("part_to_search"), search_sql(s, "SELECT p_partkey FROM part_to_search WHERE lower(concat(p_name, '')) ==> ANY (array('ring', 'small', NULL))"))[1],
        r"SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)\b(small|ring)\b')",
    ),
    "search_sql_all": (
        lambda s, d: (table(s, d, "part").createOrReplaceTempView("part_to_search"), search_sql(s, "SELECT p_partkey FROM part_to_search WHERE p_name ==> ALL (array('ring', 'small'))"))[1],
        r"SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)\bsmall\b') AND regexp_matches(p_name, '(?i)\bring\b')",
    ),
    "search_sql_scores": (
        lambda s, d: search_sql(s, "SELECT doc_id, round(cast(full_score AS double), 4) AS score FROM search_scores('documents_text', 'from OR worthless')", indexes=[documents(s, d)]),
        _FULL,
    ),
    "search_sql_max_score": (
        lambda s, d: search_sql(s, "SELECT round(cast(max_score('documents_text', 'from OR worthless') AS double), 4) AS max_score", indexes=[documents(s, d)]),
        f"SELECT max(score) AS max_score FROM ({_FULL})",
    ),
    "snippets": (
        lambda s, d: s.createDataFrame([(k, snippet("The quick brown fox jumps", 1, 2, k)) for k in (0, 1, 9)], "context int, snippet string"),
        "SELECT * FROM (VALUES (0::INT, 'quick brown'), (1, 'the quick brown fox'), (9, 'the quick brown fox jumps')) t(context, snippet)",
    ),
    "classify_queries": (_pairs(classify, _CLASSES), _values(_CLASSES)),
    "stream_match": (
        stream_match,
        f"SELECT conv_id, turn FROM conversations WHERE list_has_any(list_transform(regexp_extract_all(text, '{_RE}'), lambda x: lower(strip_accents(x))), ['the', 'please'])",
    ),
    "ql_parse_surface": (_pairs(ql_parse, _PARSED), _values({q: a for q, (a, _) in _PARSED.items()})),
    "ql_parse_lowered": (_pairs(lambda q: ql_parse(q, False), _PARSED), _values({q: b for q, (_, b) in _PARSED.items()})),
    "maybe_quote": (_pairs(render.maybe_quote, _QUOTED), _values(_QUOTED)),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for a query, by all its terms."""
    return documents(spark, sf_dir).search("of OR with").topk(10, full=True).select("doc_id", "score")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _search(q) for name, (q, _) in SEARCHES.items()}
    for group in (ANALYSIS, SCORES, OTHERS):
        out |= {name: f for name, (f, _) in group.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: sql for name, (_, sql) in SEARCHES.items()}
    for group in (ANALYSIS, SCORES, OTHERS):
        out |= {name: sql for name, (_, sql) in group.items() if sql}
    return out
