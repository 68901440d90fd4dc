"""The engine in Spark SQL: functions, and the operator ==> rewritten to one of them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.analysis import DEFAULT, Options, analyze, terms_of
from .index import BindingError, SearchIndex
from .operators import highlighting, matching
from .plans import render
from .plans.lowering import analyzed, compile_query
from .plans.parser import parse


def ql_parse(query: str | None, surface: bool = True, options: Options = DEFAULT) -> str | None:
    """A query as it is understood: as written, with the index's terms, or lowered."""
    if query is None:
        return None
    return render.surface(analyzed(parse(query), options)) if surface else render.lowered(compile_query(query, options))


def classify(query: str, options: Options = DEFAULT) -> str:
    """supported, parse (it can't be read) or lowering (its terms or places can't be searched so)."""
    try:
        parse(query)
    except ValueError:
        return "parse"
    try:
        compile_query(query, options)
    except ValueError:
        return "lowering"
    return "supported"


def snippet(text: str | None, start: int, end: int, context: int, options: Options = DEFAULT) -> str | None:
    """The terms at the positions of an interval and up to context places around it, joined by spaces."""
    if text is None:
        return None
    return " ".join(t.text for t in analyze(text, options)[0] if start - context <= t.pos <= end + context)


def tokenize(text: str | None, options: Options = DEFAULT) -> list[str]:
    return [t.text for t in analyze(text, options)[0]] if text is not None else []


def register(spark: SparkSession, options: Options = DEFAULT) -> None:
    """search_match(text, query) with its _any and _all for arrays, highlight_ansi(text, wrap_to, query), ql_parse(query), ql_lowered(query), maybe_quote(text), tokenize(text), highlight(text, begin, end, query)."""

    @F.pandas_udf("boolean")
    def search_match(texts: pd.Series, queries: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or q is None else matching.holds(compile_query(q, options), terms_of(t, options)) for t, q in zip(texts, queries, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def highlight(texts: pd.Series, begin: pd.Series, end: pd.Series, queries: pd.Series) -> pd.Series:
        def one(t: str | None, b: str, e: str, q: str | None) -> str | None:
            if t is None or q is None:
                return t
            try:
                return highlighting.highlight(t, compile_query(q, options), b, e, options)
            except ValueError:  # a query that can't be read marks nothing
                return t

        return pd.Series([one(*x) for x in zip(texts, begin, end, queries, strict=True)], dtype=object)

    def several(over: Callable) -> Callable:
        @F.pandas_udf("boolean")
        def match(texts: pd.Series, lists: pd.Series) -> pd.Series:
            def one(t: str | None, queries) -> bool | None:
                """By three-valued logic: a null query is unknown."""
                if t is None or queries is None:
                    return None
                terms, listed = terms_of(t, options), list(queries)
                known = [matching.holds(compile_query(q, options), terms) for q in listed if q is not None]
                return over(known) if over(known) == (over is any) or len(known) == len(listed) else None

            return pd.Series([one(t, q) for t, q in zip(texts, lists, strict=True)], dtype=object)

        return match

    @F.pandas_udf("string")
    def highlight_ansi(texts: pd.Series, widths: pd.Series, queries: pd.Series) -> pd.Series:
        def one(t: str | None, n: float | None, q: str | None) -> str | None:
            if t is None or q is None:
                return t
            try:
                return highlighting.highlight_ansi(t, compile_query(q, options), int(n) if n == n and n else None, options)
            except ValueError:
                return t

        return pd.Series([one(*x) for x in zip(texts, widths, queries, strict=True)], dtype=object)

    spark.udf.register("search_match", search_match)
    spark.udf.register("search_match_any", several(any))
    spark.udf.register("search_match_all", several(all))
    spark.udf.register("highlight_ansi", highlight_ansi)
    spark.udf.register("highlight", highlight)
    for name, f, kind in (("ql_parse", ql_parse, "string"), ("ql_lowered", lambda q: ql_parse(q, False), "string"), ("maybe_quote", render.maybe_quote, "string"), ("tokenize", tokenize, "array<string>")):
        spark.udf.register(name, _one_by_one(f, kind))


def _one_by_one(f: Callable, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


_PART = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\"\"|\\.)*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|==>", re.S)
_HELD = r"__held\d+__"
_TABLES = re.compile(rf"\b(search_scores|max_score|score_inspect)\(\s*({_HELD})\s*,\s*({_HELD})\s*\)")


def _close(sql: str, at: int) -> int:
    """The place after the parenthesis that closes the one at at."""
    depth = 0
    for i in range(at, len(sql)):
        depth += (sql[i] == "(") - (sql[i] == ")")
        if depth == 0:
            return i + 1
    raise ValueError("a parenthesis is not closed")


def _open(sql: str, end: int) -> int:
    """The place of the parenthesis that the one before end closes."""
    depth = 0
    for i in range(end - 1, -1, -1):
        depth += (sql[i] == ")") - (sql[i] == "(")
        if depth == 0:
            return i
    raise ValueError("a parenthesis is not opened")


def _operators(sql: str) -> str:
    """text ==> query, ANY (queries) or ALL (queries) as calls; strings and comments are held elsewhere."""
    while (at := sql.find("==>")) >= 0:
        end = len(sql[:at].rstrip())
        begin = _open(sql, end) if sql[end - 1 : end] == ")" else end
        while begin and re.match(r"[\w.:]", sql[begin - 1]):
            begin -= 1
        start = at + 3 + len(sql[at + 3 :]) - len(sql[at + 3 :].lstrip())
        word = re.compile(r"[\w.:]*").match(sql, start)
        after = word.end() + len(sql[word.end() :]) - len(sql[word.end() :].lstrip())
        called = sql[after : after + 1] == "("
        stop = _close(sql, after) if called else word.end()
        if begin == end or start == stop:
            raise ValueError("==> needs a text and a query")
        kind = {"ANY": "_any", "SOME": "_any", "ALL": "_all"}.get(word[0].upper(), "") if called else ""
        right = sql[after + 1 : stop - 1] if kind else sql[start:stop]
        sql = f"{sql[:begin]}search_match{kind}({sql[begin:end]}, {right}){sql[stop:]}"
    return sql


def _hold(sql: str) -> tuple[str, list[str]]:
    held: list[str] = []

    def hold(m: re.Match) -> str:
        if m[0] == "==>":
            return m[0]
        held.append(m[0])
        return f"__held{len(held) - 1}__"

    return _PART.sub(hold, sql), held


def _restore(sql: str, held: list[str]) -> str:
    return re.sub(r"__held(\d+)__", lambda m: held[int(m[1])], sql)


def rewrite(sql: str) -> str:
    """SQL with each `text ==> query` as search_match(text, query), ANY and ALL likewise; strings, names and comments stay."""
    out, held = _hold(sql)
    return _restore(_operators(out), held)


def search_sql(spark: SparkSession, sql: str, options: Options = DEFAULT, indexes: Iterable[SearchIndex] = (), **args) -> DataFrame:
    """A statement with ==> and, for indexes by their names and literal queries, scores.

    search_scores('index', 'query') is a table of the matching rows with score and full_score,
    score_inspect('index', 'query') one of (term, weight), max_score('index', 'query') a value."""
    register(spark, options)
    named = {i.name: i for i in indexes}
    out, held = _hold(sql)

    def view(m: re.Match) -> str:
        name, query = (held[int(h[6:-2])][1:-1].replace("''", "'") for h in (m[2], m[3]))
        if name not in named:
            raise BindingError(f"no index is named {name}")
        search = named[name].search(query)
        df = {"search_scores": search.scores, "max_score": search.max_score, "score_inspect": search.inspect}[m[1]]()
        at = f"lexispan_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(at)
        return f"(SELECT max_score FROM {at})" if m[1] == "max_score" else at

    return spark.sql(_restore(_operators(_TABLES.sub(view, out)), held), **args)
