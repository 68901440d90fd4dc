"""An index: a text of a DataFrame, which of its rows it covers, and how they are analyzed and scored.

Nothing is stored by default: a search reads the table and Spark prunes and pushes down what it can.
`materialize` writes the terms once, for tables that are searched often."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import analysis
from .functions.analysis import DEFAULT, Options
from .operators import highlighting, matching, scoring
from .plans.lowering import compile_query
from .plans.nodes import Node


class BindingError(ValueError):
    """A search, score or highlight that no index, or more than one analysis, would apply to."""


class SearchIndex:
    """text: a column name or expression; where: a condition that the rows of the index meet."""

    def __init__(self, name: str, df: DataFrame, key: str, text: str | Column, where: str | Column | None = None, options: Options = DEFAULT) -> None:
        self.name, self.key, self.options = name, key, options
        self.text = F.col(text) if isinstance(text, str) else text
        self.where = F.expr(where) if isinstance(where, str) else where
        self.df = df
        self._known = scoring.Stats(-1, 0, {})
        self.terms = analysis.terms(self.text, options)
        df.where(self.where if self.where is not None else F.lit(True)).select(self.text)  # fails here if they don't resolve

    # documents
    def documents(self, df: DataFrame | None = None, need: Callable[[Column], Column] | None = None) -> DataFrame:
        """The rows that the index covers, with their terms as _terms; need: see analysis.with_terms."""
        df = self.df if df is None else df
        if self.where is not None:
            df = df.where(self.where)
        if "_terms" in df.columns:
            return df
        return analysis.with_terms(df, self.text, self.options, need)

    def stats(self, words: list[str]) -> scoring.Stats:
        """Of all covered rows; the table is taken for unchanging, so what is known isn't counted again."""
        new = [w for w in dict.fromkeys(words) if w not in self._known.df]
        if new or self._known.n < 0:
            got = scoring.stats(self.documents(), F.col("_terms"), new)
            self._known = scoring.Stats(got.n, got.length, self._known.df | got.df)
        return self._known

    def materialize(self, path: str) -> SearchIndex:
        """An index over the rows and their terms, written to path."""
        self.documents().write.mode("overwrite").parquet(path)
        out = SearchIndex(self.name, self.df.sparkSession.read.parquet(path), self.key, self.text, self.where, self.options)
        out.terms = F.col("_terms")
        return out

    def compile(self, query: str, keep_repeats: bool = False) -> Node:
        return compile_query(query, self.options, keep_repeats)

    # searches
    def match(self, query: str | None) -> Column:
        """Whether a row matches; null where the text or the query is null."""
        if query is None:
            return F.lit(None).cast("boolean")
        node = self.compile(query)
        if not matching.is_native(node):
            return matching.matches(node, self.terms)
        return F.transform(F.array(self.terms), lambda t: matching.matches(node, t))[0]  # the terms are bound once

    def match_any(self, queries: list[str | None]) -> Column:
        """text matches any of the queries, by three-valued logic; false for an empty list."""
        return reduce(lambda a, b: a | b, [self.match(q) for q in queries], F.lit(False))

    def match_all(self, queries: list[str | None]) -> Column:
        return reduce(lambda a, b: a & b, [self.match(q) for q in queries], F.lit(True))

    def search(self, *queries: str) -> Search:
        return Search(self, queries)


class Search:
    """Rows of an index that match; several queries are one OR."""

    def __init__(self, index: SearchIndex, queries: tuple[str, ...]) -> None:
        self.index, self.queries = index, queries
        self.plain = self._join([index.compile(q) for q in queries])
        self.weighing = self._join([index.compile(q, True) for q in queries])

    @staticmethod
    def _join(nodes: list[Node]) -> Node:
        return nodes[0] if len(nodes) == 1 else Node("or", tuple(nodes))

    def predicate(self) -> Column:
        return matching.matches(self.plain, F.col("_terms"))

    def rows(self, df: DataFrame | None = None) -> DataFrame:
        """Matching rows, with _terms."""
        return self.index.documents(df, matching.needed(self.plain)).where(self.predicate())

    def result(self) -> DataFrame:
        return self.rows().drop("_terms")

    def intervals(self) -> DataFrame:
        """(key, s, e): a row per interval."""
        rows = self.rows().select(self.index.key, F.explode(matching.intervals(self.plain, F.col("_terms"))).alias("i"))
        return rows.select(self.index.key, F.col("i.s").alias("s"), F.col("i.e").alias("e"))

    # scores
    def _terms(self, full: bool, dense_ratio: float | None, add: list[str] | None, replace: list[str] | None) -> tuple[list[scoring.Weighted], scoring.Stats]:
        ws = scoring.weighted(self.weighing, self.index.options, add, replace, full)
        s = self.index.stats([w.term for w in ws])
        return scoring.retained(ws, s, None if full else dense_ratio), s

    def score_column(self, full: bool = False, dense_ratio: float = 0.10, k1: float | None = None, b: float | None = None, term_add: list[str] | None = None, term_replace: list[str] | None = None) -> Column:
        """The score of a row of documents(); null where it doesn't match."""
        ws, s = self._terms(full, dense_ratio, term_add, term_replace)
        o = self.index.options
        value = scoring.score(F.col("_terms"), ws, s, o.k1 if k1 is None else k1, o.b if b is None else b)
        return F.when(self.predicate(), value)

    def score(self, **how) -> DataFrame:
        """Matching rows with their score, by all terms (full) or without those in dense_ratio of all documents."""
        return self.rows().withColumn("score", self.score_column(**how)).drop("_terms")

    def scores(self) -> DataFrame:
        """Matching rows with score (without dense terms) and full_score."""
        return self.rows().withColumn("score", self.score_column()).withColumn("full_score", self.score_column(full=True)).drop("_terms")

    def topk(self, k: int, **how) -> DataFrame:
        return self.score(**how).orderBy(F.desc("score"), self.index.key).limit(k)

    def max_score(self, full: bool = True, **how) -> DataFrame:
        """One row: the highest score of all covered rows that match."""
        return self.score(full=full, **how).agg(F.max("score").alias("max_score"))

    def inspect(self, dense_ratio: float = 0.10, term_add: list[str] | None = None, term_replace: list[str] | None = None) -> DataFrame:
        """(term, weight): the terms that score, with idf times boost."""
        import numpy as np

        ws, s = self._terms(False, dense_ratio, term_add, term_replace)
        rows = [(w.term, float(scoring.idf(s.n, s.df[w.term]) * np.float32(w.boost))) for w in ws]
        return self.index.df.sparkSession.createDataFrame(rows, "term string, weight float")

    # highlights
    def highlight_column(self, text: Column, begin: str = "<b>", end: str = "</b>") -> Column:
        node, options = self.plain, self.index.options

        @F.pandas_udf("string")
        def mark(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else highlighting.highlight(t, node, begin, end, options))

        return mark(text)

    def highlight_ansi_column(self, text: Column, wrap_to: int | None = None) -> Column:
        node, options = self.plain, self.index.options

        @F.pandas_udf("string")
        def mark(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else highlighting.highlight_ansi(t, node, wrap_to, options))

        return mark(text)

    def highlight(self, begin: str = "<b>", end: str = "</b>") -> DataFrame:
        """Matching rows with their text, marked, as highlight."""
        return self.result().withColumn("highlight", self.highlight_column(self.index.text, begin, end))


def sum_scores(*scores: Column) -> Column:
    """Scores of several indexes of one table: those that are not null, added in double precision."""
    total = reduce(lambda a, b: a + b, [F.coalesce(s.cast("double"), F.lit(0.0)) for s in scores])
    return F.when(reduce(lambda a, b: a | b, [s.isNotNull() for s in scores]), total.cast("float"))


def same_analysis(*indexes: SearchIndex) -> Options:
    """The analysis that indexes of the parts of one table share; parts that differ can't be searched as one."""
    if len({i.options.analysis() for i in indexes}) != 1:
        raise BindingError("the parts have indexes with different analyses")
    return indexes[0].options


def search_join(docs: DataFrame, text: str, queries: DataFrame, query: str, options: Options = DEFAULT) -> DataFrame:
    """Pairs of documents and queries that match, for queries that are a column.

    The distinct query texts (a table that its user states) go to the tasks, where they are compiled
    and listed by terms that their matches must have. A document is held against the queries of its
    own terms and those that have no such terms; it isn't repeated, and only matches become rows."""
    texts = [r[0] for r in queries.select(query).where(F.col(query).isNotNull()).distinct().collect()]

    @F.pandas_udf("array<string>")
    def matching_queries(terms: pd.Series) -> pd.Series:
        by_term: dict[str, list[str]] = {}
        always = []
        for q in texts:
            need = matching.anchors(compile_query(q, options))
            for t in need or ():
                by_term.setdefault(t, []).append(q)
            if need is None:
                always.append(q)

        def one(own: list[str | None]) -> list[str]:
            near = dict.fromkeys([*always, *(q for t in dict.fromkeys(own) for q in by_term.get(t, ()))])
            return [q for q in near if matching.holds(compile_query(q, options), own)]

        return pd.Series([one(list(t)) if t is not None else [] for t in terms], dtype=object)

    hits = analysis.with_terms(docs, F.col(text), options).withColumn("_query", F.explode(matching_queries(F.col("_terms"))))
    return hits.drop("_terms").join(queries, F.col("_query") == F.col(query)).drop("_query")
