"""BM25: what a query's terms weigh (on the driver), and a document's score (a Column).

Two passes over the corpus, none of them per query term: one aggregate of document counts, lengths
and frequencies of the query's terms, then a projection. Arithmetic is single precision in a fixed
order, so scores are the same whatever the partitions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import Options, analyze, token_count
from ..plans.nodes import Node

#: Least counts of the sixteen buckets of term frequencies, which stand for all counts of the bucket.
BUCKETS = tuple(map(int, "1 2 3 5 10 20 41 85 177 371 777 1626 3405 7132 14938 31288".split()))
_HIDDEN = ("not_encloses", "not_enclosed_by", "not_overlapping")


@dataclass
class Weighted:
    term: str
    boost: float
    pinned: bool


def written_terms(node: Node) -> list[tuple[str, float | None]]:
    """(term, boost or None) of each written occurrence that scores."""
    out: list[tuple[str, float | None]] = []

    def visit(n: Node, boost: float | None) -> None:
        if n.op == "boost":
            boost = float(np.float32(np.float32(1.0 if boost is None else boost) * np.float32(n.arg)))
            visit(n.kids[0], boost)
        elif n.op == "term":
            out.append((n.arg, boost))
        elif n.op == "fuzzy":
            out.append((n.arg[0], boost))
        elif n.op in _HIDDEN:
            visit(n.kids[0], boost)
        else:
            for k in n.kids:
                visit(k, boost)

    visit(node, None)
    return out


def weighted(node: Node, options: Options, add: list[str] | None = None, replace: list[str] | None = None, full: bool = False) -> list[Weighted]:
    """The terms with their boosts added up, in the order of the terms."""
    if add and replace:
        raise ValueError("term_add and term_replace exclude each other")
    found: dict[str, Weighted] = {}
    for t, boost in [] if replace else written_terms(node):
        w = found.setdefault(t, Weighted(t, 0.0, False))
        w.boost = float(np.float32(w.boost) + np.float32(1.0 if boost is None else boost))
        w.pinned |= boost is not None
    for text in replace or add or ():
        for token in analyze(text, options)[0] if text is not None else ():
            w = found.setdefault(token.text, Weighted(token.text, 1.0, True))
            w.pinned = True
    stop = frozenset() if full else options.stop_words
    return [found[t] for t in sorted(found, key=lambda t: t.encode()) if t not in stop]


@dataclass
class Stats:
    n: int
    length: int
    df: dict[str, int]

    @property
    def average(self) -> np.float32:
        return np.float32(self.length) / np.float32(self.n) if self.n else np.float32(1)


def stats(docs: DataFrame, terms: Column, words: list[str]) -> Stats:
    """One aggregate over the corpus, with a row from each task."""
    has = [F.sum(F.coalesce(F.array_contains(terms, w), F.lit(False)).cast("long")) for w in words]
    size = token_count(terms)
    row = docs.where(size > 0).agg(F.count(F.lit(1)), F.sum(size), *has).first()
    return Stats(row[0] or 0, row[1] or 0, {w: row[2 + i] or 0 for i, w in enumerate(words)})


def retained(ws: list[Weighted], s: Stats, dense_ratio: float | None) -> list[Weighted]:
    """Without unpinned terms that are in dense_ratio of all documents or more; None keeps all."""
    if dense_ratio is None:
        return ws
    most = float(np.float32(dense_ratio)) * s.n
    return [w for w in ws if w.pinned or not (s.df[w.term] > 0 and s.df[w.term] >= most)]


def idf(n: int, df: int) -> np.float32:
    half = 0.5
    return np.float32(max(0.0, math.log(1 + (n - df + half) / (df + half))))


def _f(x: float) -> Column:
    return F.lit(float(np.float32(x))).cast("float")


class TermScorer:
    """The parts of one term's score for each bucket, in the order of operations that fixes its bits."""

    def __init__(self, idf_: np.float32, boost: float, k1: float, b: float, average: np.float32) -> None:
        one, k1, b = np.float32(1), np.float32(k1), np.float32(b)
        weight = np.float32(idf_) * np.float32(boost)
        self.per_length = k1 * b / np.float32(average)
        self.top = [weight * np.float32(tf) * (k1 + one) for tf in BUCKETS]
        self.low = [np.float32(tf) + k1 * (one - b) for tf in BUCKETS]

    def score(self, tf: int, length: int) -> np.float32:
        k = max((i for i, least in enumerate(BUCKETS) if tf >= least), default=0)
        return self.top[k] / (self.low[k] + self.per_length * np.float32(length))

    def column(self, tf: Column, length: Column) -> Column:
        def pick(values: list[np.float32]) -> Column:
            out = _f(values[0])
            for least, v in zip(BUCKETS[1:], values[1:], strict=True):
                out = F.when(tf >= least, _f(v)).otherwise(out)
            return out

        low = (pick(self.low) + (_f(self.per_length) * length).cast("float")).cast("float")
        return F.when(tf > 0, (pick(self.top) / low).cast("float")).otherwise(_f(0.0))


def score(terms: Column, ws: list[Weighted], s: Stats, k1: float, b: float) -> Column:
    """The sum of the terms' scores, in their order; a document without them has 0."""
    if not ws:
        return _f(0.0)
    scorers = [TermScorer(idf(s.n, s.df[w.term]), w.boost, k1, b, s.average) for w in ws]
    counts = F.struct(token_count(terms).cast("float").alias("n"), *[frequency(terms, w.term).alias(f"f{i}") for i, w in enumerate(ws)])

    def total(x: Column) -> Column:
        out = _f(0.0)
        for i, scorer in enumerate(scorers):
            out = (out + scorer.column(x[f"f{i}"], x["n"])).cast("float")
        return out

    # the length and the frequencies are bound once, not in every branch
    return F.transform(F.array(counts), total)[0]


def frequency(terms: Column, word: str) -> Column:
    return F.size(F.filter(terms, lambda t: t == word))
