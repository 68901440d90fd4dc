"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each text are computed once, over batches, from its bytes. The trees are grown in numpy
from histograms of binned features, on a bounded sample of labelled rows, and flattened into arrays, so that a batch of
documents walks all trees by array indexing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, hash_spans, id_bucket, materialize, mix, slices, spans, utf8
from .quality_rules import base_counts

#: Labelled rows that the model is fitted on at most: those with the smallest hash of their id.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, L2 = 160, 5, 64, 0.1, 10, 1.0
_PUNCT = b".,;:!?-()\"'#*$%&|<>{}[]/\\@_=+"


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


UPPER, LOWER_, DIGIT = (_class(bytes(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
HIGH = _class(bytes(range(128, 256)))
PUNCT = {chr(c): _class(bytes([c])) for c in _PUNCT}
FEATURES = (
    "words", "chars", "bytes_a_word", "word_sd", "longest", "distinct_words", "top_word", "repeat_words", "dup_lines", "symbols",
    "upper", "lower", "digit", "high", "space", "lines", "line_words", "short_words", "long_words", "capital_words", "stop_words", "adjacent_same", "entropy", "pipe_words", "end_marks",
    *(f"p{i}" for i in range(len(_PUNCT))),
)


def features(arr: pa.Array) -> np.ndarray:
    """FEATURES of each text of a slice, as float32. An empty text has zeros."""
    data, off = utf8(arr)
    rows = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    starts, ends, first = spans(data, off)
    n = np.diff(first)
    some = np.maximum(n, 1)
    row = np.repeat(np.arange(rows), n)
    length = (ends - starts).astype(np.float64)
    words = hash_spans(data, starts, ends)
    stats = base_counts(arr)

    table = np.bincount(np.repeat(np.arange(rows) << 8, np.diff(off)) + data, minlength=rows << 8).reshape(rows, 256)

    def share(mask: np.ndarray) -> np.ndarray:
        return table[:, mask].sum(1) / size

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=x, minlength=rows) / some

    codes, uniques = pd.factorize(mix(words + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    count = np.bincount(codes, minlength=len(uniques)).astype(np.float64)
    of = np.zeros(len(uniques), np.int64)
    of[codes] = row
    order = np.lexsort((-count, of))
    rank = np.arange(len(of)) - np.searchsorted(of[order], of[order])
    top, stop = (np.bincount(of[order[rank < k]], weights=count[order[rank < k]], minlength=rows) for k in (1, 10))
    p = count / some[of]
    longest = np.zeros(rows)
    longest[n > 0] = np.maximum.reduceat(length, first[:-1][n > 0]) if len(length) else 0
    average = mean(length)
    same = np.zeros(len(words))
    if len(words) > 1:
        same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    begin, last = data[starts] if len(starts) else np.zeros(0, np.uint8), data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    lines = lines[off[1:]] - lines[off[:-1]] + 1
    cols = [
        np.log1p(n), np.log1p(size), average, np.sqrt(np.maximum(mean(length**2) - average**2, 0)), np.log1p(longest), np.bincount(of, minlength=rows) / some, top / some,
        stats["n_repeat_words"] / some, stats["n_dup_lines"] / lines, stats["n_symbols"] / size, share(UPPER), share(LOWER_), share(DIGIT), share(HIGH), share(SPACE), np.log1p(lines), n / lines,
        mean(length <= 2), mean(length >= 12), mean(UPPER[begin]), stop / some, mean(same), -np.bincount(of, weights=p * np.log(np.maximum(p, 1e-12)), minlength=rows) / np.log(some + 1), mean((length == 1) & (begin == 124)), mean((last == 46) | (last == 33) | (last == 63)),
        *(share(m) for m in PUNCT.values()),
    ]
    return np.where((np.diff(off) > 0)[:, None], np.stack(cols, 1), 0).astype(np.float32)


class Trees:
    """Boosted trees of logistic loss in flat arrays: node i of a tree has children 2i+1 and 2i+2."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) if len(c) else np.zeros(0) for c in x.T.astype(np.float64)]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1).astype(np.uint8) if len(x) else np.zeros((0, x.shape[1]), np.uint8)
        mean = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(mean / (1 - mean)))
        nodes = 2**DEPTH - 1
        self.feature = np.zeros((TREES, nodes), np.int32)
        self.cut = np.full((TREES, nodes), np.inf, np.float32)
        self.leaf = np.zeros((TREES, 2**DEPTH), np.float32)
        score = np.full(len(y), self.base)
        width = x.shape[1]
        columns = np.arange(width) * BINS
        for t in range(TREES if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            for depth in range(DEPTH):
                k = 2**depth
                flat = ((at - (k - 1)) * width * BINS)[:, None] + columns + binned
                gs, hs, ns = (np.bincount(flat.ravel(), weights=np.repeat(v, width) if v is not None else None, minlength=k * width * BINS).reshape(k, width, BINS) for v in (g, h, None))
                gl, hl, nl = (np.cumsum(v, 2)[:, :, :-1] for v in (gs, hs, ns))
                ga, ha, na = (v.sum(2, keepdims=True) for v in (gs, hs, ns))
                gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
                gain[(nl < LEAST) | (na - nl < LEAST)] = -1
                best = gain.reshape(k, -1).argmax(1)
                f, b = best // (BINS - 1), best % (BINS - 1)
                good = gain.reshape(k, -1)[np.arange(k), best] > 1e-6
                for i in np.flatnonzero(good):
                    if b[i] < len(self.cuts[f[i]]):
                        self.feature[t, k - 1 + i], self.cut[t, k - 1 + i] = f[i], self.cuts[f[i]][b[i]]
                right = x[np.arange(len(y)), self.feature[t, at]] > self.cut[t, at]
                at = 2 * at + 1 + right
            end = at - nodes
            gs, hs = (np.bincount(end, weights=v, minlength=2**DEPTH) for v in (g, h))
            self.leaf[t] = -RATE * gs / (hs + L2)
            score += self.leaf[t][end]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            score += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-score))


def statistics(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, f): the features of every document, as bytes of float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1)):
                f = features(batch.column(1).slice(i, j - i))
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in f], pa.binary())], names=["id", "f"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, f binary")


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, len(FEATURES))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(id_col, held_out, score, predicted) per row of docs.

    Fitted on labelled rows whose id hash modulo 5 is not 0, on the sample rows with the smallest
    hash of the id (all, if fewer): the figures of the sample alone reach the driver. Null text
    scores as empty text; null labels and ids aren't learnt from. Without any label the score is 0.5
    for all."""
    stats = materialize(statistics(docs, id_col, text))
    learn = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").where(id_bucket("id") != 0)
    rows = stats.join(learn, "id").orderBy(F.xxhash64("id"), "id", "y").limit(sample).select("f", "y").toArrow()
    model = Trees().fit(matrix(rows.column("f")), rows.column("y").to_numpy().astype(np.float64))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), pa.array(shared.value.predict(matrix(batch.column(1))))], names=["id", "score"])

    out = stats.mapInArrow(run, "id long, score double")
    return out.select(F.col("id").alias(id_col), (id_bucket("id") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
