import math
import re
import zlib
from collections import Counter

import numpy as np

from lexispan.llm import lm_score as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]


def brute(rows):
    bucket = {d: zlib.crc32(str(d).encode()) % 5 if d is not None else zlib.crc32(b"") % 5 for d, _ in rows}
    c = Counter(w for d, t in rows if bucket[d] != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {d: (bucket[d] == 1, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for d, t in rows}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as block")
    out = lm.lm_score(df).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        *exact, base = want[r.doc_id]
        assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == exact
        assert abs(r.base_score - base) < 1e-6 * abs(base) + 1e-9
        assert math.isfinite(r.score) and r.score < 0
    return out


def test_documents_and_gain_over_unigrams(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = check(spark, rows)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    check(spark, [(1, ""), (2, None), (3, "a"), (4, "ÄB ñ é. x\ty"), (None, "a b"), (6, "w" * 300 + " 1. \x0b2,")])
    assert lm.lm_score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_class_probabilities_are_normalised():
    n = 40
    m = lm.LogBilinear.start(np.full(n, 1 / n))
    ctx = np.array([[0, 5, n]] * n).T
    assert abs((10.0 ** m.log10(ctx, np.arange(n))).sum() - 1) < 1e-5


def test_probabilities_of_all_words_are_normalised():
    """Over all known words, and the unknown ones of each class, a token's probabilities add up to 1 in any context."""
    rng = np.random.default_rng(3)
    own, counts = 5, {s: rng.integers(1, 9, rng.integers(1, 30)) for s in range(7)}
    n = own + len(counts) + 1
    m = lm.LogBilinear.start(rng.dirichlet(np.ones(n)))
    m.vector += rng.normal(0, 0.3, len(m.vector)).astype(np.float32)
    for ctx in ([n, n, n], [0, n, n], [n - 2, 3, 1]):
        p = 10.0 ** m.log10(np.array([ctx] * n).T, np.arange(n))
        total = p[:own].sum() + p[-1]
        for s, c in counts.items():
            for x in [*c, 0]:
                total += p[own + s] * lm.share_in_class(x, c.sum(), len(c))
        assert abs(total - 1) < 1e-5


def test_contexts_stay_inside_their_text():
    n = 300
    blob = lambda *x: np.array(x, "<u2").tobytes()
    ctx, target, at = lm.contexts([blob(1, 280), b"", blob(3)], n)
    assert target.tolist() == [1, 280, n - 1, n - 1, 3, n - 1] and at.tolist() == [0, 3, 4, 6]
    assert ctx.tolist() == [[n, 1, 280, n, n, 3], [n, n, 1, n, n, n], [n] * 6]


def test_own_classes_grow_with_the_corpus():
    assert lm.top_words(1000) == lm.TOP < lm.top_words(10**8) < lm.top_words(10**13) < 2**15


def test_scores_do_not_depend_on_the_layout(spark, sf, monkeypatch):
    """Files, partitions and the order of rows: equal scores, with several shards; a repeated row scores as the first."""
    monkeypatch.setattr(lm, "SHARD", 9000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(3))
    some = [sorted((r.doc_id, r.base_score, r.score) for r in lm.lm_score(d).collect()) for d in (docs.coalesce(1), docs.repartition(7).sortWithinPartitions("text"))]
    assert all(abs(a - b) < 1e-6 * abs(b) for x, y in zip(*some, strict=True) for a, b in zip(x[1:], y[1:], strict=True))
    assert len({r[0] for r in some[0]}) == len({(r[0], round(r[2], 6)) for r in some[0]})


def test_a_very_long_text_among_short_ones(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 4000)
    check(spark, [(1, "word other " * 30_000), (2, "word"), (3, "other word word"), (4, "x" * 100_000), (5, None), (6, "word other"), (7, "a b c")])


def test_equal_contexts_are_normalised_once(monkeypatch):
    """The sums over all classes, whose number grows with the corpus, are for distinct contexts; the results are those of plain double precision."""
    rng = np.random.default_rng(5)
    n = 90
    m = lm.LogBilinear.start(rng.dirichlet(np.ones(n)))
    m.vector += rng.normal(0, 0.8, len(m.vector)).astype(np.float32)
    ctx = rng.integers(0, 4, (lm.CONTEXT, 5000)).astype(np.int16)
    ctx[:, 7] = n
    target = rng.integers(0, n, 5000).astype(np.int16)
    rows, sums = [], lm.LogBilinear.log_sums
    monkeypatch.setattr(lm.LogBilinear, "log_sums", lambda self, h, top: (rows.append(len(h)), sums(self, h, top))[1])
    for high in (0, 100):  # beyond what single precision holds, too
        m.bias[3] += high
        h = sum(m.inp[ctx[j]].astype(float) @ m.mat[j] for j in range(lm.CONTEXT)) @ m.out.T.astype(float) + m.bias
        want = (h[np.arange(5000), target] - h.max(1) - np.log(np.exp(h - h.max(1, keepdims=True)).sum(1))) / np.log(10)
        assert abs(m.log10(ctx, target) - want).max() < 1e-4
    assert rows == [65, 65]
    monkeypatch.setattr(lm, "DISTINCT", 777)
    assert abs(m.log10(ctx, target) - want).max() < 1e-4 and len(m.log10(ctx[:, :0], target[:0])) == 0
