import re
from collections import defaultdict

import lexispan.llm.exact_dedup as module
from lexispan.llm.exact_dedup import distinct_texts, exact_dedup, radix


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d, t))
    out = []
    for g in groups.values():
        g.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(d, g[0][2], len(g), i == 0) for i, (_, _, d, _) in enumerate(g)]
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as kept", "1 as same", "2 as uid")
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df, **kw).collect()), key=repr)


def kept(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as uid", "1 as key")
    out = distinct_texts(df, **kw)
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def brute_kept(rows):
    """One row a group: by id and text, since rows alike in both can't be told apart."""
    stay = {}
    for d, t in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        rank = (-len(t or ""), d is None, d or 0)
        if k not in stay or rank < stay[k][0]:
            stay[k] = (rank, d, len(t or ""))
    return sorted(((d, n) for _, d, n in stay.values()), key=repr)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)
    assert [(d, len(t or "")) for d, t in kept(spark, rows)] == brute_kept(rows)


def test_edges_and_hot_prefixes(spark):
    long = "prefix " * 4000
    rows = [(5, None), (3, ""), (4, " \t"), (9, "a b"), (8, "ab"), (7, "a b"), (6, "ab"), (6, "ab"), (None, "ab"), (1, long), (2, long + "x"), (10, long), (11, long + "y"), (12, long + " x")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, most=50, spread=2) == brute(rows)
    assert run(spark, []) == []
    for kw in ({}, {"most": 50, "spread": 2}):
        assert sorted(((d, len(t or "")) for d, t in kept(spark, rows, **kw)), key=repr) == brute_kept(rows)
    assert kept(spark, []) == []


def test_a_hot_text_is_salted_and_windows_are_merged(spark, monkeypatch):
    """More of one text than a partition may hold, and less memory than a task's texts."""
    monkeypatch.setattr(module, "HELD", 300)
    rows = [(i, "hot text " * 5 + " " * (i % 3)) for i in range(60)] + [(100 + i, f"own {i}") for i in range(20)]
    assert run(spark, rows, most=100) == brute(rows)
    assert [(d, len(t)) for d, t in kept(spark, rows, most=100)] == brute_kept(rows)


def test_time_does_not_grow_with_the_square(spark):
    import time

    def took(n):
        texts = [b"%d" % i for i in range(n)]
        began = time.perf_counter()
        assert radix(texts) == list(range(n))
        return time.perf_counter() - began

    took(20_000)
    assert took(200_000) < 40 * took(20_000)


def test_radix_splits_by_bytes():
    texts = [b"", b"a", b"ab", b"a", b"", b"x" * 5000, b"x" * 5000 + b"y", b"x" * 5000, b"ab\0", b"ab"]
    assert radix(texts, 1) == [texts.index(t) for t in texts]
