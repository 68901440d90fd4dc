import hashlib
import math
from collections import Counter

import pytest

from lexispan.llm.mixing import mix_sources


def draw(key, rate, seed):
    def one(mean, j):
        u = int(hashlib.md5(f"{seed}|{'' if key is None else key}|{j}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-mean)
        cdf = p
        while cdf <= u:
            k += 1
            p *= mean / k
            cdf += p
        return k

    parts = max(1, math.ceil(rate / 32))
    return one(rate, 0) if parts == 1 else sum(one(rate / parts, j) for j in range(1, parts + 1))


@pytest.mark.parametrize(("weights", "total"), [(None, None), ({"a": 1.0, "b": 3.0}, 400), ({"a": 0.9, "b": 0.1}, 9000)])
def test_copies(spark, weights, total):
    rows = [(i, "a" if i % 3 else "b" if i % 2 else None, f"t{i}") for i in range(150)] + [(None, "a", None), (4, "a", "t4")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "9 as copy")
    out = mix_sources(df, weights, total=total, seed=7).collect()
    n = Counter(s for _, s, _ in rows)
    w = {s: (weights.get(s, 0.0) if weights else n[s] ** 0.5) for s in n}
    rate = {s: w[s] / sum(w.values()) * (total or len(rows)) / n[s] for s in n}
    want = Counter()
    for d, s, t in rows:
        for k in range(draw(d, rate[s], 7) if rate[s] else 0):
            want[d, s, t, k] += 1
    assert Counter((r.doc_id, r.source, r.text, r.copy) for r in out) == want
    keys = [r.shuffle_key for r in out]
    assert keys == sorted(keys)
    if total == 9000:
        share = Counter(r.source for r in out)
        assert abs(share["a"] / len(out) - 0.9) < 0.02 and abs(len(out) - total) < 400


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, source string")).collect() == []


def test_query_mixes_the_texts(spark, sf):
    """op8 shuffles and sorts whole texts, and measures each copy where it ends up."""
    from lexispan.llm.queries import queries

    out = queries()["op8_mixing"](spark, sf)
    size = {r.doc_id: None if r.text is None else len(r.text.encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r["size"] == size[r.doc_id] for r in out.collect())
    plan = out._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Sort":
        plan = plan.children().head()
    assert "text" in plan.output().mkString(" ")
