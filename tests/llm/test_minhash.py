import re
from collections import defaultdict

import numpy as np
import pytest

from lexispan.llm import minhash
from lexispan.llm.minhash import links, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    own = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            own[x].append(i)
    for i, (_, s) in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in own[x]:
                if j > i:
                    common[j] += 1
        for j, c in common.items():
            if 100 * c >= 85 * (len(s) + len(sets[j][1]) - c):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, (d, s) in enumerate(sets))


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in near_duplicates(df, **kw).collect())


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(12):
        base = list(rng.choice(vocabulary, 160))
        for _ in range(int(rng.integers(1, 14))):
            w = list(base)
            for at in rng.choice(160, int(rng.integers(0, 6)), replace=False):
                w[at] = str(rng.choice(vocabulary))
            rows.append((k, " ".join(w)))
            k += 3
    rows += [(k + 1, ""), (k + 2, None), (k + 3, "Two Words"), (k + 4, "two  words"), (k + 5, "two"), (k + 6, "   ")]
    return rows


def test_planted(spark, planted):
    assert run(spark, planted) == brute(planted)


def test_sweep_of_large_components(spark, planted):
    assert run(spark, planted, local=300) == brute(planted)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]
    text = " ".join(f"a{i}" for i in range(30))
    out = run(spark, [(7, text), (7, text), (3, text + " "), (9, "b c")])
    assert out == [(3, 26, 3, True), (7, 26, 3, False), (7, 26, 3, False), (9, 1, 9, True)]
    df = spark.createDataFrame([(None, text), (2, text)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in near_duplicates(df.selectExpr("doc_id", "text", "'x' as component_id", "1 as kept")).collect()}
    assert got == {None: True, 2: True}


def test_no_link_is_lost_in_a_chain():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[8 * i :], rng.integers(0, 2**63, 8 * i).astype(np.uint64)])) for i in range(12)]
    order = rng.permutation(12)
    got = links([sets[i] for i in order])
    want = list(range(12))
    for _ in range(12):
        for i in range(12):
            for j in range(12):
                a, b = sets[order[i]], sets[order[j]]
                inter = len(np.intersect1d(a, b))
                if 100 * inter >= 85 * (len(a) + len(b) - inter):
                    want[i] = want[j] = min(want[i], want[j])
    assert got == want


def test_minimum_and_maximum_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 1200).astype(np.uint64)
    x, y = np.unique(a[:1000]), np.unique(a[200:])
    s = minhash.signatures([x, y])
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.12


def test_threshold_is_a_parameter(spark):
    """Texts at a similarity of 0.82 are near duplicates in the pipeline's stage, not in op9."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(204)]
    other = [*words[:184], *(f"v{i}" for i in range(20))]
    a, b = shingles(" ".join(words)), shingles(" ".join(other))
    assert 80 <= 100 * len(a & b) / len(a | b) < 85
    rows = [(1, " ".join(words), "en", "s"), (2, " ".join(other), "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert [r.kept for r in near_duplicates(df).orderBy("doc_id").collect()] == [True, True]
    assert [r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()] == [1]
    assert [r.kept for r in near_duplicates(df, local=0, percent=80).orderBy("doc_id").collect()] == [True, False]
    assert [minhash.permutations(p) for p in (85, 80)] == [84, 132]
