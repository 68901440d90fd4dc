import corpus_pipeline
from lexispan.llm.queries import queries


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        n = out.count()
        assert n <= before or name == "mixing"
        docs, before = out, n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == before and all(r.round_trip for r in last)


def test_stages_take_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b " * 40, "en", None, 1), (3, " ".join(f"w{i}" for i in range(90)), None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == []
        got = sorted((r.doc_id for r in stage(spark, docs, sf).collect()), key=lambda x: (x is not None, x))
        if name == "quality_rules":
            assert set(got) <= {None, 3}
        elif name == "exact_dedup":  # null and empty texts are equal, the smallest id stays
            assert got == [None, 1, 3]
        elif name == "near_dedup":  # texts without words are alone; equal ids are one document
            assert got == [None, 1, 2, 2, 3]
        elif name == "sentencepiece":
            assert got == [None, 1, 2, 2, 3]
        else:
            assert set(got) <= {None, 1, 2, 3}


def test_pipeline_against_brute_force(spark, sf):
    """Stages 2 to 4 on what stage 1 keeps, by plain Python: texts, then sets of shingles, then counts of sources."""
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality_rules"](spark, docs, sf).collect()
    best = {}
    for r in first:
        k = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        if k not in best or (-len(r.text), r.doc_id) < (-len(best[k].text), best[k].doc_id):
            best[k] = r
    want = sorted(r.doc_id for r in best.values())
    second = stages["exact_dedup"](spark, spark.createDataFrame(first, docs.schema), sf)
    assert sorted(r.doc_id for r in second.collect()) == want
    sets = {}
    for r in best.values():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    up = {d: d for d in sets}

    def find(x):
        return x if up[x] == x else find(up[x])

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    third = stages["near_dedup"](spark, second, sf)
    assert sorted(r.doc_id for r in third.collect()) == [d for d in ids if find(d) == d]
    mixed = [r.doc_id for r in stages["mixing"](spark, third, sf).collect()]
    assert set(mixed) <= set(ids) and abs(len(mixed) - third.count()) < 5 * third.count() ** 0.5


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
