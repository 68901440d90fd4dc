import zlib

import numpy as np
import pyarrow as pa

from lexispan.llm.quality_model import FEATURES, Trees, classify, features


def test_held_out_accuracy_and_independence(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").selectExpr("*", "1 as score")
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    out = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(out) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for d, r in out.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [d for d in truth if d in out and out[d].held_out]
    assert np.mean([out[d].predicted == truth[d] for d in held]) > 0.9
    one, zero = ([out[d].score for d in held if truth[d] == y] for y in (1, 0))
    assert np.mean([x > y for x in one for y in zero]) > 0.9


def test_features_do_not_depend_on_neighbours():
    texts = ["", None, "one", "A b\nA b\n", "x" * 3000, "ü é #** 12 | |", " \n "]
    all_ = features(pa.array(texts, pa.string()))
    assert all_.shape == (len(texts), len(FEATURES)) and np.isfinite(all_).all()
    for i, t in enumerate(texts):
        assert np.allclose(features(pa.array([t], pa.string()))[0], all_[i])


def test_trees_learn_a_rule_and_survive_no_rows():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    m = Trees().fit(x[:1500], y[:1500])
    assert ((m.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert np.allclose(Trees().fit(x[:0], y[:0]).predict(x[:3]), 0.5)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "word " * 2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert len(classify(docs, labels).collect()) == 4
    assert classify(docs.limit(0), labels).collect() == []
    assert len(classify(docs, labels.limit(0)).collect()) == 4
