"""Terms of too many bytes: plain texts are cut in the JVM, as analyze cuts them."""

import tracemalloc
from itertools import product

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispan.functions import analysis
from lexispan.functions.analysis import Options, terms_of

TEXTS = [
    "", "...", "a bc", "short words only here", "an extraordinary Straße, déjà vu; nineteen_seventy-four 1234567890.5",
    "Überempfindlichkeit ÀÉÎÕÜàéîõü ßßßßßßßßß aßßßßßßßß æøåæøåæøå ends incomprehensibly", "incomprehensibly long to begin",
    "incomprehensibilities", "x" * 1000, "ø" * 777, "a1" * 3000, "a" + "ß" * 400, "ab c\tx\n" + "a:b'c.d" * 90 + " _ __ y_",
]


@pytest.mark.parametrize("tokenizer", ["unicode", "whitespace"])
def test_plain_texts_stay_in_the_jvm(spark, tokenizer):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").coalesce(1)
    every = [
        Options(tokenizer=tokenizer, long_tokens=long, max_token_bytes=most, position_gaps=gaps, accent_folding=accents)
        for long, most, gaps, accents in product(["truncate", "discard", "split"], [4, 5, 8, 256], ["collapse", "preserve"], ["fold", "preserve"])
    ]
    assert df.where(analysis.is_plain(F.col("text"))).count() == len(TEXTS)
    for row in df.select("text", *[analysis.native_terms(F.col("text"), o).alias(str(k)) for k, o in enumerate(every)]).collect():
        for k, o in enumerate(every):
            assert row[str(k)] == terms_of(row.text, o), (row.text[:40], o)


def test_positions_without_long_terms(spark):
    df = spark.createDataFrame([(1, "a incomprehensibly b"), (2, "incomprehensibly — b"), (3, "b incomprehensibly")], "doc_id int, text string")
    for gaps, want in (("collapse", {1: ["a", "b"], 2: ["b"], 3: ["b"]}), ("preserve", {1: ["a", None, "b"], 2: [None, "b"], 3: ["b"]})):
        got = analysis.with_terms(df, F.col("text"), Options(max_token_bytes=8, long_tokens="discard", position_gaps=gaps))
        assert {r.doc_id: r._terms for r in got.collect()} == want


def test_a_batch_is_not_held_as_lists(monkeypatch):
    """Texts that the JVM leaves to Python; the terms of all, as lists, take over 15 MB."""
    monkeypatch.setattr(analysis, "SLICE_BYTES", 1 << 16)
    texts = ["incomprehensibly — short " + " ".join(f"w{i}{k}" for k in range(300)) for i in range(800)]
    batch, options = pa.array([None, "", *texts]), Options(max_token_bytes=8, long_tokens="discard")
    tracemalloc.start()
    got = analysis.terms_of_all(batch, options)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6
    assert got.to_pylist() == [terms_of(t, options) for t in batch.to_pylist()]


def test_python_takes_unusual_texts_alone(spark):
    texts = [None, "", "incomprehensibly — short", "日本 ☂ short", "x" * (1 << 20) + " — y", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    options = Options(max_token_bytes=8, long_tokens="discard")
    for got in (df.select("i", analysis.general_terms(F.col("text"), options)), df.select("i", analysis.terms(F.col("text"), options))):
        assert [r[1] for r in sorted(got.collect())] == [terms_of(t, options) for t in texts]
