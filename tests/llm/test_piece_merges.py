import numpy as np
import pyarrow.parquet as pq
import pytest

from lexispan.llm import sentencepiece as sp
from lexispan.llm.piece_merges import Merges, encode_merges
from lexispan.llm.queries import op10_sentencepiece

M = Merges.load()
ODD = ["", " ", "Hello world", "   three  spaces  ", "日本語 text \U0001f600\n\ttabs", "\x00 \x7f", "aaaa" * 300, "ab" * 40 + " c" * 70, "y" * 3000]


def numbers(ids):
    return np.frombuffer(bytes(ids), "<i4").tolist()


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sp.MODEL)


def test_ids_are_the_librarys(sf, library):
    for t in [*ODD, *pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()]:
        ids = M.encode_merged([t or ""])[0]
        assert numbers(ids) == library.encode(t or "") and M.decode(ids).decode() == (t or "")


def test_parts_of_giant_texts(spark, library):
    rows = [(i, t) for i, t in enumerate([*ODD, None, "a \u2581 b", "the strange ö 日本 of " * 90])]
    out = sp.decode(encode_merges(spark.createDataFrame(rows, "doc_id long, text string"), chunk=100)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.decoded == (r.text or "")
        assert sp.SPACE in (r.text or "") or numbers(r.ids) == library.encode(r.text or "")


def test_query_gives_the_librarys_numbers_of_tokens(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.n_tokens == len(library.encode(texts[r.doc_id] or "")) for r in op10_sentencepiece(spark, sf).collect())
