import random

import numpy as np
import pytest

from lexispan.llm import sentencepiece as sp

M = sp.Model.load()
TEXTS = ["", " ", "a", "Hello world", "   three  spaces  ", "x ▁ y▁▁", "日本語 text \U0001f600\n\ttabs", "\x00 \x7f", "aaaa" * 30, " " * 50, "ab" * 40 + " c" * 70]


def score(ids: bytes) -> int:
    return sum(M.score[i] if i not in M.byte else 0 for i in np.frombuffer(ids, "<i4").tolist())


def brute(text: str) -> tuple[int, bytes]:
    """The whole path, place by place, over all pieces."""
    s = sp.spelled(text)
    best = [(0, b"")] + [(sp.NEVER, b"")] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - M.longest), end):
            p = s[start:end]
            if p in M.ids:
                v, ids = M.score[M.ids[p]], np.array([M.ids[p]], "<i4").tobytes()
            elif len(p) == 1:
                v, ids = sp.UNKNOWN, np.array([M.byte[b] for b in (sp.SPACE if p == sp.LITERAL else p).encode()], "<i4").tobytes()
            else:
                continue
            if best[start][0] + v > best[end][0]:
                best[end] = best[start][0] + v, best[start][1] + ids
    return best[-1]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip_and_best_path(text):
    ids = M.encode(text)
    assert M.decode(ids).decode() == text
    assert ids == brute(text)[1]


def chunked(text: str, chunk: int) -> bytes:
    s = sp.spelled(text)
    parts = [(s[i : i + chunk + M.longest - 1], min(chunk, len(s) - i)) for i in range(0, len(s), chunk)]
    at = sp.states([M.matrix(p, n) for p, n in parts]) if parts else [0]
    return b"".join(M.span(p, n, a, b) for (p, n), a, b in zip(parts, at[:-1], at[1:], strict=True))


def test_chunks_give_the_same_path():
    rng = random.Random(5)
    words = ["the", "international", "of", "standardization", "ß", "日本", "x" * 20, "a▁b", "\n", ""]
    for _ in range(25):
        text = " ".join(rng.choice(words) for _ in range(60))
        whole = M.encode(text)
        for chunk in (17, 33, 64, 200):
            got = chunked(text, chunk)
            assert score(got) == score(whole) and M.decode(got).decode() == text
            assert len(got) == len(whole)


def test_matrices_combine_associatively():
    s = sp.spelled("international standardization of representations " * 3)
    parts = [(s[i : i + 40 + M.longest - 1], min(40, len(s) - i)) for i in range(0, len(s), 40)]
    a, b, c = (M.matrix(*p) for p in parts[:3])
    assert (sp.combine(sp.combine(a, b), c) == sp.combine(a, sp.combine(b, c))).all()
    assert (sp.combine(a, b) == M.matrix(s[: 80 + M.longest - 1], 80)).all()


def test_library_agrees(tmp_path):
    """The library, reading the same pieces as a unigram model, finds paths of the same score."""
    spm = pytest.importorskip("sentencepiece")
    blob = open(sp.MODEL, "rb").read()
    at = 0
    fields = []
    while at < len(blob):
        key, i = sp._varint(blob, at)
        n, j = sp._varint(blob, i)
        body = blob[j : j + n]
        if key >> 3 == 2:  # trainer_spec.model_type = UNIGRAM
            out, k = b"", 0
            while k < len(body):
                kk, v = sp._varint(body, k)
                if kk & 7 == 0:
                    value, e = sp._varint(body, v)
                    out += body[k:v] + (b"\x01" if kk >> 3 == 3 else body[v:e])
                elif kk & 7 == 2:
                    m, e = sp._varint(body, v)
                    e += m
                    out += body[k:e]
                else:
                    e = v + (4 if kk & 7 == 5 else 8)
                    out += body[k:e]
                k = e
            body = out
            size, rest = len(body), b""
            while size > 127:
                rest, size = rest + bytes([size & 127 | 128]), size >> 7
            fields.append(blob[at:i] + rest + bytes([size]) + body)
        else:
            fields.append(blob[at : j + n])
        at = j + n
    lib = spm.SentencePieceProcessor(model_proto=b"".join(fields))
    for text in ["Hello world, this is it", "internationalization of standards", "le français est là", "Thntblere of then, edtioner in inea"]:
        assert lib.encode(text) == np.frombuffer(M.encode(text), "<i4").tolist()


def test_operator(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["the", "of", "strange", "ö", "日本"]) for _ in range(900))
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, long, long, "y" * 3000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as uid")
    out = sp.decode(sp.encode(df, chunk=500)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.decoded == (r.text or "")
        assert score(bytes(r.ids)) == score(M.encode(r.text or ""))
    assert sp.encode(df.limit(0)).collect() == []
