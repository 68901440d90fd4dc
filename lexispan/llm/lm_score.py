"""Language-model scores: a log-bilinear model, trained in numpy by noise-contrastive estimation.

Words are factored: the most frequent have a class each, the more the larger the corpus (`top_words`), the
others a class by their shape (length, last character, accents), and within a class a word has its
smoothed share of the class's counts, unknown words together having that of one more. The
log-bilinear model predicts the class from the three before it: each context class has a vector, each
place a matrix, and the product of their sum with the output vectors, normalised over all classes,
gives the class's probability. So every token, known or not, has a normalised log-probability.

1. `_blocks` turns each task's texts into word numbers of a block and the block's dictionary; no pair
   of text and word is ever a row.
2. The dictionaries meet by word, which gives exact counts over the training texts: a word has one row
   per block, however frequent it is.
3. The counts go back to their blocks, whose texts become class numbers, with the sums of the
   smoothed unigram (`base_score`) and of the shares within classes.
4. The training texts are dealt into shards of about SHARD tokens by a hash of their ids, in the order of
   the ids, so that the model does not depend on files or partitions. Each shard trains from the same
   start; the parameters are averaged by their tokens (in groups first, so that the driver gets a bounded
   number of vectors), twice.
5. Batches of class numbers are scored by matrix products, each distinct context of a batch once: what grows
   with the classes is the cost of a context, not of a token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, hash_spans, id_bucket, materialize, slices, spans, utf8

BLOCK_BYTES = 12 << 20
SHAPES = 60
#: Words with a class of their own up to so many training tokens, and how many more for each doubling: what a
#: context costs is in proportion to the classes, so they grow with the logarithm of the corpus.
TOP, TOP_TOKENS, TOP_MORE = 192, 4_000_000, 64
CONTEXT, DIM = 3, 24
SHARD = 4_000_000
BATCH, NOISE, RATE, ROUNDS = 2048, 64, 0.08, 2
#: Words whose count is this share of a partition's keep their hash, as candidates for a class of their own.
HEAVY = 20_000
GROUPS = 256
#: Contexts whose scores over all classes are held at once, as many as stay in a core's cache.
SCORED = 1024
#: Tokens of which equal contexts are normalised once: about a third are distinct. And tokens picked at once.
DISTINCT, PICKED = 1 << 20, 8192
SEED = 7


def top_words(tokens: int) -> int:
    return TOP + int(TOP_MORE * math.log2(max(1.0, tokens / TOP_TOKENS)))


def share_in_class(c: np.ndarray, mass: np.ndarray, types: np.ndarray) -> np.ndarray:
    """The share of a word of count c in a class of so much count and so many known words."""
    return (c + 0.5) / (mass + 0.5 * (types + 1))


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A class below SHAPES for each word, from its bytes."""
    last = data[ends - 1]
    tail = np.where(last == 46, 2, np.where((last >= 48) & ((last < 58) | (last > 122) & (last < 128) | (last > 57) & (last < 97)) | (last < 48), 1, 0))
    size = np.searchsorted([4, 7, 10], ends - starts, side="right")
    high = np.concatenate([np.flatnonzero(data >= 0xC0), [len(data)]])
    at = high[np.searchsorted(high, starts)]
    second = data[np.minimum(at + 1, len(data) - 1)]
    mark = np.where(at < ends, 1 + np.isin(second, [0xA4, 0xB6, 0xBC, 0x9F, 0x84, 0x96, 0x9C]) + 2 * np.isin(second, [0xB1, 0xB3, 0xA1, 0xAD, 0xBA, 0x91]), 0)
    return (tail * 20 + size * 5 + mark).astype(np.uint8)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, held_out, text) to rows of texts (tokens set) and, one a block, of dictionaries (words set)."""
    block = TaskContext.get().partitionId() << 33
    for batch in batches:
        for i, j in slices(batch.column(2), BLOCK_BYTES):
            data, off = utf8(batch.column(2).slice(i, j - i))
            data = LOWER[data]
            starts, ends, first = spans(data, off)
            codes, words = pd.factorize(hash_spans(data, starts, ends))
            count = np.bincount(codes, minlength=len(words))
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            codes = rank[codes].astype("<u4")
            held = batch.column(1).slice(i, j - i)
            learn = np.repeat(~np.asarray(held.to_pylist(), bool), np.diff(first))
            train = np.bincount(codes[learn], minlength=len(words)).astype(np.int64)
            one = np.zeros(len(words), np.int64)
            one[codes] = np.arange(len(codes))
            shape = shapes(data, starts[one], ends[one]) if len(one) else np.zeros(0, np.uint8)
            raw = codes.tobytes()
            tokens = [raw[4 * a : 4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            n = j - i
            none = lambda k: pa.nulls(k, pa.binary())
            yield pa.record_batch([pa.array(np.full(n, block)), batch.column(0).slice(i, n), held, pa.array(tokens, pa.binary()), none(n), none(n), none(n)], names=NAMES)
            parts = [pa.array([x.tobytes()], pa.binary()) for x in (words[order].view(np.int64) if len(words) else np.zeros(0, np.int64), train, shape)]
            yield pa.record_batch([pa.array([block]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), none(1), *parts], names=NAMES)
            block += 1


NAMES = ["block", "id", "held_out", "tokens", "words", "train", "shape"]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A dictionary as a row per word."""
    for batch in batches:
        for block, w, t, s in zip(batch.column(0).to_pylist(), *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            w, t, s = np.frombuffer(w, np.int64), np.frombuffer(t, np.int64), np.frombuffer(s, np.uint8)
            for k in range(0, len(w), 1 << 16):
                part = slice(k, k + (1 << 16))
                n = len(w[part])
                yield pa.record_batch([pa.array(w[part]), pa.array(np.full(n, block)), pa.array(np.arange(k, k + n, dtype=np.int32)), pa.array(t[part]), pa.array(s[part].astype(np.int16))], names=["word", "block", "lid", "train", "shape"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the words of a partition: each gets its word's count over all blocks."""
    some = [b for b in batches if b.num_rows]
    if not some:
        return
    t = pa.Table.from_batches(some)
    word, train = t.column("word").to_numpy(), t.column("train").to_numpy()
    codes, words = pd.factorize(word)
    total = np.bincount(codes, weights=train, minlength=len(words)).astype(np.int64)
    first = np.zeros(len(codes), bool)
    at = np.empty(len(words), np.int64)
    at[codes[::-1]] = np.arange(len(codes))[::-1]
    first[at] = True
    c = total[codes]
    heavy = c * HEAVY >= max(1, total.sum())
    out = pa.table([t.column("block"), t.column("lid"), pa.array(c), t.column("shape"), pa.array(first), pa.array(word, mask=~heavy)], names=COUNTED)
    yield from out.to_batches(max_chunksize=1 << 16)


COUNTED = ["block", "lid", "c", "shape", "first", "word"]


class LogBilinear:
    """Parameters for n classes in one float32 vector, viewed as arrays."""

    def __init__(self, n: int, vector: np.ndarray | None = None) -> None:
        self.n = n
        shapes = (("inp", (n + 1, DIM)), ("mat", (CONTEXT, DIM, DIM)), ("out", (n, DIM)), ("bias", (n,)))
        self.vector = vector if vector is not None else np.zeros(sum(int(np.prod(s)) for _, s in shapes), np.float32)
        at = 0
        for name, shape in shapes:
            size = int(np.prod(shape))
            setattr(self, name, self.vector[at : at + size].reshape(shape))
            at += size

    @classmethod
    def start(cls, share: np.ndarray) -> LogBilinear:
        rng = np.random.default_rng(SEED)
        m = cls(len(share))
        m.inp[:] = rng.normal(0, 0.1, m.inp.shape)
        m.out[:] = rng.normal(0, 0.1, m.out.shape)
        m.mat[:] = np.eye(DIM, dtype=np.float32) / CONTEXT
        m.bias[:] = np.log(share)
        return m

    def projected(self) -> np.ndarray:
        """What each context class adds at each place: its vector times the place's matrix, once per class."""
        return np.matmul(self.inp[None], self.mat)

    def log_sums(self, h: np.ndarray, top: np.ndarray) -> np.ndarray:
        """The log of the sum of the exponentials over all classes, for each row of h (context vectors with a 1)."""
        out = np.empty(len(h), np.float32)
        for a in range(0, len(h), SCORED):
            s = h[a : a + SCORED] @ top
            most = s.max()
            if most > 60:  # else single precision holds the sum of the exponentials
                s -= most
            np.exp(s, out=s)
            out[a : a + SCORED] = np.log(np.maximum(s.sum(1), np.float32(1e-37)))
            if most > 60:
                out[a : a + SCORED] += most
        return out

    def log10(self, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log-probabilities; ctx has a row per place. Equal contexts are normalised once."""
        each = self.projected()
        top = np.concatenate([self.out, self.bias[:, None]], 1)  # the bias is one more factor
        out = np.empty(len(target), np.float64)
        for a in range(0, len(target), DISTINCT):
            t = target[a : a + DISTINCT]
            key = ctx[0, a : a + DISTINCT].astype(np.int64)
            for j in range(1, CONTEXT):
                key *= self.n + 1
                key += ctx[j, a : a + DISTINCT]
            codes, keys = pd.factorize(key)
            h = np.ones((len(keys), DIM + 1), np.float32)
            h[:, :DIM] = 0
            for j in reversed(range(CONTEXT)):
                keys, c = np.divmod(keys, self.n + 1)
                h[:, :DIM] += each[j].take(c, 0)
            norm = self.log_sums(h, top.T.copy())
            for b in range(0, len(t), PICKED):
                k = codes[b : b + PICKED]
                out[a + b : a + b + len(k)] = np.einsum("ij,ij->i", h.take(k, 0), top.take(t[b : b + PICKED], 0)) - norm.take(k)
        return out / np.log(10)

    def train(self, ctx: np.ndarray, target: np.ndarray, share: np.ndarray, state: np.ndarray, rng: np.random.Generator) -> None:
        """Steps of NCE over batches, each with noise shared by its targets; Adagrad."""
        grad = LogBilinear(self.n)
        log_noise = np.log(NOISE * share).astype(np.float32)
        drawn = rng.choice(self.n, (-(-len(target) // BATCH), NOISE), p=share)
        for a, noise in zip(range(0, len(target), BATCH), drawn, strict=True):
            c, t = ctx[:, a : a + BATCH], target[a : a + BATCH]
            each = self.projected()
            h = each[0].take(c[0], 0)
            for j in range(1, CONTEXT):
                h += each[j].take(c[j], 0)
            right, wrong = self.out.take(t, 0), self.out.take(noise, 0)
            p = np.einsum("ij,ij->i", h, right) + (self.bias - log_noise)[t]
            up = 1 / (1 + np.exp(np.clip(p, -30, 30))) / len(t)
            q = h @ wrong.T
            q += (self.bias - log_noise)[noise]
            np.clip(q, -30, 30, out=q)
            np.exp(np.negative(q, out=q), out=q)
            q += 1
            np.divide(np.float32(1 / len(t)), q, out=q)
            grad.vector[:] = 0
            _add(grad.out, t, up[:, None] * h)
            np.add.at(grad.out, noise, -(q.T @ h))
            grad.bias += np.bincount(t, weights=up, minlength=self.n)
            np.add.at(grad.bias, noise, -q.sum(0))
            dh = up[:, None] * right - q @ wrong
            for j in range(CONTEXT):  # added up per class first, then through the matrices
                by_class = np.zeros_like(self.inp)
                _add(by_class, c[j], dh)
                grad.mat[j] += self.inp.T @ by_class
                grad.inp += by_class @ self.mat[j].T
            state += grad.vector**2
            self.vector += RATE * grad.vector / np.sqrt(state + 1e-10)


def _add(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    at = rows.astype(np.int64)[:, None] * to.shape[1] + np.arange(to.shape[1])
    to += np.bincount(at.ravel(), weights=values.ravel(), minlength=to.size).reshape(to.shape)


def contexts(classes: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and targets of all tokens, of n classes: each text is ended by n - 1 and begun by n; first token of each text."""
    lens = np.array([len(c) // 2 + 1 for c in classes], np.int64)
    at = np.concatenate([[0], np.cumsum(lens)])
    target = np.full(at[-1], n - 1, np.int64)
    inner = np.ones(at[-1], bool)
    inner[at[1:] - 1] = False
    target[inner] = np.frombuffer(b"".join(classes), "<u2")
    ctx = np.full((CONTEXT, len(target)), n, np.int16)
    target = target.astype(np.int16)
    place = np.minimum(np.arange(len(target)) - np.repeat(at[:-1], lens), CONTEXT)
    for j in range(CONTEXT):
        np.copyto(ctx[j, j + 1 :], target[: -j - 1], where=place[j + 1 :] > j)
    return ctx, target, at


def _chunks(blobs: list[bytes], size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    i, n = 0, 0
    for k, b in enumerate(blobs):
        if k > i and n + len(b) > size:
            yield i, k
            i, n = k, 0
        n += len(b) + 1
    if i < len(blobs):
        yield i, len(blobs)


def _average(key: tuple, t: pa.Table) -> pa.Table:
    t = t.sort_by("shard")
    w = t.column("n").to_numpy().astype(np.float64)
    total = np.zeros(len(t.column("v")[0].as_py()) // 4)
    for x, v in zip(w, t.column("v"), strict=True):
        total += x * np.frombuffer(v.as_py(), np.float32)
    return pa.table({"g": [key[0].as_py()], "n": [int(w.sum())], "v": pa.array([(total / w.sum()).astype(np.float32).tobytes()], pa.binary())})


def fit(coded: DataFrame, share: np.ndarray, tokens: int) -> np.ndarray:
    """The parameters, from all training texts of coded (id, held_out, classes), of so many tokens."""
    spark = coded.sparkSession
    vector = LogBilinear.start(share).vector
    count = tokens // SHARD + 1
    shard = F.pmod(F.xxhash64("id"), F.lit(count)).cast("long").alias("shard")
    dealt = coded.where("not held_out").select(shard, "id", "classes").repartition(int(count), "shard")
    dealt = materialize(dealt.sortWithinPartitions("shard", "id", "classes"))
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((vector, share))

        def run(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            start, share = shared.value

            def learn(shard: int, blobs: list[bytes]) -> pa.RecordBatch:
                model, n = LogBilinear(len(share), start.copy()), 0
                state = np.zeros(len(start), np.float32) + np.float32(1e-6)
                rng = np.random.default_rng([SEED, turn, shard])
                for i, j in _chunks(blobs):
                    ctx, target, _ = contexts(blobs[i:j], len(share))
                    order = rng.permutation(len(target))
                    model.train(ctx[:, order], target[order], share, state, rng)
                    n += len(target)
                return pa.record_batch([pa.array([shard]), pa.array([shard % GROUPS]), pa.array([n]), pa.array([model.vector.tobytes()], pa.binary())], names=["shard", "g", "n", "v"])

            now, blobs = -1, []  # a shard is whole in one file, its rows in order
            for batch in batches:
                for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if k != now and blobs:
                        yield learn(now, blobs)
                        blobs = []
                    now = k
                    blobs.append(blob)
            if blobs:
                yield learn(now, blobs)

        each = dealt.select("shard", "classes").mapInArrow(run, "shard long, g long, n long, v binary")
        rows = each.groupBy("g").applyInArrow(_average, "g long, n long, v binary").collect()  # at most GROUPS vectors
        if rows:
            rows.sort(key=lambda r: r["g"])
            vector = (sum(r["n"] * np.frombuffer(r["v"], np.float32).astype(np.float64) for r in rows) / sum(r["n"] for r in rows)).astype(np.float32)
    return vector


def lm_score(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of df.

    Rows whose id hash modulo 5 is 1 are held out and never learnt from. A null text is an empty one,
    which has the end as its only token. Without training texts all counts are 0 and the class shares
    are even. Texts are read and scored whole, however long. Scores depend on the rows alone, not on
    files or partitions; repeated rows are learnt from each time and score alike. An empty table gives no rows."""
    src = df.select(F.col(id_col).cast("long").alias("id"), (id_bucket(id_col) == 1).alias("held_out"), F.col(text).alias("text"))
    blocks = materialize(src.mapInArrow(_blocks, "block long, id long, held_out boolean, tokens binary, words binary, train binary, shape binary"))
    entries = blocks.where("words is not null").select("block", "words", "train", "shape").mapInArrow(_entries, "word long, block long, lid int, train long, shape short")
    size, count = blocks.where("words is not null").agg(F.sum(F.octet_length("shape")), F.count(F.lit(1))).first()
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, (size or 0) // 4_000_000 + 1)
    counted = materialize(entries.repartition(n, "word").mapInArrow(_counts, "block long, lid int, c long, shape short, first boolean, word long"))
    texts = blocks.where("tokens is not null")
    ends = texts.where("not held_out").count()
    words = counted.where("first")
    by_shape = {r["shape"]: (r["n"], r["v"]) for r in words.groupBy("shape").agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).collect()}
    total = sum(x for x, _ in by_shape.values()) + ends
    kinds = sum(v for _, v in by_shape.values()) + (ends > 0)
    mass, types = np.zeros(SHAPES), np.zeros(SHAPES)
    for s, (x, v) in by_shape.items():
        mass[s], types[s] = x, v
    most = top_words(total)
    top = words.where("word is not null and c > 0").orderBy(F.desc("c"), "word").limit(most).select("word", "c", "shape").collect()
    own = {}
    for k, r in enumerate(top):
        own[r["word"]] = k
        mass[r["shape"]] -= r["c"]
        types[r["shape"]] -= 1
    weight = np.concatenate([[r["c"] for r in top], np.zeros(most - len(top)), mass, [ends]]) + 0.5
    share = weight / weight.sum()
    floor = total + 0.5 * (kinds + 1)
    shared = df.sparkSession.sparkContext.broadcast((own, mass, types))

    def code(key: tuple, t: pa.Table, d: pa.Table) -> pa.Table:
        own, mass, types = shared.value
        size = d.num_rows
        lid = d.column("lid").to_numpy()
        c, shape = np.zeros(size), np.zeros(size, np.int64)
        c[lid], shape[lid] = d.column("c").to_numpy(), d.column("shape").to_numpy()
        cls = most + shape
        within = np.log10(share_in_class(c, mass[shape], types[shape]))
        for i, w in zip(lid.tolist(), d.column("word").to_pylist(), strict=True):
            if w in own:
                cls[i], within[i] = own[w], 0.0
        base, known = np.log10((c + 0.5) / floor), c > 0
        out: list[tuple] = []
        for raw in t.column("tokens"):
            x = np.frombuffer(raw.as_py(), "<u4")
            out.append((len(x) + 1, int(known[x].sum()) + (ends > 0), float(base[x].sum() + np.log10((ends + 0.5) / floor)), float(within[x].sum()), cls[x].astype("<u2").tobytes()))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        types_ = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        return pa.table([t.column("id"), t.column("held_out"), *[pa.array(v, k) for v, k in zip(cols, types_, strict=True)]], names=["id", "held_out", "n_tokens", "n_known", "base_score", "within", "classes"])

    # a few blocks a task at most, whatever the engine would put together
    tasks = max(least, 2 * count)
    one = texts.select("block", "id", "held_out", "tokens").repartition(tasks, "block").groupBy("block")
    both = one.cogroup(counted.select("block", "lid", "c", "shape", "word").repartition(tasks, "block").groupBy("block"))
    coded = materialize(both.applyInArrow(code, "id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary"))
    model = df.sparkSession.sparkContext.broadcast((len(share), fit(coded, share, int(total))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LogBilinear(*model.value)
        for batch in batches:
            blobs, out = batch.column(6).to_pylist(), []
            for i, j in _chunks(blobs, 2 * DISTINCT):
                ctx, target, at = contexts(blobs[i:j], m.n)
                out.append(np.add.reduceat(m.log10(ctx, target), at[:-1]))
            p = np.concatenate(out) if out else np.zeros(0)
            yield pa.record_batch([*batch.columns[:5], pa.array(p + batch.column(5).to_numpy(zero_copy_only=False))], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = coded.mapInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
