"""SentencePiece encoding of BPE models: the merges that the library does, word by word.

A max-plus scan (`sentencepiece`) adds up scores along a path, which is what a unigram model asks for.
A BPE model merges instead, again and again, the adjacent pair whose piece has the highest score (of
equal ones the leftmost), and no sum over a path gives these ids. Merges cannot cross a place whose two
characters follow each other in no piece, so a text is cut there, words are merged alone, and a giant
text becomes parts of at least CHUNK code points that tasks encode on their own.

Spelling, byte pieces and decoding are those of `sentencepiece`; a literal U+2581 becomes bytes, so
that decoding gives back every text, where the library takes it for a space.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import materialize, mix, small_batches
from .sentencepiece import CHUNK, LITERAL, MODEL, SPACE, Model, parts, spelled

#: Words whose ids a worker keeps in each of two generations, characters of the texts it splits together, longest word it keeps.
MEMO, TOGETHER, LONG = 100_000, 500_000, 40
#: No piece has these two symbols.
NO_PAIR = -1


class Merges(Model):
    """A model file read as BPE."""

    def __init__(self, blob: bytes) -> None:
        super().__init__(blob)
        self.rank = {p: self.score[i] for p, i in self.ids.items()}
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._symbols()

    def _symbols(self) -> None:
        """Pieces and their characters as numbers from 1; pairs that merge, found by open addressing."""
        names = list(dict.fromkeys([*self.ids, *(c for p in self.ids for c in p)]))
        number = {x: i for i, x in enumerate(names, 1)}
        self.char = {ord(x): i for x, i in number.items() if len(x) == 1}
        self.names = ["", *names]
        self.piece_of = np.array([-1, *(self.ids.get(x, -1) for x in names)], np.int32)
        pairs = {number[p[:k]] << 21 | number[p[k:]]: p for p in self.ids for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        key = np.fromiter(pairs, np.int64, len(pairs))
        self.pair_mask = (1 << (4 * len(key)).bit_length()) - 1
        self.pair_key = np.full(self.pair_mask + 1, -1, np.int64)
        self.pair_rank = np.full(self.pair_mask + 1, NO_PAIR, np.int32)
        self.pair_to = np.zeros(self.pair_mask + 1, np.int32)
        _, rank = np.unique(np.array([self.rank[p] for p in pairs.values()], np.int64), return_inverse=True)
        to = np.array([number[p] for p in pairs.values()], np.int32)
        at, todo = mix(key.astype(np.uint64)).astype(np.int64) & self.pair_mask, np.arange(len(key))
        while len(todo):  # each round places one key per free slot
            free = todo[self.pair_key[at[todo]] == -1]
            slot, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.pair_key[slot], self.pair_rank[slot], self.pair_to[slot] = key[put], rank[put], to[put]
            todo = todo[self.pair_key[at[todo]] != key[todo]]
            at[todo] = (at[todo] + 1) & self.pair_mask

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of each pair of symbols; NO_PAIR for none."""
        key = left.astype(np.int64) << 21 | right
        at = mix(key.astype(np.uint64)).astype(np.int64) & self.pair_mask
        got = self.pair_key[at]
        live = np.flatnonzero((got != key) & (got != -1))
        while len(live):
            at[live] = (at[live] + 1) & self.pair_mask
            got[live] = self.pair_key[at[live]]
            live = live[(got[live] != key[live]) & (got[live] != -1)]
        return np.where(got == key, self.pair_rank[at], np.int32(NO_PAIR)), self.pair_to[at]

    def merge_all(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words, those of one length together: each step merges the best pair of every word."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            if n == 1 or n > LONG or len(group) < 16:
                out |= {w: self.merge(w) for w in group}
            else:
                self._merge_group(n, group, out)
        return out

    def _merge_group(self, n: int, group: list[str], out: dict[str, bytes]) -> None:
        chars, code = np.unique(np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
        most = len(self.names)  # other characters have numbers from here, which no pair has
        sym = np.array([self.char.get(int(c), most + i) for i, c in enumerate(chars)], np.int32)[code].reshape(-1, n)
        rank, to = self._pairs(sym[:, :-1].ravel(), sym[:, 1:].ravel())
        rank, to = rank.reshape(-1, n - 1), to.reshape(-1, n - 1)
        where, place = np.arange(len(group)), np.arange(n)
        while len(where):
            row = np.arange(len(where))
            k = rank.argmax(1)  # of equal ones the leftmost
            done = rank[row, k] == NO_PAIR
            if done.any():
                self._finish(sym[done], group, where[done], chars, out)
                live = np.flatnonzero(~done)
                if not len(live):
                    return
                sym, rank, to, where, k, row = sym[live], rank[live], to[live], where[live], k[live], row[: len(live)]
            n -= 1  # every word that goes on has as many symbols
            sym[row, k] = to[row, k]
            after = place[:n] + (place[:n] > k[:, None])
            sym = np.take_along_axis(sym, after, 1)
            if n == 1:
                self._finish(sym, group, where, chars, out)
                return
            after = np.minimum(after[:, : n - 1], n - 1)
            rank, to = np.take_along_axis(rank, after, 1), np.take_along_axis(to, after, 1)
            for at, ok in ((k - 1, k > 0), (k, k < n - 1)):
                x = np.flatnonzero(ok)
                rank[x, at[x]], to[x, at[x]] = self._pairs(sym[x, at[x]], sym[x, at[x] + 1])

    def _finish(self, sym: np.ndarray, group: list[str], where: np.ndarray, chars: np.ndarray, out: dict[str, bytes]) -> None:
        """The ids of words that have merged to these symbols."""
        most, n = len(self.names), sym.shape[1]
        ids = np.where(sym < most, self.piece_of[np.minimum(sym, most - 1)], -1).astype("<i4")
        raw, odd = ids.tobytes(), (ids < 0).any(1)
        for i, w in enumerate(where.tolist()):
            out[group[w]] = raw[4 * n * i : 4 * n * (i + 1)]
        for i in np.flatnonzero(odd).tolist():
            out[group[where[i]]] = self._ids([self.names[x] if x < most else chr(chars[x - most]) for x in sym[i].tolist()])

    def merge(self, w: str) -> bytes:
        """The ids of a word: a short one by looking at all pairs each time, a long one by a heap."""
        rank = self.rank
        if len(w) > 24:
            return self._merge_long(w)
        sym = list(w)
        got = [rank.get(a + b) for a, b in zip(sym, sym[1:], strict=False)]
        while True:
            best, at = None, -1
            for k, v in enumerate(got):
                if v is not None and (best is None or v > best):
                    best, at = v, k
            if best is None:
                return self._ids(sym)
            sym[at : at + 2] = [sym[at] + sym[at + 1]]
            del got[at]
            if at:
                got[at - 1] = rank.get(sym[at - 1] + sym[at])
            if at < len(got):
                got[at] = rank.get(sym[at] + sym[at + 1])

    def _merge_long(self, w: str) -> bytes:
        rank, n = self.rank, len(w)
        sym: list[str] = list(w)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-rank[w[k : k + 2]], k, w[k : k + 2]) for k in range(n - 1) if w[k : k + 2] in rank]
        heapq.heapify(heap)
        while heap:
            _, k, p = heapq.heappop(heap)
            r = after[k]
            if not sym[k] or r < 0 or len(sym[k]) + len(sym[r]) != len(p):
                continue  # one side was merged since
            sym[k], sym[r], after[k] = p, "", after[r]
            if after[r] >= 0:
                before[after[r]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (q := sym[a] + sym[b]) in rank:
                    heapq.heappush(heap, (-rank[q], a, q))
        return self._ids([x for x in sym if x])

    def _ids(self, sym: list[str]) -> bytes:
        out: list[int] = []
        for p in sym:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.byte[b] for b in (SPACE if p == LITERAL else p).encode())
            else:
                out.append(i)
        return struct.pack(f"<{len(out)}i", *out)

    def merged(self, spelled_: list[str]) -> list[bytes]:
        """The ids of spelled texts or parts.

        A full memo becomes the older one, which is dropped by the next: words in use move on."""
        split = [self.split(s) for s in spelled_]
        table: dict[str, bytes] = {}
        new: list[str] = []
        for w in set().union(*split):
            got = self.known.get(w) or self.older.get(w)
            if got is None:
                new.append(w)
            else:
                table[w] = got
        table |= self.merge_all(new)
        for w, got in table.items():
            if len(w) <= LONG and w not in self.known:
                if len(self.known) >= MEMO:
                    self.known, self.older = {}, self.known
                self.known[w] = got
        return [b"".join(map(table.__getitem__, words)) for words in split]

    def encode_merged(self, texts: list[str]) -> list[bytes]:
        return [ids for i, j in parts([len(t) for t in texts], TOGETHER) for ids in self.merged([spelled(t) for t in texts[i:j]])]

    def chunks(self, s: str, chunk: int) -> Iterator[str]:
        """Parts of chunk code points or more, ending where no merge crosses."""
        i = 0
        while i < len(s):
            j = min(i + chunk, len(s))
            while j < len(s) and s[j - 1 : j + 1] in self.pairs:
                j += 1
            yield s[i:j]
            i = j


_loaded: dict[str, Merges] = {}


def _merges(path: str) -> Merges:
    if path not in _loaded:
        _loaded[path] = Merges.load(path)
    return _loaded[path]


def encode_merges(df: DataFrame, text: str = "text", path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """df with ids, the little-endian 32-bit ids of its text as bytes, by the model's merges.

    As `sentencepiece.encode` otherwise: a null or empty text has no ids, an own column named ids is
    replaced, and the model file must be at path on every machine."""
    small_batches(df.sparkSession)
    own = [c for c in df.columns if c != "ids"]
    df = df.select(*[F.col(f"`{c}`") for c in own])
    schema = StructType([*df.schema, StructField("ids", BinaryType())])
    at = own.index(text)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _merges(path)
        for batch in batches:
            ids = model.encode_merged([t or "" for t in batch.column(at).to_pylist()])
            yield pa.record_batch([*batch.columns, pa.array(ids, pa.binary())], names=[*own, "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _merges(path)
        for batch in batches:
            for uid, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, s in enumerate(model.chunks(spelled(t), chunk)):
                    yield pa.record_batch([pa.array([uid]), pa.array([k]), pa.array([s.encode("utf-8", "surrogatepass")], pa.binary())], names=["uid", "chunk", "s"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _merges(path)
        for batch in batches:
            ids = [model.merged([raw.as_py().decode("utf-8", "surrogatepass")])[0] for raw in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["uid", "chunk", "ids"])

    giant = F.coalesce(F.char_length(text), F.lit(0)) >= chunk
    out = df.where(~giant).mapInArrow(small, schema)
    large = materialize(df.where(giant).select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.monotonically_increasing_id().alias("uid")))
    if large.isEmpty():
        return out
    chunks = large.select("uid", F.col(f"row.`{text}`").alias("text")).mapInArrow(cut, "uid long, chunk long, s binary").repartition("uid", "chunk")
    ids = chunks.mapInArrow(merge, "uid long, chunk long, ids binary")
    # a text's ids are about as many bytes as the text, which is one row too
    whole = ids.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    whole = whole.select("uid", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
    return out.unionByName(large.join(whole, "uid").select("row.*", "ids"))
