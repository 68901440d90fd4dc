"""SentencePiece encoding and decoding by a max-plus parallel scan.

The pieces and scores of a public model file are read; a text's pieces are the path of the highest
total score (of equal ones, the longest last piece at each place), as a model read as unigram has it.
The state between two code points is how far a piece reaches over that place, 0 to the longest piece
less one. A chunk of a text is a matrix over these states: the best score of getting from a state at
its start to one at its end. Such matrices combine associatively (maximum of sums), so a giant text is
cut into chunks of CHUNK code points, wherever they fall: their matrices are computed in parallel
tasks, one small scan per text finds the states at the cuts, and each chunk then traces its own
pieces from these alone. A text of one chunk starts and ends in state 0.

Text is encoded as sentencepiece does with a dummy prefix and without other normalisation: a space
becomes U+2581, characters without a piece become byte pieces. A literal U+2581 becomes bytes too, so
decoding gives back every text exactly.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import materialize, mix, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 16
SPACE = "\u2581"
#: Stands for a literal U+2581 of a text; a decoded text never holds a lone surrogate.
LITERAL = "\udc81"
NEVER = -(1 << 60)
#: A character without a piece costs this, beyond its bytes.
UNKNOWN = -(1 << 24)
#: Words whose ids a worker keeps, characters of the texts it encodes together, longest word of a table.
MEMO, TOGETHER, LONG = 200_000, 500_000, 40


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 0x7F) << shift
        i, shift = i + 1, shift + 7
        if not b[i - 1] & 0x80:
            return out, i


def _message(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        elif key & 7 == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class Model:
    """Pieces, scores and bytes of a model file with byte fallback."""

    def __init__(self, blob: bytes) -> None:
        self.ids: dict[str, int] = {}
        self.byte = [-1] * 256
        self.out: list[bytes] = []
        score: list[float] = []
        for field, value in _message(blob):
            if field != 1:
                continue
            got = {1: b"", 2: struct.pack("<f", 0.0), 3: 1} | dict(_message(value))
            piece, kind, n = got[1].decode(), got[3], len(self.out)
            score.append(struct.unpack("<f", got[2])[0])
            if kind == 6:
                self.byte[int(piece[3:5], 16)] = n
                self.out.append(bytes([int(piece[3:5], 16)]))
            else:
                self.out.append(piece.replace(SPACE, " ").encode() if kind in (1, 4) else b"")
                if kind in (1, 4):
                    self.ids[piece] = n
        # whole numbers, so that sums are exact and alike in any order
        unit = 1 if all(x == round(x) for x in score) else 1 << 16
        self.score = [round(x * unit) for x in score]
        self.longest = max(map(len, self.ids))
        # between a piece that ends without the space mark and one that starts with it no piece reaches, unless a piece says so
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.memo: dict[str, bytes] = {}
        self.seen = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    @cached_property
    def table(self) -> dict[str, tuple[int, int] | None]:
        """Every piece as (score, id), and every beginning of one as None."""
        beginnings = {p[:k]: None for p in self.ids for k in range(1, len(p))}
        return beginnings | {p: (self.score[i], i) for p, i in self.ids.items()}

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        with open(path, "rb") as f:
            return cls(f.read())

    def forward(self, s: str, n: int, start: dict[int, int]) -> tuple[list, list]:
        """Best score and last piece (begin, id) at each place of s, from scores at the first places.

        Pieces begin before n only; s goes on beyond n, as far as pieces may reach. Of equal scores
        the one whose last piece begins first stays. Id -1 is a character as bytes."""
        table, end = self.table, len(s)
        best, back = [NEVER] * (end + 1), [None] * (end + 1)
        for i, v in start.items():
            best[i] = v
        for i in range(n):
            base = best[i]
            if base == NEVER:
                continue
            j = i + 1
            got = table.get(s[i:j], 0)
            if not got and base + UNKNOWN > best[j]:
                best[j], back[j] = base + UNKNOWN, (i, -1)
            while got != 0:  # 0: no piece begins so; None: some do, this is none
                if got is not None and base + got[0] > best[j]:
                    best[j], back[j] = base + got[0], (i, got[1])
                j += 1
                if j > end:
                    break
                got = table.get(s[i:j], 0)
        return best, back

    def pieces(self, s: str, back: list, end: int) -> bytes:
        """The ids that lead to end, as bytes of int32."""
        out: list[int] = []
        step = back[end]
        while step is not None:
            begin, k = step
            if k >= 0:
                out.append(k)
            else:
                c = s[begin:end]
                out.extend(self.byte[b] for b in reversed((SPACE if c == LITERAL else c).encode()))
            end = begin
            step = back[end]
        out.reverse()
        return struct.pack(f"<{len(out)}i", *out)

    def _trie(self) -> None:
        """The beginnings of pieces as nodes; an edge (node, character) is found by open addressing."""
        node = {"": 0} | {p: i for i, p in enumerate(self.table, 1)}
        self.piece = np.full(len(node), -1, np.int32)
        self.value = np.zeros(len(node), np.int64)
        for p, got in self.table.items():
            if got is not None:
                self.value[node[p]], self.piece[node[p]] = got
        key = np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in self.table], np.int64)
        self.mask = (1 << (4 * len(key)).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.child = np.full(self.mask + 1, -1, np.int32)
        at, todo, child = mix(key.astype(np.uint64)).astype(np.int64) & self.mask, np.arange(len(key)), np.arange(1, len(key) + 1)
        while len(todo):  # each round places one key per free slot
            free = todo[self.keys[at[todo]] == -1]
            slot, first = np.unique(at[free], return_index=True)
            self.keys[slot], self.child[slot] = key[free[first]], child[free[first]]
            todo = todo[self.keys[at[todo]] != key[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes that these characters lead to, -1 for none."""
        key = node.astype(np.int64) << 21 | char
        at = mix(key.astype(np.uint64)).astype(np.int64) & self.mask
        got = self.keys[at]
        out = np.where(got == key, self.child[at], -1)
        live = np.flatnonzero((got != key) & (got != -1))
        while len(live):
            at[live] = (at[live] + 1) & self.mask
            got = self.keys[at[live]]
            hit = got == key[live]
            out[live[hit]] = self.child[at[live[hit]]]
            live = live[~hit & (got != -1)]
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of all these words, those of one length at a time; the memo keeps MEMO of them at most."""
        out = {w: got for w in words if (got := self.memo.get(w)) is not None}
        by_length: dict[int, list[str]] = {}
        for w in words:
            if w not in out:
                by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            if n > LONG or len(group) < 16:
                for w in group:
                    out[w] = self.pieces(w, self.forward(w, n, {0: 0})[1], n)
            else:
                self._learn(n, group, out)
        for group in by_length.values():
            for w in group:
                if len(w) <= LONG:
                    if len(self.memo) >= MEMO:
                        self.memo.clear()
                    self.memo[w] = out[w]
        return out

    def _learn(self, n: int, group: list[str], known: dict[str, bytes]) -> None:
        """The forward pass and the trace back of words of n characters, as in `forward` and `pieces`."""
        if "keys" not in self.__dict__:
            self._trie()
        chars = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.int64).T.copy()
        size = len(group)
        best = np.full((n + 1, size), NEVER, np.int64)
        begin, ids = np.zeros((n + 1, size), np.int16), np.full((n + 1, size), -1, np.int32)
        best[0] = 0
        for i in range(n):
            base, rows, node = best[i], np.arange(size), np.zeros(size, np.int32)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                node = self.step(node, chars[j - 1, rows])
                if j == i + 1:  # a character without a piece, as bytes
                    none = np.flatnonzero((node < 0) | (self.piece[node] < 0))
                    worse = none[base[none] + UNKNOWN > best[j, none]]
                    best[j, worse], begin[j, worse], ids[j, worse] = base[worse] + UNKNOWN, i, -1
                some = node >= 0
                rows, node = rows[some], node[some]
                if not len(rows):
                    break
                k = self.piece[node]
                whole = np.flatnonzero(k >= 0)
                r = rows[whole]
                score = base[r] + self.value[node[whole]]
                more = score > best[j, r]
                r = r[more]
                best[j, r], begin[j, r], ids[j, r] = score[more], i, k[whole[more]]
        out, at, used = np.zeros((size, n), "<i4"), np.full(size, n), np.zeros(size, np.int64)
        odd = np.zeros(size, bool)
        live = np.arange(size)
        while len(live):
            end = at[live]
            got = ids[end, live]
            odd[live[got < 0]] = True
            used[live] += 1
            out[live, n - used[live]] = got
            at[live] = begin[end, live]
            live = live[at[live] > 0]
        raw = out.tobytes()
        for r, (w, k) in enumerate(zip(group, used.tolist(), strict=True)):
            known[w] = raw[4 * ((r + 1) * n - k) : 4 * (r + 1) * n]
        for r in np.flatnonzero(odd).tolist():
            known[group[r]] = self.pieces(group[r], self.forward(group[r], n, {0: 0})[1], n)

    def split(self, s: str) -> list[str]:
        return self.seen.findall(s) if self.cuts else [s]

    def span(self, s: str, n: int, entry: int, leave: int) -> bytes:
        """The ids of the best path from place entry of s to place n + leave, pieces beginning before n."""
        head = self._cut(s, entry, n) if self.cuts else None
        tail = self._last_cut(s, n) if head is not None else None
        if head is None or tail is None or head > tail:
            return self.pieces(s, self.forward(s, n, {entry: 0})[1], n + leave)
        # the parts between places that no piece crosses have paths of their own
        first = self.pieces(s[:head], self.forward(s[:head], head, {entry: 0})[1], head)
        last = self.pieces(s[tail:], self.forward(s[tail:], n - tail, {0: 0})[1], n - tail + leave)
        words = self.split(s[head:tail])
        known = self.learn(set(words))
        return b"".join([first, *map(known.__getitem__, words), last])

    def _cut(self, s: str, i: int, n: int) -> int | None:
        """The first place from i on, before n, that no piece crosses."""
        m = re.compile(f"(?<=[^{SPACE}]){SPACE}").search(s, i + 1, n)
        return m.start() if m else None

    def _last_cut(self, s: str, n: int) -> int | None:
        at = n
        while at > 0:
            at = s.rfind(SPACE, 0, at)
            if at <= 0:
                return None
            if s[at - 1] != SPACE:
                return at
        return None

    def matrix(self, s: str, n: int) -> np.ndarray:
        """Best score from each state at the start of the chunk s[:n] to each at its end."""
        size = self.longest
        out = np.full((size, size), NEVER, np.int64)
        head = self._cut(s, size, n) if self.cuts else None
        tail = self._last_cut(s, n) if head is not None else None
        if head is not None and tail is not None and head <= tail:
            middle = sum(self._value(w) for w in self.split(s[head:tail]))
            last, _ = self.forward(s[tail:], n - tail, {0: 0})
            for i in range(size):
                first, _ = self.forward(s[:head], head, {i: 0})
                if first[head] > NEVER:
                    for j in range(min(size, len(s) - n + 1)):
                        if last[n - tail + j] > NEVER:
                            out[i, j] = first[head] + middle + last[n - tail + j]
            return out
        for i in range(min(size, len(s) + 1)):
            best, _ = self.forward(s, n, {i: 0})
            for j in range(min(size, len(s) - n + 1)):
                if n + j <= len(s):
                    out[i, j] = best[n + j] if best[n + j] > NEVER else NEVER
        return out

    def _value(self, w: str) -> int:
        best, _ = self.forward(w, len(w), {0: 0})
        return best[len(w)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, which are one chunk each and begin and end in state 0.

        Where no piece crosses the cuts between words, a text's path is those of its words."""
        if not self.cuts:
            return [self.span(s, len(s), 0, 0) for s in map(spelled, texts)]
        out: list[bytes] = []
        for i, j in parts([len(t) for t in texts], TOGETHER):
            split = [self.split(spelled(t)) for t in texts[i:j]]
            get = self.learn(set().union(*split)).__getitem__
            out += [b"".join(map(get, words)) for words in split]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 bytes that ids spell, without the dummy prefix."""
        return b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<i4").tolist()))[1:]


def spelled(text: str) -> str:
    """The text as pieces spell it, with the dummy prefix; an empty text has none."""
    return SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE) if text else ""


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: the matrix of two chunks, one after the other."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), NEVER)


def states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each cut, first and last included, of the best path from state 0 to state 0."""
    before = [np.full(len(matrices[0]), NEVER, np.int64)]
    before[0][0] = 0
    for m in matrices:
        before.append(np.maximum((before[-1][:, None] + m).max(0), NEVER))
    out = [0]
    for m, b in zip(reversed(matrices), reversed(before[:-1]), strict=True):
        total = b + m[:, out[-1]]
        out.append(int(total.argmax()))
    return out[::-1]


def parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to most, or of one larger item."""
    i = total = 0
    for k, n in enumerate(sizes):
        if k > i and total + n > most:
            yield i, k
            i, total = k, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)


_loaded: dict[str, Model] = {}


def _model(path: str) -> Model:
    if path not in _loaded:
        _loaded[path] = Model.load(path)
    return _loaded[path]


def encode(df: DataFrame, text: str = "text", path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """df with ids, the little-endian 32-bit ids of its text as bytes.

    A null or empty text has no ids. An own column named ids is replaced. The model file must be at
    path on every machine; it is read there and never copied. Rows of a text longer than chunk go
    through the scan; only its matrices (a few hundred numbers a chunk) meet in one task."""
    small_batches(df.sparkSession)
    own = [c for c in df.columns if c != "ids"]
    df = df.select(*[F.col(f"`{c}`") for c in own])
    schema = StructType([*df.schema, StructField("ids", BinaryType())])
    at = own.index(text)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            ids = model.encode_all([t or "" for t in batch.column(at).to_pylist()])
            yield pa.record_batch([*batch.columns, pa.array(ids, pa.binary())], names=[*own, "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = _model(path).longest - 1
        for batch in batches:
            for uid, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = spelled(t)
                for k, i in enumerate(range(0, len(s), chunk)):
                    raw = s[i : i + chunk + reach].encode("utf-8", "surrogatepass")
                    yield pa.record_batch([pa.array([uid]), pa.array([k]), pa.array([min(chunk, len(s) - i)]), pa.array([raw], pa.binary())], names=["uid", "chunk", "n", "s"])

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            m = [model.matrix(raw.as_py().decode("utf-8", "surrogatepass"), n).tobytes() for raw, n in zip(batch.column(3), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(m, pa.binary())], names=["uid", "chunk", "m"])

    def scan(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        size = _model(path).longest
        at = states([np.frombuffer(m.as_py(), np.int64).reshape(size, size) for m in t.column("m")])
        return pa.table({"uid": t.column("uid"), "chunk": t.column("chunk"), "entry": pa.array(at[:-1], pa.int64()), "leave": pa.array(at[1:], pa.int64())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            n, entry, leave = (batch.column(k).to_pylist() for k in (2, 4, 5))
            ids = [model.span(raw.as_py().decode("utf-8", "surrogatepass"), *x) for raw, *x in zip(batch.column(3), n, entry, leave, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["uid", "chunk", "ids"])

    own_columns = [F.col(f"`{c}`") for c in own]
    giant = F.coalesce(F.char_length(text), F.lit(0)) >= chunk
    out = df.where(~giant).mapInArrow(small, schema)
    large = materialize(df.where(giant).select(F.struct(*own_columns).alias("row"), F.monotonically_increasing_id().alias("uid")))
    if large.isEmpty():
        return out
    # a row a chunk, spread over all tasks
    chunks = materialize(large.select("uid", F.col(f"row.`{text}`").alias("text")).mapInArrow(cut, "uid long, chunk long, n long, s binary").repartition("uid", "chunk"))
    matrices = chunks.mapInArrow(transfer, "uid long, chunk long, m binary")
    at = matrices.groupBy("uid").applyInArrow(scan, "uid long, chunk long, entry long, leave long")
    ids = chunks.join(at, ["uid", "chunk"]).select("uid", "chunk", "n", "s", "entry", "leave").mapInArrow(trace, "uid long, chunk long, ids binary")
    # a text's ids are about as many bytes as the text, which is one row too
    whole = ids.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    whole = whole.select("uid", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
    return out.unionByName(large.join(whole, "uid").select("row.*", "ids"))


def decode(df: DataFrame, ids: str = "ids", path: str = MODEL, column: str = "decoded") -> DataFrame:
    """df with the text that its ids spell; null or no ids give an empty text."""
    own = [c for c in df.columns if c != column]
    df = df.select(*[F.col(f"`{c}`") for c in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            text = [model.decode(x.as_py() or b"").decode("utf-8", "replace") for x in batch.column(own.index(ids))]
            yield pa.record_batch([*batch.columns, pa.array(text, pa.string())], names=[*own, column])

    return df.mapInArrow(run, StructType([*df.schema, StructField(column, StringType())]))
