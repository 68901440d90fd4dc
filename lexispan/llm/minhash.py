"""Near duplicates by min-max hashing.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Each permutation is evaluated once
and gives two signature values, its minimum and its maximum over the set, both of which agree between
two sets with a probability equal to their Jaccard similarity. As many bands of 6 values are taken as miss
a pair at the threshold with odds under 2 in a million: 28 (84 permutations) at 0.85, 44 (132) at 0.80.

1. Rows are grouped by id (repeated ids: see near_duplicates); documents with the same set (by its
   size and a 128-bit digest) are one class, so that a hot group of copies is one representative.
2. Representatives that share a band are joined to the smallest of the band: a star, not all pairs.
   The components of these stars hold every candidate pair.
3. Each component's full sets are compared (`links`): a document leads, its similarity to all others
   of the component is computed exactly, and those it links with follow it. A follower needs not lead
   if no leader of another class lies within the distance at which a link of the follower could be
   missed (Jaccard distance is a metric). A component ends early once it is one class.
4. Components too large for one task are swept by blocks of leaders that are broadcast, under the
   same rule; no link is lost and no group is gathered in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, hash_spans, materialize, slices, small_batches, spans, utf8, windows

WORDS = 5
BANDS, ROWS = 28, 6
PERMUTATIONS = BANDS * ROWS // 2
#: Links: 100 * intersection >= percent * union, by default this percent.
PERCENT = 85
#: Odds at most of missing a pair at the threshold.
MISSED = 2e-6
#: Shingles of a component that one task compares; a larger one is swept.
LOCAL_SHINGLES = 16_000_000
#: Shingles of the components that a task gets together, on average.
SHARE = 1_000_000
#: Leaders of a sweep, and the shingles of them that are broadcast at most (one leader at least).
BLOCK, BLOCK_SHINGLES = 64, 4_000_000
_rng = np.random.default_rng(9)
_XOR = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(arr: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The first row of each slice, and the sorted set of each of its rows."""
    for i, j in slices(arr):
        data, off = utf8(arr.slice(i, j - i))
        data = LOWER[data]
        starts, ends, first = spans(data, off)
        words = hash_spans(data, starts, ends)
        h, at = windows(words, first, WORDS)
        out = []
        for r in range(j - i):
            if at[r + 1] > at[r]:
                out.append(np.unique(h[at[r] : at[r + 1]]))
            elif first[r + 1] > first[r]:  # fewer words: the whole sequence is the only shingle
                w, _ = windows(words, first[r : r + 2], int(first[r + 1] - first[r]))
                out.append(w)
            else:
                out.append(np.zeros(0, np.uint64))
        yield i, out


def permutations(percent: int) -> int:
    """Permutations for an even number of bands that miss a pair at this similarity with odds under MISSED."""
    if not 50 <= percent <= 100:
        raise ValueError(f"a threshold of 50 to 100 percent is asked for, not {percent}")
    bands, miss = 2, 1 - (percent / 100) ** ROWS
    while miss**bands > MISSED:
        bands += 2
    return bands * ROWS // 2


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first PERMUTATIONS are alike for every n."""
    more = np.random.default_rng(10)
    extra = max(n - PERMUTATIONS, 0)
    xor, mul = more.integers(0, 2**32, extra, dtype=np.uint32), more.integers(0, 2**31, extra, dtype=np.uint32)
    return np.concatenate([_XOR, xor])[:n], np.concatenate([_MUL, mul * np.uint32(2) + np.uint32(1)])[:n]


def signatures(sets: list[np.ndarray], n: int = PERMUTATIONS) -> np.ndarray:
    """Minima and maxima of each permutation for non-empty sets: shape (sets, 2, permutations)."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    xor, mul = _constants(n)
    sig = np.empty((len(sets), 2, n), np.uint32)
    for k in range(n):
        x = (flat ^ xor[k]) * mul[k]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        sig[:, 0, k] = np.minimum.reduceat(x, at)
        sig[:, 1, k] = np.maximum.reduceat(x, at)
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; minimum and maximum of one permutation are in different bands."""
    bands = 2 * sig.shape[2] // ROWS
    half = sig.reshape(len(sig), bands, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), half.shape[:2]).copy()
    for k in range(ROWS):
        key = (key ^ half[:, :, k]) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    n = permutations(percent)
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        for i, sets in shingle_sets(text):
            size = np.array([len(s) for s in sets])
            some = np.flatnonzero(size)
            bands: list = [None] * len(sets)
            if len(some):
                keys = band_keys(signatures([sets[r] for r in some], n))
                for r, k in zip(some, keys, strict=True):
                    bands[r] = k
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.record_batch([ids.slice(i, len(sets)), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "digest", "bands"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable, by alternating large and small stars.

    Each step aggregates before its shuffle and joins on the node; a hot node's rows are split by
    adaptive execution. edges: (a, b), ids not null."""
    pairs = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = pairs.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
    while mark[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        step = materialize(small)
        discard(pairs)
        discard(large)
        pairs, before = step, mark
        mark = pairs.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if mark == before:
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Classes:
    """Union-find over positions, the smallest being the root."""

    def __init__(self, n: int) -> None:
        self.up, self.n = list(range(n)), n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.n -= 1


def near(inter: np.ndarray, union: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Not linked, but within twice the link's distance, where a follower of the leader may link."""
    return (100 * inter < percent * union) & (100 * inter >= (2 * percent - 100) * union)


def links(sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """For each set the first position of its class, sets being in the order of their ids."""
    n = len(sets)
    if n < 3:
        inter = len(np.intersect1d(sets[0], sets[-1], assume_unique=True))
        return [0, 0][:n] if 100 * inter >= percent * (len(sets[0]) + len(sets[-1]) - inter) else [0, 1][:n]
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    values, inverse = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(inverse, kind="stable")
    posting = owner[order]
    at = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(values)))])
    where = np.concatenate([[0], np.cumsum(size)])
    classes, led = Classes(n), np.zeros(n, bool)
    doubts: list[list[int]] = [[] for _ in range(n)]  # leaders that are near
    followed = np.zeros(n, bool)

    def settled(x: int) -> bool:
        root = classes.find(x)
        return bool(followed[x]) and all(classes.find(r) == root for r in doubts[x])

    while classes.n > 1:  # a later leader may raise doubt about an earlier follower
        late = [x for x in range(n) if not led[x] and not settled(x)]
        if not late:
            break
        for x in late:
            if classes.n == 1 or settled(x):
                continue
            led[x] = True
            mine = inverse[where[x] : where[x + 1]]
            count = at[mine + 1] - at[mine]
            idx = np.arange(count.sum()) + np.repeat(at[mine] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            inter = np.bincount(posting[idx], minlength=n)
            union = size + size[x] - inter
            for y in np.flatnonzero(100 * inter >= percent * union).tolist():
                classes.join(x, y)
                followed[y] = True
            for y in np.flatnonzero(near(inter, union, percent)).tolist():
                doubts[y].append(x)
    return [classes.find(x) for x in range(n)]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component, text) to (id, component, set)."""
    for batch in batches:
        for i, sets in shingle_sets(batch.column(2)):
            yield pa.record_batch([batch.column(0).slice(i, len(sets)), batch.column(1).slice(i, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "component", "shingles"])


def _compare(t: pa.Table, percent: int = PERCENT) -> pa.Table:
    """The classes of all components in a task's share."""
    t = t.sort_by([("component", "ascending"), ("id", "ascending")])
    ids, component = t.column("id").to_numpy(), t.column("component").to_numpy()
    sets = [s for _, part in shingle_sets(t.column("text").combine_chunks()) for s in part]
    cut = [0, *(np.flatnonzero(np.diff(component)) + 1).tolist(), len(ids)]
    label = np.empty(len(ids), np.int64)
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        label[i:j] = ids[i:j][links(sets[i:j], percent)]
    return pa.table({"id": pa.array(ids), "class_id": pa.array(label)})


def sweep(big: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, class_id) for components that are too large for a task: big has (id, component, text).

    Each round broadcasts a block of leaders; a map over all rows finds exact similarities to them.
    Link and near pairs are with leaders only. Rounds end when every row has led or is settled, by
    the rule of `links`, computed with joins."""
    spark = big.sparkSession
    rows = materialize(big.mapInArrow(_sets, "id long, component long, shingles binary"))
    state = materialize(rows.select("id", "component", F.octet_length("shingles").alias("size"), F.lit(False).alias("led"), F.lit(True).alias("open")))
    link = spark.createDataFrame([], "a long, b long")
    doubt = spark.createDataFrame([], "id long, leader long")
    while True:
        block, total = [], 0
        for r in state.where("open and not led").orderBy("id").limit(BLOCK).collect():  # a bounded block of leaders
            if block and total + r["size"] > 8 * BLOCK_SHINGLES:
                break
            block.append(r["id"])
            total += r["size"]
        if not block:
            break
        lead = {r["id"]: (r["component"], np.frombuffer(r["shingles"], np.uint64)) for r in rows.where(F.col("id").isin(block)).collect()}
        shared = spark.sparkContext.broadcast(lead)

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for x, c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    s = np.frombuffer(raw.as_py(), np.uint64)
                    for y, (cy, t) in shared.value.items():
                        if cy == c and y != x:
                            inter = len(np.intersect1d(s, t, assume_unique=True))
                            union = len(s) + len(t) - inter
                            if 100 * inter >= percent * union:
                                out.append((x, y, True))
                            elif near(np.array([inter]), np.array([union]), percent)[0]:
                                out.append((x, y, False))
                yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["id", "leader", "linked"])

        found = materialize(rows.mapInArrow(compare, "id long, leader long, linked boolean"))
        link = materialize(link.unionByName(found.where("linked").select(F.col("id").alias("a"), F.col("leader").alias("b"))))
        doubt = materialize(doubt.unionByName(found.where("not linked").select("id", "leader")))
        label = materialize(connected(link))
        mine = doubt.join(label.select(F.col("node").alias("id"), F.col("component").alias("mine")), "id", "left")
        theirs = mine.join(label.select(F.col("node").alias("leader"), F.col("component").alias("theirs")), "leader", "left")
        unsure = theirs.where("not coalesce(mine, id) <=> coalesce(theirs, leader)").select("id").distinct().withColumn("unsure", F.lit(True))
        following = link.select(F.col("a").alias("id")).distinct().withColumn("follows", F.lit(True))
        state = materialize(
            state.select("id", "component", "size", (F.col("led") | F.col("id").isin(block)).alias("led"))
            .join(unsure, "id", "left")
            .join(following, "id", "left")
            .select("id", "component", "size", "led", (F.col("follows").isNull() | F.col("unsure").isNotNull()).alias("open"))
        )
        shared.unpersist()
    return connected(link).select(F.col("node").alias("id"), F.col("component").alias("class_id"))


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", local: int = LOCAL_SHINGLES, percent: int = PERCENT) -> DataFrame:
    """A row per row of df: id_col, n_shingles, component_id, kept.

    Documents link at a similarity of percent (50 to 100) or more. component_id is the smallest id that
    links reach. A document without words is alone. Ids must
    tell documents apart: rows that repeat an id are taken as one document each with that id, and
    share its component; a null id takes part in no link and is kept, with a null component. An
    empty table gives no rows."""
    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    signed = materialize(src.mapInArrow(lambda batches: _sign(batches, percent), "id long, n long, digest binary, bands array<long>"))
    some = signed.where("digest is not null and id is not null")
    classes = some.groupBy("n", "digest").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    reps = materialize(classes)
    keys = reps.select("rep", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("least"), F.max("rep").alias("most")).where("c > 1 and least <> most")
    edges = keys.join(shared.select("band", "least"), "band").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    component = materialize(connected(edges))
    # an id that stands for two sets (repeated ids) brings both to its component
    weight = materialize(component.join(reps.groupBy("rep").agg(F.sum("n").alias("n")), component.node == F.col("rep")).groupBy("component").agg(F.sum("n").alias("shingles")))
    sized = component.join(weight, "component").select(F.col("node").alias("id"), "component", (F.col("shingles") > local).alias("big"))
    todo = src.where("id is not null").join(sized, "id").select("id", "component", "big", "text")
    total = weight.where(F.col("shingles") <= local).agg(F.sum("shingles")).first()[0] or 0
    shares = 4 + total // SHARE
    small = todo.where("not big").groupBy(F.pmod(F.hash("component"), F.lit(int(shares))).alias("share")).applyInArrow(lambda key, t: _compare(t, percent), "id long, class_id long")
    found = materialize(small.groupBy("id").agg(F.min("class_id").alias("class_id")))
    if not sized.where("big").isEmpty():
        large = sweep(todo.where("big").select("id", "component", "text").dropDuplicates(["id"]), percent)
        found = found.unionByName(large)
    # classes of equal sets follow their representative; then an id's own set and its class are one component
    member = signed.where("id is not null").join(reps.select("n", "digest", "rep"), ["n", "digest"], "left")
    member = member.select("id", F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("rep"))
    out = member.join(found.select(F.col("id").alias("rep"), "class_id"), "rep", "left")
    out = out.select("id", "n_shingles", F.coalesce("class_id", "rep").alias("component_id"))
    none = signed.where("id is null").select("id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(none).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
