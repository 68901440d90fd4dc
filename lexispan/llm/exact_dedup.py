"""Exact duplicates by distributed MSD radix partitioning.

Texts, without their white space, are split into groups by their first bytes, each group by the next
bytes, and so on, until a group has one text or its texts have ended. Two texts are equal when they
were never parted; no digest decides. A digit is a run of bytes, sixteen times as long in each round.

1. Each task splits its own texts (`Radix`), HELD bytes of distinct ones at a time. Of equal ones, one
   alone goes on, so a text that a third of all rows repeat is a row per task from here.
2. These representatives are partitioned over the cluster by the first digit (by a hash of it, which only
   says where), and by the next one where a group holds more than `most` bytes. A group that no digit
   splits, one text repeated by very many tasks, is salted first: its parts are merged, then it as a whole.
3. Each partition goes on with the next bytes, which tells the classes; it keeps distinct texts only.

`exact_dedup` gives every row its class, for which narrow rows (ids and lengths) are joined to the
classes. `distinct_texts` gives the rows that stay, which whole rows reach by one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from .common import SPACE, SPACE_SQL, code_points, materialize, slices, small_batches, utf8

FIRST, GROWTH = 48, 16
#: Bytes of the first digit that partitions the cluster, of a partition, and of a group that isn't split.
SPREAD, PARTITION, MOST = 768, 32 << 20, 256 << 20
#: Bytes of distinct texts, or of rows, that a task holds at once.
HELD = 32 << 20


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_SQL + "+", "")


class Radix:
    """Distinct texts, split by their bytes as far as they need it: a group is split when a second text enters it."""

    def __init__(self, first: int = FIRST) -> None:
        self.root: dict = {}
        self.first = first

    def add(self, text: bytes, number: int) -> int:
        """The number of the equal text that came before, or this one."""
        node, at, width = self.root, 0, self.first
        while True:
            key = (text[at : at + width], len(text) <= at + width)
            got = node.get(key)
            if got is None:
                node[key] = (number, text)
                return number
            at, width = at + width, width * GROWTH
            if isinstance(got, tuple):
                if key[1]:  # both have ended
                    return got[0]
                other = got[1]
                node[key] = {(other[at : at + width], len(other) <= at + width): got}
            node = node[key]


def radix(texts: list[bytes], first: int = FIRST) -> list[int]:
    """For each text the place of the first that equals it."""
    seen = Radix(first)
    return [seen.add(t, i) for i, t in enumerate(texts)]


def stripped(arr: pa.Array) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """First row, texts without white space, and code points of the whole texts, of each slice."""
    for i, j in slices(arr):
        data, off = utf8(arr.slice(i, j - i))
        keep = ~SPACE[data]
        at = np.concatenate([[0], np.cumsum(keep)])[off]
        body = data[keep].tobytes()
        yield i, [body[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], code_points(data, off)


def _digit(norm: Column, width: int) -> Column:
    return F.xxhash64(F.substring(norm, 1, width))


def _spread(rows: DataFrame, norm: Column, most: int, width: int) -> tuple[DataFrame, int, bool]:
    """rows (with bytes) and their key: few enough bytes a key, as far as digits can split; all bytes; whether salt is set."""

    def volumes(rows: DataFrame) -> DataFrame:
        by_key = rows.groupBy("key").agg(F.sum("bytes").alias("volume"), F.max("bytes").alias("longest"))
        return materialize(by_key.select("key", "volume", "longest", (F.col("volume") > most).alias("big")))

    rows = rows.withColumn("key", _digit(norm, width))
    volume = volumes(rows)
    total = volume.agg(F.sum("volume")).first()[0] or 0
    while not (hot := volume.where(F.col("big") & (F.col("longest") > width)).select("key")).isEmpty():
        width *= GROWTH
        rows = rows.join(hot.withColumn("hot", F.lit(True)), "key", "left").withColumn("key", F.when(F.col("hot"), _digit(norm, width)).otherwise(F.col("key"))).drop("hot")
        volume = volumes(rows)
    heavy = volume.where("big").select("key", F.ceil(F.col("volume") / most).cast("int").alias("parts"))
    if heavy.isEmpty():
        return rows, total, False
    rows = rows.join(heavy, "key", "left")
    return rows.withColumn("salt", F.pmod(F.col("uid"), F.coalesce("parts", F.lit(1)))).drop("parts"), total, True


def _numbered(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[bytes], np.ndarray]]:
    """Slices of the batches with numbers of their rows, unique over all tasks, texts and code points."""
    n = TaskContext.get().partitionId() << 33
    for batch in batches:
        for i, texts, chars in stripped(batch.column(at)):
            yield batch.slice(i, len(texts)), np.arange(n, n + len(texts)), texts, chars
            n += len(texts)


def exact_dedup(df: DataFrame, text: str = "text", id_col: str = "doc_id", most: int = MOST, spread: int = SPREAD) -> DataFrame:
    """df's columns with keep_id, group_size (long) and kept.

    Of equal texts the row with the most code points stays, then the one with the smallest id (a
    null id comes last); of rows that are alike in both, one stays. A null text equals an empty one;
    texts are compared whole, however long. Own columns named keep_id, group_size or kept are replaced.
    An empty table gives no rows."""
    spark = df.sparkSession
    small_batches(spark)
    own = [c for c in df.columns if c not in ("keep_id", "group_size", "kept")]
    df = df.select(*[F.col(f"`{c}`") for c in own])
    inner = [f"c{i}" for i in range(len(own))]
    at = own.index(text)
    renamed = df.toDF(*inner)
    extra = StructType().add("uid", LongType()).add("same", LongType()).add("chars", LongType()).add("bytes", LongType()).add("first", BooleanType())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = Radix(), 0
        for batch, uid, texts, chars in _numbered(batches, at):
            same = np.array([seen.add(t, u) for t, u in zip(texts, uid.tolist(), strict=True)], np.int64)
            size = np.array([len(t) for t in texts], np.int64)
            first = same == uid
            held += int(size[first].sum())
            if held > HELD:
                seen, held = Radix(), 0
            yield pa.record_batch([*batch.columns, pa.array(uid), pa.array(same), pa.array(chars.astype(np.int64)), pa.array(size), pa.array(first)], names=[*inner, *extra.names])

    rows = materialize(renamed.mapInArrow(local, StructType([*renamed.schema, *extra])))
    reps, total, salted = _spread(rows.where("first").select("uid", "bytes", F.col(f"c{at}").alias("text")), normalised(F.col("text")).cast("binary"), most, spread)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Radix()
        for batch in batches:
            uid = batch.column(0)
            for i, texts, _ in stripped(batch.column(1)):
                part = uid.slice(i, len(texts))
                gid = [seen.add(t, u) for t, u in zip(texts, part.to_pylist(), strict=True)]
                yield pa.record_batch([part, pa.array(gid, pa.int64())], names=["same", "gid"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION + 1)
    merge = lambda reps, *by: materialize(reps.repartition(n, *by).select("uid", "text").mapInArrow(classes, "same long, gid long"))
    if salted:  # the parts of a hot text first, then what is left of it
        part = merge(reps, "key", "salt")
        left = reps.join(part.where("same = gid").select(F.col("same").alias("uid")), "uid")
        whole = merge(left, "key")
        found = materialize(part.withColumnRenamed("gid", "mid").join(whole.withColumnRenamed("same", "mid"), "mid").select("same", "gid"))
    else:
        found = merge(reps, "key")

    doc = F.col(f"c{own.index(id_col)}")
    narrow = rows.select("uid", "same", "chars", doc.alias("id")).join(found, "same")
    rank = F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid"))
    best = narrow.groupBy("gid").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best"))
    best = materialize(found.join(best, "gid").select("same", F.col("best.id").alias("keep_id"), "group_size", F.col("best.uid").alias("best")))
    out = rows.join(best, "same")
    return out.select(*[F.col(a).alias(b) for a, b in zip(inner, own, strict=True)], "keep_id", "group_size", (F.col("uid") == F.col("best")).alias("kept"))


def _best(table: pa.Table, group: np.ndarray, chars: np.ndarray, ids: pa.ChunkedArray, uid: np.ndarray) -> np.ndarray:
    """The places of each group's row that stays."""
    none = np.asarray(ids.is_null())
    value = ids.fill_null(0).to_numpy() if ids.null_count else ids.to_numpy()
    order = np.lexsort((uid, value, none, -chars, group))
    g = group[order]
    return np.sort(order[np.concatenate([[True], g[1:] != g[:-1]])]) if len(g) else order


def distinct_texts(df: DataFrame, text: str = "text", id_col: str = "doc_id", most: int = MOST, spread: int = SPREAD) -> DataFrame:
    """The rows of df that exact_dedup keeps, under the same rules; id_col holds integers.

    A task's equal texts are merged before the shuffle, so whole rows are shuffled once and only one
    of each text of a task."""
    spark = df.sparkSession
    small_batches(spark)
    own = df.columns
    inner = [f"c{i}" for i in range(len(own))]
    at, key_at = own.index(text), own.index(id_col)
    renamed = df.select(*[F.col(f"`{c}`") for c in own]).toDF(*inner)
    schema = StructType([*renamed.schema]).add("uid", LongType()).add("chars", LongType()).add("bytes", LongType())

    def stay(batches: list[pa.RecordBatch], group: list[int], more: list[np.ndarray]) -> pa.Table:
        """The rows that stay of these, with uid, chars and bytes."""
        t = pa.Table.from_batches(batches)
        uid, chars, size = more
        for name, v in zip(("uid", "chars", "bytes"), more, strict=True):
            t = t.append_column(name, pa.array(v))
        return t.take(pa.array(_best(t, np.array(group, np.int64), chars, t.column(key_at), uid)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group: list[int] = []
        more: list[list[np.ndarray]] = [[], [], []]
        seen, total = Radix(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from stay(held, group, [np.concatenate(m) for m in more]).to_batches(max_chunksize=2000)

        for batch, uid, texts, chars in _numbered(batches, at):
            held.append(batch)
            group += [seen.add(t, u) for t, u in zip(texts, uid.tolist(), strict=True)]
            for m, v in zip(more, (uid, chars.astype(np.int64), np.array([len(t) for t in texts], np.int64)), strict=True):
                m.append(v)
            total += sum(map(len, texts))
            if total > HELD:
                yield from flush()
                held, group, more, seen, total = [], [], [[], [], []], Radix(), 0
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kept, number = Radix(), None, 0
        kept_group = np.zeros(0, np.int64)
        waiting: list[pa.RecordBatch] = []
        groups: list[int] = []

        def compact() -> None:
            nonlocal kept, kept_group
            t = pa.Table.from_batches(waiting) if kept is None else pa.concat_tables([kept, pa.Table.from_batches(waiting)])
            g = np.concatenate([kept_group, np.array(groups, np.int64)])
            best = _best(t, g, t.column("chars").to_numpy(), t.column(key_at), t.column("uid").to_numpy())
            kept, kept_group = t.take(pa.array(best)), g[best]
            waiting.clear()
            groups.clear()

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for i, texts, _ in stripped(batch.column(at)):
                waiting.append(batch.slice(i, len(texts)))
                groups += [seen.add(t, number + k) for k, t in enumerate(texts)]
                number += len(texts)
                size += sum(map(len, texts))
            if size > HELD:
                compact()
                size = 0
        if waiting:
            compact()
        if kept is not None:
            yield from kept.to_batches(max_chunksize=2000)

    rows = materialize(renamed.mapInArrow(local, schema))
    rows, total, salted = _spread(rows, normalised(F.col(f"c{at}")).cast("binary"), most, spread)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION + 1)
    if salted:
        keyed = StructType([*schema]).add("key", LongType())
        rows = materialize(rows.repartition(n, "key", "salt").select(*schema.names, "key").mapInArrow(merge, keyed))
    out = rows.repartition(n, "key").select(*schema.names).mapInArrow(merge, schema)
    return out.select(*[F.col(a).alias(b) for a, b in zip(inner, own, strict=True)])
