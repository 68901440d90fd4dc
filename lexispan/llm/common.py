"""What the operators share: tables that cut lineage, and words of whole batches by numpy."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy works on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
WORD_SPACE = rb" \t-\r"
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: SQL pattern of one character between words.
SPACE_SQL = r"[\x20\x09-\x0D]"
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; where none is set, one of this machine for local runs alone."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, _local[context.applicationId][7:], ignore_errors=True)
    return _local[context.applicationId]


def materialize(df: DataFrame) -> DataFrame:
    """df as written once to the shared folder: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of text that a Python worker gets at once; with rows of some KB, ten thousand would fill it.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Bounds a Python worker's memory: a session setting, lowered only."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, BATCH_ROWS)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.startswith(shared_dir(spark).replace("file:///", "file:/").rstrip("/")) or path.startswith(shared_dir(spark)):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def id_bucket(doc_id: Column | str, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n).cast("int")


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without copying; nulls become empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(arr: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most size bytes, or of one row."""
    _, o = utf8(arr)
    i, n = 0, len(o) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + size, side="right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs without ASCII space), and the first word of each row."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~SPACE[data]
    cut = np.zeros(len(data) + 2, bool)
    cut[off + 1] = True  # a row begins at this byte
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[1:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | cut[2:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, eight bytes a step."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    at = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live, k = np.arange(len(starts)), 0
    while len(live):
        left = size[live] - k
        h[live] = mix(h[live] ^ (at[starts[live] + k] & _MASK[np.minimum(left, 8)])) + np.uint64(k)
        k += 8
        live = live[left > 8]
    return h


def windows(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words inside a row, and the first run of each row."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    idx = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], counts)
    h = words[idx] if len(idx) else np.zeros(0, np.uint64)
    for k in range(1, n):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[idx + k])
    return h, at


def code_points(data: np.ndarray, off: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
    """Code points of each row, of those bytes only that where marks."""
    lead = (data & 0xC0) != 0x80
    if where is not None:
        lead &= where
    total = np.concatenate([[0], np.cumsum(lead)])
    return total[off[1:]] - total[off[:-1]]
