"""What the operators share: flat byte views of text columns, word hashes, paths, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in runs of about this many bytes; one longer text makes a run of its own.
CHUNK_BYTES = 1 << 19
#: Bytes of an Arrow batch on its way to a Python worker; an executor holds each several times over.
BATCH_BYTES = 2 * CHUNK_BYTES
#: The most that a size-checked broadcast may hold.
BROADCAST_BYTES = 32 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Spans of more 64-bit blocks than this are hashed one by one.
_BLOCKS = 8


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:  # a single machine, as in tests
        conf = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", conf)
    return f"{conf.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again; this cuts the lineage and survives lost executors.

    paths, if given, gets the folder, for discard().
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its counted rows, at row_bytes each, stay within limit; else df for a shuffle join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders of stored() that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        path(p).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(p), True)


#: Tables of a worker that it can make again; they go when a task ends, as workers outlive tasks and stages.
_held: dict = {}


def once(key, make: Callable):
    """make(), called once for all uses of key in a task."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def release() -> None:
    _held.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run: Callable) -> Callable:
    """run for mapInArrow; when its task ends, the worker's tables and free memory go back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches take about BATCH_BYTES at most, or less if it asks for less.

    Spark's 10,000 rows or 64 MB are all texts of a task: in the JVM's vectors, in the buffer that they are sent from
    and in the worker, whatever the runs in which texts are worked on.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], none empty; values are bytes or 32-bit. Equal contents hash alike anywhere.

    Spans are read in blocks of 64 bits, each mixed into what the blocks before gave, all spans at once.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    width = values.itemsize
    per, size = 8 // width, ends - starts
    padded = np.zeros(len(values) + per, values.dtype)
    padded[: len(values)] = values
    wide = np.ndarray(len(values) + 1, np.uint64, padded, strides=(width,))
    mask = np.array([(1 << 8 * width * k) - 1 for k in range(per + 1)], np.uint64)
    h = mix((wide[starts] & mask[np.minimum(size, per)]) + size.astype(np.uint64) * _LENGTH)
    rest, k = np.flatnonzero((size > per) & (size <= _BLOCKS * per)), per
    while len(rest):
        left = size[rest] - k
        h[rest] = mix(h[rest] * _MULT + (wide[starts[rest] + k] & mask[np.minimum(left, per)]))
        rest, k = rest[left > per], k + per
    for i in np.flatnonzero(size > _BLOCKS * per).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(values[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece take about limit bytes at most."""
    for batch in batches:
        _, offsets = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document index, start and end of each run of bytes other than 20, 09-0D; A-Z count as a-z."""
    inner = ~_WS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inner[:-1], inner[1:]
    starts = np.flatnonzero(inner & (~before | cut[:-1]))
    ends = np.flatnonzero(inner & (~after | cut[1:])) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return span_hashes(_LOWER[data], starts, ends), doc, starts, ends


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word-shingle hashes of each text, sorted, with offsets; fewer words than width make one shingle."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    h, doc, _, _ = words(data, offsets)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    h = mix(h + np.uint64(0x5851F42D4C957F2D))
    whole = np.flatnonzero((count > 0) & (count < width))
    if len(h) >= width:
        acc = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - width + 1 + k]
        ok = doc[: len(acc)] == doc[width - 1 :]
        s, d = mix(acc[ok]), doc[: len(acc)][ok]
    else:
        s, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(whole):
        extra = []
        for k in whole:
            acc1 = np.uint64(count[k])
            with np.errstate(over="ignore"):
                for x in h[first[k] : first[k + 1]]:
                    acc1 = acc1 * np.uint64(0xD6E8FEB86659FD93) + x
            extra.append(acc1)
        s, d = np.concatenate([s, mix(np.array(extra, np.uint64))]), np.concatenate([d, whole])
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[keep], d[keep]
    return s, np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n))])
