"""Shared helpers: scratch tables, bounded Arrow batches, vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one Python step works on at a time.
CHUNK_BYTES = 4 << 20
#: Bytes 9-13 and 32 separate words; every other byte belongs to a word.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local session without one (a test) gets one of its own, a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go when it ends: its result is in files then. The setting before comes back."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def settle(df: DataFrame, name: str, codec: str = "zstd", level: int = 3) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and the files outlive executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with dropping_shuffles(spark):
        df.write.option("compression", codec).option("parquet.compression.codec.zstd.level", level).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, records: int = 1000, size: int = 16 << 20) -> None:
    """Keep Arrow batches small enough for long texts (the default of 10,000 records isn't); never raises a lower setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= records:
        spark.conf.set(key, str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``size`` bytes of ``column`` each (a longer value stands alone)."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(lengths) // size
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema, column: str = "text") -> DataFrame:
    """Apply ``fn`` to bounded slices of every Arrow batch."""
    bound_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, column):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of a column; a null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column and the offset of each text, without a copy where Arrow allows."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    data = column.buffers()[2]
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw, offsets - (offsets[0] if len(offsets) else 0)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of every text, and the number of words before each text.

    Words are maximal runs of bytes outside 9-13 and 32 that don't cross a text's end.
    """
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~SPACE[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    firsts = offsets[:-1][offsets[:-1] < n]
    begin[firsts] = word[firsts]
    starts = np.flatnonzero(begin)
    end = word.copy()
    end[:-1] &= ~word[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    end[lasts] = word[lasts]
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (the published splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    filled, step = 1, base
    while filled < n:
        m = min(filled, n - filled)
        out[filled : filled + m] = out[:m] * np.uint64(step % 2**64)
        filled, step = filled + m, step * step % 2**64
    return out[:n]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of every word's bytes, by eight-byte lanes in numpy: lane k of all words at once."""
    n = len(starts)
    length = ends - starts
    h = mix(length.astype(np.uint64) + np.uint64(seed))
    if not n:
        return h
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.sliding_window_view(padded, 8)
    todo = np.arange(n)
    k = 0
    while len(todo):
        at = starts[todo] + 8 * k
        left = length[todo] - 8 * k
        lane = np.ascontiguousarray(lanes[at]).view("<u8").ravel()
        keep = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        lane = np.where(keep < 64, lane & ((np.uint64(1) << np.minimum(keep, np.uint64(63))) - np.uint64(1)), lane)
        h[todo] = mix((h[todo] * np.uint64(0x9E3779B97F4A7C15)) ^ lane)
        todo = todo[left > 8]
        k += 1
    return h


def window_hashes(words: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` consecutive word hashes (runs that cross texts are the caller's to drop)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = _powers(base, size)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += words[k : k + n] * power[k]
    return mix(total)


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of each window that lies in one text, and that text's number; ``first``: words before each text."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[:-1][doc] + within, doc


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words that begins at one of ``starts``."""
    edge = np.zeros(n + size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge)[:n] > 0
