"""Helpers that several operators share: shared-folder tables, Arrow text buffers, vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from foliospark.tables import materialise, scratch, shared_dir  # noqa: F401

#: Bytes of text handled at once by the vectorised helpers; bounds a task's Python memory.
CHUNK_BYTES = 1 << 20


#: What a worker keeps between tasks; each entry empties one such store.
CACHES: list[Callable[[], None]] = []
#: Bytes that an Arrow batch carries between Spark and a worker, unless the session says otherwise: rows may be whole documents.
BATCH_BYTES, SPARK_BATCH_BYTES = 4 << 20, 64 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def release(keep: Callable[[], None] | None = None) -> None:
    """Give back what a worker holds (but for what `keep` would empty): workers are reused, and a task's memory must not wait for the one before."""
    for clear in CACHES:
        if clear is not keep:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keep: Callable[[], None] | None = None) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of bounded bytes; a worker starts and ends the task with nothing held.

    keep: an entry of CACHES that isn't called then, so that tasks of this kind use what the one before them found; any other task calls it.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        release(keep)
        try:
            yield from run(batches)
        finally:
            release(keep)

    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING) in (str(SPARK_BATCH_BYTES), f"{SPARK_BATCH_BYTES}b", "64m", "64MB"):
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(task, schema)


def dealt(df: DataFrame, parts: int, part: str = "part", *order: str) -> DataFrame:
    """Rows of part i (from 0) in task i, sorted by part and `order`; a hash of the number would give some tasks several parts."""
    return df.repartitionById(parts, part).sortWithinPartitions(part, *order)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows holding about limit bytes of UTF-8; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


MULTIPLIER = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
CACHES.append(_powers.clear)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER**i and its inverse**i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        out = []
        for base in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
            column = np.full(size, base, np.uint64)
            column[0] = 1
            out.append(np.cumprod(column, dtype=np.uint64))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (byte + 1) * MULTIPLIER**position over data[i:j], modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], whatever their place."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that is_word[256] allows; none crosses a text) and the words before each text."""
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside))
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.concatenate((inside, [False]))
    ends = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value: bytes of equal weight side by side, then zstd; sorted integers lose most of their high bytes."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
        out += [struct.pack("<4sQQ", a.dtype.str.encode(), len(a), len(raw)), raw]
    return b"".join(out)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<4sQQ", data, at)
        at += struct.calcsize("<4sQQ")
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        raw = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(1, n * dtype.itemsize))
        out.append(np.frombuffer(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T.tobytes(), dtype))
        at += size
    return out


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """(key, rows) of runs of equal keys in a task's sorted rows; a run is held in memory, so callers bound its size."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != held[0][key]:
                yield held[0][key], held
                held = []
            held.append(row)
    if held:
        yield held[0][key], held
