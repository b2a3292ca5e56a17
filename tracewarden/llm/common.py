"""Helpers shared by the training-data operators.

Written tables go to the folder named by ``spark.checkpoint.dir`` (shared by the
driver and all executors), so a lost executor costs a re-read, never a result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
CHUNK_BYTES = 1 << 20
SMALL_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for local masters without the setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tracewarden-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized_broadcast(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast when a count (stopped just past ``limit``) proves the side small; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- vectorised text over Arrow buffers ------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), vectorised."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i, so that any range has a hash in O(1)."""
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(np.uint64) + _U(1)) * powers(_BASE, len(values)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hash of each range [start, end)."""
    with np.errstate(over="ignore"):
        h = (sums[end] - sums[start]) * powers(_BASE_INV, len(sums))[start]
        return mix(h ^ ((end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of ``column``, so per-byte temporaries stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(column).fill_null("").cast(pa.large_string())
        ends = np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # workers are kept for later stages


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word ``[^\\x20\\x09-\\x0D]+``, and the first word of each row (rows + 1 values)."""
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    first = solid[1:-1] & ~solid[:-2]
    last = solid[1:-1] & ~solid[2:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] |= solid[1:-1][inner]
    last[inner - 1] |= solid[1:-1][inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def row_of(first: np.ndarray) -> np.ndarray:
    """Row number of each item, given the first item of each row (rows + 1 values)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags in each row's range."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ``width``-word shingle of the lower-cased rows (the whole sequence where a row has fewer words), and
    each row's first shingle."""
    start, end, first = words(data, off)
    h = range_hash(prefix_sums(lower(data)), start, end)
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.zeros(len(count) + 1, np.int64)
    np.cumsum(made, out=begin[1:])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], made) + np.repeat(first[:-1], made)
    to = at + np.repeat(np.minimum(count, width), made)
    return range_hash(prefix_sums(h), at, to), begin


def unique_per_row(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row in ascending order, and each row's first."""
    row = row_of(begin)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    out = np.zeros(len(begin), np.int64)
    np.cumsum(np.bincount(row[keep], minlength=len(begin) - 1), out=out[1:])
    return h[keep], out
