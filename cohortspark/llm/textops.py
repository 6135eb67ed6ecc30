"""Words of whole Arrow text columns as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which never occur inside a
UTF-8 sequence. Everything works on the column's own buffer in blocks of a few megabytes, so
that memory is bounded by the block (or one longer text), not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = (np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93)) ^ U64(0xA5A5A5A55A5A5A5A)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser, with wrap-around."""
    x = (x ^ (x >> U64(32))) * U64(0xBF58476D1CE4E5B9) + U64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> U64(29))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


class _Powers:
    """Powers of a base modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, U64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            steps = np.full(max(n, 2 * len(self.values)), self.base, U64)
            steps[0] = 1
            self.values = np.cumprod(steps, dtype=U64)
        return self.values[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``values[start:end]``, equal for equal sequences wherever they stand."""
    if not len(starts):
        return np.zeros(0, U64)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _UP.upto(len(values)), out=total[1:])
    raw = (total[ends] - total[starts]) * _DOWN.upto(int(starts.max()) + 1)[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(0xD1B54A32D192ED03))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have about ``limit`` bytes; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words of some rows: byte ranges, and for each row its first word's number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        gap = _SPACE[data]
        edge = np.zeros(len(data) + 1, bool)  # a text begins or ends here
        edge[offsets] = True
        before = np.ones(len(data), bool)
        before[1:] = gap[:-1]
        self.starts = np.flatnonzero(~gap & (before | edge[:-1]))
        after = np.ones(len(data), bool)
        after[:-1] = gap[1:]
        self.ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A hash per word; ``lower`` folds A-Z first."""
        if not len(self.starts):
            return np.zeros(0, U64)
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
        return range_hash(_BYTE[data], self.starts, self.ends)


def each_block(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Row ranges of a text column with their words."""
    data, offsets = column_bytes(column)
    for lo, hi in blocks(offsets, limit):
        at = offsets[lo : hi + 1]
        yield lo, hi, Words(data[at[0] : at[-1]], at - at[0])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def binary_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """``values[bounds[i]:bounds[i+1]]`` as one binary value a row."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1,
        [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))],
    ).cast(pa.binary())


def arrow_limits(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of long texts must fit beside the JVM's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
