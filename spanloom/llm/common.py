"""What the operators of this subpackage share: the shared folder, stored tables, joins by checked size, byte-level hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import materialise as store
from spanloom.session import shared_folder

__all__ = ["RangeHash", "mix64", "partitions", "pieces", "shared_folder", "slices", "small", "store", "trimmed", "unused", "utf8"]

#: A side of a join is broadcast only up to this many bytes (rows counted first); beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def small(df: DataFrame, rows: int, row_bytes: int = 160) -> DataFrame:
    """df with a broadcast hint if rows * row_bytes is within BROADCAST_BYTES, else df as it is, to be joined by a shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def unused(df: DataFrame, name: str) -> str:
    """A column name made from name that df doesn't have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column without nulls, without a copy of the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of up to about most bytes each (a longer row alone)."""
    out, begin, n = [], 0, len(offsets) - 1
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1
        end = min(max(end, begin + 1), n)
        out.append((begin, end))
        begin = end
    return out


def trimmed(run):
    """run, after which the task's Python worker gives free memory back: workers are reused, and what one stage held isn't kept beside the next one's."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return of


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Short slices of the batches: what a task holds as Python objects at a time stays small."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, which spreads every bit of x."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class RangeHash:
    """64-bit polynomial hashes of any byte ranges of a text, from one running sum modulo 2**64."""

    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)
    _byte = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

    def __init__(self, text: np.ndarray):
        n = len(text) + 1
        cls = type(self)
        if len(cls._up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                cls._up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _MULTIPLIER, np.uint64))])
                cls._down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _INVERSE, np.uint64))])
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n, np.uint64)
            np.cumsum(cls._byte[text] * cls._up[: n - 1], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[begin]) * self._down[begin])
