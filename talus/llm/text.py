"""Words, 64-bit hashes and Arrow batch helpers shared by the operators of this package.

Words are the runs of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text, which is what
``bytes.split()`` gives; ``bytes.lower()`` changes A-Z only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
#: Entries of a worker's word table; the table is emptied beyond it, which changes no result.
CACHE_WORDS = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    with np.errstate(over="ignore"):
        x = x + GOLDEN
        x = (x ^ (x >> _S30)) * _M1
        x = (x ^ (x >> _S27)) * _M2
        return x ^ (x >> _S31)


class WordHashes(dict):
    """word bytes -> 64-bit hash, filled on first use and bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def binary(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column's values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.string()).cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about `limit` bytes of the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, start, total = np.cumsum(sizes.astype(np.int64)), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, total + limit, side="right")))
            yield batch.slice(start, stop - start)
            total, start = int(ends[stop - 1]), stop


def packed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns of a table as one struct, so that no column of an operator's own can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in columns or df.columns])


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
