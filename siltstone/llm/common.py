"""What the operators share: keys, Arrow helpers, rolling hashes. Column names that begin with two underscores are the operators' own."""

from __future__ import annotations

import bisect
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..staging import clear, discard, scratch, small, stage  # noqa: F401  (for the operators)

WORD_SPACE = "\x20\x09-\x0d"

#: Rows of a batch that a task turns into Python objects at a time.
SLICE_ROWS = 500


def row_key(*cols: str) -> Column:
    """128 bits that stand for a row's content. Rows that repeat share them, so that joins on it must have one row a key on the other side."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in cols]
    return F.unhex(F.md5(F.concat(*parts)))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null texts are empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives back to the system what numpy and Arrow have freed in this process."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that starts and ends without memory that was freed but is held: Python workers go on from task to task and from stage to stage."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return clean


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most so many rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and where each text starts and ends; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `limit` bytes together, or a single longer text."""
    first = 0
    n = len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Rolling:
    """Polynomial hashes modulo 2**64 of any stretch of an array of bytes, from one prefix sum."""

    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    #: Powers that a process keeps; those for longer arrays go with them.
    most = 1 << 20
    kept = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, values: np.ndarray):
        n = len(values)
        powers, self.inverses = Rolling.kept
        if n > len(powers):
            powers, self.inverses = made = tuple(self._powers(f, max(n, 1 << 16)) for f in (self.base, self.inverse))
            if n <= self.most:
                Rolling.kept = made
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[:n], out=self.prefix[1:])

    @staticmethod
    def _powers(factor: np.uint64, n: int) -> np.ndarray:
        row = np.full(n, factor, np.uint64)
        row[0] = 1
        return np.multiply.accumulate(row)

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverses[start])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class Taken:
    """Stretches of a text that are taken, kept in order; a question takes the logarithm of their number."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def take(self, a: int, b: int) -> bool:
        """Takes a stretch if nothing of it is taken; whether it did."""
        k = bisect.bisect_left(self.starts, b)
        if k and self.ends[k - 1] > a:
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True
