"""Vectorised work on Arrow string columns: whole batches of UTF-8 text as one byte array.

A text is never cut. Batches are walked in pieces of half a megabyte of whole rows, so that memory
stays bounded by the piece size or the longest single text, whichever is larger.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Bytes of text that are worked on at once; arrays of several times 8 bytes for each of them are made.
PIECE = 1 << 19


def arrow_batches(spark) -> None:
    """Bounds Arrow batches by bytes, since a row can hold a very long text. This is a setting of the session and stays set."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * PIECE))


def tidy(run: Callable) -> Callable:
    """`run` over batches, giving free memory back at its end: the worker lives on, and other stages need the room."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return whole


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 offsets of the rows in them; a null row is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most `limit` bytes of `column`, or one row if that alone has more."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(lengths)])
    start = 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
        return x


class RangeHash:
    """Hashes of any byte ranges of a buffer, each in constant time, from running polynomial sums."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        with np.errstate(over="ignore"):
            table = mix(np.arange(1, 257, dtype=U64) * U64(_BASE) + U64(seed))
            self.sums = np.zeros(len(data) + 1, U64)
            np.cumsum(table[data] * powers(_BASE, len(data)), out=self.sums[1:])
        self.seed = U64(seed)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        back = powers(_INVERSE, int(start.max()) + 1 if len(start) else 1)
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * back[start] + (stop - start).astype(U64) * U64(0xD6E8FEB86659FD93) + self.seed)


def rolling(data: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of all ranges of `width` bytes, by start; as RangeHash gives them for ranges of one width, but by slices."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        table = mix(np.arange(1, 257, dtype=U64) * U64(_BASE) + U64(seed))
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(table[data] * powers(_BASE, len(data)), out=sums[1:])
        out = sums[width:] - sums[:n]
        out *= powers(_INVERSE, n)
        return mix(out)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and row of the maximal runs of true bytes; a run never crosses a row's end."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = inside[1:] != inside[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, stops = cuts[:-1], cuts[1:]
    keep = inside[starts]
    starts, stops = starts[keep], stops[keep]
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and row of each run of bytes other than blank, tab, line feed, \\v, \\f and \\r."""
    return runs(~_SPACE[data], offsets)


def text_pieces(texts: list[str], limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of pieces of a list of texts."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    first = 0
    for piece in pieces(batch, "t", limit):
        yield first, *utf8(piece.column("t"))
        first += piece.num_rows


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by row."""
    return np.bincount(rows, weights=values, minlength=n)
