"""Vectorised scanning of UTF-8 text in Arrow batches: word bounds and word hashes with NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned at once.
SCAN_BYTES = 1 << 20

U = np.uint64


def class_table(members: str | bytes | range | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Words are runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
NOT_BLANK = ~class_table([0x20, *range(0x09, 0x0E)])
#: Words are runs of digits, lower-case ASCII letters and bytes of other characters.
ALNUM = class_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=4)
def byte_codes(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 2**64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the offsets of their bounds."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SCAN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `limit` bytes together, or of one text."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few records, so that what a worker makes of one stays small."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def pieces(data: np.ndarray, member: np.ndarray, size: int = SCAN_BYTES) -> Iterator[np.ndarray]:
    """A long text in pieces of about `size` bytes that cut no word: each but the last ends with a byte
    that is no member."""
    a = 0
    while a < len(data):
        b = a + size
        while b < len(data):
            outside = np.flatnonzero(~member[data[b : b + size]])
            if len(outside):
                b += int(outside[0]) + 1
                break
            b += size
        yield data[a:b]
        a = b


def words(data: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the place of its first word (and the end)."""
    inside = member[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_codes(seed)[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def same_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, others: np.ndarray) -> bool:
    """Whether each word equals the word of the same length that starts at `others`."""
    total = int(lengths.sum())
    within = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return bool((data[np.repeat(starts, lengths) + within] == data[np.repeat(others, lengths) + within]).all())
