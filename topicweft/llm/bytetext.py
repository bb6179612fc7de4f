"""Texts of an Arrow batch as one byte array, with words found and hashed by numpy.

No Python object is made per word. Words are runs of bytes of a class, and all
classes used here part words at ASCII bytes only, so that working on UTF-8 bytes
gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 2 << 20
BASE, INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in spans:
        out[first : last + 1] = True
    return out


SPACES = byte_class((0x20, 0x20), (0x09, 0x0D))
NOT_SPACE = ~SPACES
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after the other and the rows' ends (0 first); null as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def chunks(batches, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of text (or one row), and their text."""
    for batch in batches:
        data, ends = buffer_of(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            last = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
            yield batch.slice(row, last - row), data[ends[row] : ends[last]], ends[row : last + 1] - ends[row]
            row = last


def runs(data: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of a class, never across rows,
    and the index of each row's first run (one more entry than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    inside = kind[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = ends[:-1][ends[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[ends[1:][ends[1:] > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, ends)


@cache
def mixed_bytes() -> np.ndarray:
    """A fixed 64-bit number for each byte value."""
    return mixed(np.arange(1, 257, dtype=U))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n; kept for chunks of usual size."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        steps = np.empty((2, size), U)
        steps[:, 0] = 1
        steps[0, 1:], steps[1, 1:] = BASE, INVERSE
        have = tuple(np.multiply.accumulate(steps, axis=1))
        if n <= 4 * CHUNK:
            _POWERS[0] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (splitmix finalizer)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * BASE**position: the difference at two places, times
    BASE**-start, is a hash of what lies between them."""
    out = np.empty(len(values) + 1, U)
    out[0] = 0
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal content."""
    return mixed((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(U))


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all spans of one width, by start."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, U)
    return mixed((sums[width:] - sums[:n]) * powers(len(sums))[1][:n] + U(width))


def word_hashes(data: np.ndarray, ends: np.ndarray, kind: np.ndarray = NOT_SPACE, lower: bool = True):
    """Hash, start and end of each word, and each row's first word (one more entry than rows)."""
    if lower:
        data = LOWERED[data]
    starts, stops, first = runs(data, ends, kind)
    return span_hashes(prefix_sums(mixed_bytes()[data]), starts, stops), starts, stops, first


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
