"""Vectorised text primitives on Arrow string columns: word bounds, word hashes and shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply): one-to-one, so it adds no collisions."""
    x = x ^ (x >> np.uint64(30))  # a new array; the steps after it are in place
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _sequence(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE = _sequence(256, 7)  # a random value for each byte
BASE, BASE_INVERSE = (int(v) for v in (0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)))
POSITION = _sequence(8, 11) | np.uint64(1)
SECOND_BYTE = _sequence(256, 13)
SECOND_BASE, SECOND_INVERSE = (int(v) for v in (0xA0761D6478BD642F, pow(0xA0761D6478BD642F, -1, 1 << 64)))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        _powers[base] = have = np.multiply.accumulate(factors)
    return have[:n]


def parts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most *most* bytes or one row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1, first + 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each data[start:end], from prefix sums of a polynomial with a random value per byte.

    ``second`` gives another, independent hash.
    """
    value, base, inverse = (SECOND_BYTE, SECOND_BASE, SECOND_INVERSE) if second else (BYTE, BASE, BASE_INVERSE)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value[data] * _power(base, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(inverse, n)[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, per-row bounds) of the runs of bytes that are not white space (\\x20, \\x09-\\x0D)."""
    n = len(data)
    inside = ~SPACE[data]
    first = np.ones(n, bool)
    first[1:] = ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.ones(n, bool)
    last[:-1] = first[1:] | ~inside[1:]
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of its k-word shingles), A-Z lower-cased.

    A row of fewer words has its whole sequence as one shingle; one without words has none.
    """
    for first, end, data, offsets in parts(column):
        data = LOWER[data]
        starts, ends, bounds = words(data, offsets)
        hashes = span_hashes(data, starts, ends)
        total = len(hashes)
        rolled = np.zeros(max(total - k + 1, 0), np.uint64)
        for j in range(k if total >= k else 0):
            rolled += hashes[j : total - k + 1 + j] * POSITION[j]
        rolled = mix(rolled + np.uint64(k))
        for row in range(first, end):
            a, b = bounds[row - first], bounds[row - first + 1]
            if b - a >= k:
                yield row, np.unique(rolled[a : b - k + 1])
            elif b > a:
                short = np.uint64((hashes[a:b] * POSITION[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a))
                yield row, mix(np.array([short], np.uint64))
            else:
                yield row, np.zeros(0, np.uint64)
