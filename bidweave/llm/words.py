"""Words of UTF-8 texts as NumPy arrays, for Python steps over Arrow batches.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D; these bytes never occur inside a
multi-byte character, so words of the bytes are the words of the text. Texts are read whole;
arrays of the size of the text are made for a bounded segment at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20  # bytes handled at once
SLICE = 2 << 20  # bytes of texts that a step takes from a batch at once

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes, or of a single longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of a public-domain hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _cut(data: np.ndarray, low: int, limit: int) -> int:
    """End of a segment from `low`: after white space, later than `limit` only inside a longer word."""
    high = low + limit
    if high >= len(data):
        return len(data)
    spaces = np.flatnonzero(_SPACE[data[low:high]])
    if len(spaces):
        return low + int(spaces[-1]) + 1
    while high < len(data):
        spaces = np.flatnonzero(_SPACE[data[high:high + limit]])
        if len(spaces):
            return high + int(spaces[0]) + 1
        high += limit
    return len(data)


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False, hashes: bool = True
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word, in order; fold lower-cases A to Z for the hash.

    The hash is a polynomial over the bytes, taken from prefix sums, with its bits mixed. A word
    ends at the end of its row.
    """
    starts, ends, values = [], [], []
    rows = offsets[(offsets > 0) & (offsets < len(data))]
    power = inverse = None
    low = 0
    while low < len(data):
        high = _cut(data, low, SEGMENT)
        part = data[low:high]
        inside = ~_SPACE[part]
        before = np.zeros(len(part), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(part), bool)
        after[:-1] = inside[1:]
        edges = rows[np.searchsorted(rows, low, "right"):np.searchsorted(rows, high)] - low
        before[edges] = False
        after[edges - 1] = False
        first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        if hashes:
            if power is None or len(power) < len(part) + 1:
                size = max(min(SEGMENT, len(data)), len(part)) + 1
                power, inverse = np.full(size, _BASE), np.full(size, _INVERSE)
                power[0] = inverse[0] = 1
                np.multiply.accumulate(power, out=power)
                np.multiply.accumulate(inverse, out=inverse)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[_LOWER[part] if fold else part] * power[:len(part)], out=sums[1:])
            values.append(mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)))
        starts.append(first + low)
        ends.append(last + low)
        low = high
    none = np.zeros(0, np.int64)
    return (np.concatenate(starts) if starts else none, np.concatenate(ends) if ends else none,
            np.concatenate(values) if values else np.zeros(0, np.uint64))


def row_bounds(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the first word of each row, and of the end."""
    return np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; fewer words make one shingle, none no shingle."""
    if len(hashes) == 0:
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = mix(out * _BASE + hashes[k:k + n])
    return np.unique(out)
