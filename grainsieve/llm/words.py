"""Words, word hashes and word n-gram hashes of whole Arrow string columns, by vector operations.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``.  A hash of a byte range
comes from one running sum over the bytes, a hash of an n-gram from one over the word hashes, so
the cost is a few operations for each byte however long the n-gram is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20250613)
BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
BYTE_BASE = np.uint64(0x9E6D62D06F6A9A9B)
WORD_BASE = np.uint64(0xC6BC279692B5CC83)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes of text worked on at a time; a longer text is a chunk by itself.
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scramble 64-bit values (the finalizer of splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as long as needed so far."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 2**64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            steps = np.full(size, self.base, dtype=np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = self.inverse
            self.down = np.multiply.accumulate(steps)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def _ranges(values: np.ndarray, powers: _Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


@dataclass
class Words:
    """Words of some texts: ``first[i]`` to ``first[i + 1]`` are those of text i."""

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams, and ``first`` of them; none crosses a text's border."""
        words = len(self.hash)
        counts = np.maximum(np.diff(self.first) - n + 1, 0)
        first = np.concatenate([[0], np.cumsum(counts)])
        if words < n:
            return np.empty(0, dtype=np.uint64), first
        inside = np.repeat(self.first[1:], np.diff(self.first))[: words - n + 1] >= np.arange(n, words + 1)
        return self.all_grams(n)[inside], first

    def all_grams(self, n: int) -> np.ndarray:
        """Hashes of the n-grams that start at each word but the last ones, across borders too."""
        at = np.arange(len(self.hash) - n + 1)
        return _ranges(self.hash, _WORDS, at, at + n)

    def whole(self, i: int) -> np.ndarray:
        """The hash of text i's whole word sequence, as an array of one."""
        a, b = self.first[i], self.first[i + 1]
        return _ranges(self.hash[a:b], _WORDS, np.array([0]), np.array([b - a]))


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive slices of a string column: index of the first text, bytes, offsets of the texts in them.

    A slice has at most ``most`` bytes, or is one longer text.  Nulls are empty texts.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def byte_range_hashes(data: np.ndarray, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ascending byte ranges, computed over slices that stay in the processor's cache."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK_BYTES, side="right")))
        a, b = start[i], end[j - 1]
        out[i:j] = _ranges(values[data[a:b]], _BYTES, start[i:j] - a, end[i:j] - a)
        i = j
    return out


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """The words of consecutive texts in ``data``; ``lower`` hashes A-Z as a-z."""
    solid = ~IS_SPACE[data]
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
        inner = offsets[offsets < len(data)]
        before[inner] = True
        after[offsets[offsets > 0] - 1] = True
    start = np.flatnonzero(solid & before)
    end = np.flatnonzero(solid & after) + 1
    hashes = byte_range_hashes(data, LOWER_VALUES if lower else BYTE_VALUES, start, end)
    return Words(data, np.searchsorted(start, offsets), start, end, hashes)
