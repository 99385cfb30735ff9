"""Encode whole text columns part by part, looking parts up in a table of those seen before.

No match of the byte-level pattern holds white space after another character, so there is a border
before every space that follows something else.  Texts are cut there by vector operations; a part is
known by its 64-bit hash, and only parts that a Python worker has not met yet are encoded.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

from grainsieve.llm.words import BYTE_VALUES, byte_range_hashes, text_chunks

#: Parts beyond which a worker's table starts anew before the next block, and the bytes of text of a block.
#: A block's own parts always stand in the table together, however many they are.
MOST_PARTS = 1_500_000
BLOCK_BYTES = 1 << 20
#: New parts that are encoded at a time.
NEW_PARTS = 1 << 16

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


class HashTable:
    """64-bit keys to integers below 2^31, open addressing, all operations on whole arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys = np.zeros((1 << bits) + 4096, dtype=np.uint64)
        self.values = np.zeros(len(self.keys), dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, -1 for those that are absent; keys are not 0."""
        slots = self._slots(keys)
        held = self.keys[slots]
        found = np.where(held == keys, self.values[slots], -1)
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            slots[open_] += 1
            held = self.keys[slots[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return found

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are absent."""
        while 2 * (self.size + len(keys)) > 1 << self.bits:
            old_keys, old_values = self.keys, self.values
            self.__init__(self.bits + 1)
            full = old_keys != 0
            self.insert(old_keys[full], old_values[full])
        self.size += len(keys)
        slots = self._slots(keys)
        while len(keys):
            empty = self.keys[slots] == 0
            self.keys[slots[empty]] = keys[empty]
            placed = empty & (self.keys[slots] == keys)
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], slots[~placed] + 1


def release_memory() -> None:
    """Give what the allocators hold back to the system, where they can; a worker lives on between its tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where parts start: at a text's start and at spaces that surely follow no white space."""
    spaces = np.flatnonzero(data == 32)
    spaces = spaces[spaces > 0]
    before = data[spaces - 1]
    good = ~_ASCII_SPACE[before]
    wide = np.flatnonzero(good & (before >= 128))  # the character before may be wide white space
    at = spaces[wide]
    second = data[at - 2]
    third = data[np.maximum(at - 3, 0)]
    good[wide[(second == 0xC2) | ((third == 0xE2) & ((second == 0x80) | (second == 0x81)))
              | ((third == 0xE1) & (second == 0x9A)) | ((third == 0xE3) & (second == 0x80))]] = False
    marks = np.zeros(len(data), dtype=bool)
    marks[spaces[good]] = True
    marks[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(marks)


class PartTable:
    """Token ids of the parts met so far; ``encode`` gives those of new parts."""

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.table = HashTable()
        # part i's ids are those from first[i] to before first[i + 1]
        self.first, self.ids, self.used = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 18, dtype=np.int32), 0

    def _add(self, keys: np.ndarray, parts: Iterator[bytes]) -> None:
        n = self.table.size
        while len(self.first) <= n + len(keys):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        for i in range(0, len(keys), NEW_PARTS):
            new = self.encode(list(islice(parts, min(NEW_PARTS, len(keys) - i))))
            ids = np.concatenate(new)
            while len(self.ids) < self.used + len(ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.first[n + i + 1 : n + i + 1 + len(new)] = self.used + np.cumsum(np.fromiter(map(len, new), dtype=np.int64, count=len(new)))
            self.used += len(ids)
        self.table.insert(keys, np.arange(n, n + len(keys)))

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        starts = part_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys = byte_range_hashes(data, BYTE_VALUES, starts, ends)
        keys[keys == 0] = 1
        found = self.table.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, index = np.unique(keys[new], return_index=True)
            if self.table.size and self.table.size + len(distinct) > MOST_PARTS:
                self._clear()
                new = np.arange(len(keys))
                distinct, index = np.unique(keys, return_index=True)
            at = new[index]
            raw = data.tobytes()
            self._add(distinct, (raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)))
            found[new] = self.table.find(keys[new])
            if found.min() < 0:
                raise RuntimeError("a part of a text is missing in the table of parts")
        counts = self.first[found + 1] - self.first[found]
        ends_of_parts = np.cumsum(counts)
        total = int(ends_of_parts[-1]) if len(counts) else 0
        where = np.repeat(self.first[found] - (ends_of_parts - counts), counts) + np.arange(total)
        ids = self.ids[where]
        borders = np.concatenate([[0], ends_of_parts])[np.searchsorted(starts, offsets)]
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            yield ids[a:b]

    def column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The token ids of every text of a column; a null is an empty text."""
        for _, data, offsets in text_chunks(texts, BLOCK_BYTES):
            yield from self._block(data, offsets)
        release_memory()
