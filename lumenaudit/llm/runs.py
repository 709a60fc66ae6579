"""Vectorised splitting and fingerprinting of byte runs (words, pre-tokens) inside Arrow batches.

A batch's texts lie end to end in one byte buffer. Every operator that looks at words works on arrays of run starts over that buffer;
a run is known by a 64-bit fingerprint of its bytes, and what is computed for a distinct run is kept per worker in a RunCache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
#: Fingerprint = sum over a run's bytes of VALUE[byte] * PLACE[position], with fixed random 64-bit factors, then a finaliser.
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The bytes of ASCII white space.
SPACES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], np.uint8)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[SPACES] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_chunks(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, one past the last, bytes, bounds): rows in order, about most_bytes together, one row at least. A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        to = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1)
        to = min(to, n)
        yield first, to, data[offsets[first] : offsets[to]], offsets[first : to + 1] - offsets[first]
        first = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_starts(data: np.ndarray, bounds: np.ndarray, is_space: np.ndarray = IS_SPACE) -> np.ndarray:
    """Where a word begins: a byte that is no space, at a text's start or after a space."""
    inside = ~is_space[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = bounds[:-1][np.diff(bounds) > 0]
    begins[heads] = inside[heads]
    return np.flatnonzero(begins)


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ignore: np.ndarray = IS_SPACE) -> np.ndarray:
    """64-bit fingerprints of data[start:end]; between one run's end and the next start there are only ignored bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    base, stop = int(starts[0]), int(ends[-1])
    value = np.where(ignore, np.uint64(0), _VALUE)
    gaps = np.diff(np.append(starts, stop))
    place = np.arange(stop - base) - np.repeat(starts - base, gaps)
    np.minimum(place, len(_PLACE) - 1, out=place)
    h = np.add.reduceat(value[data[base:stop]] * _PLACE[place], starts - base)
    h = mix(h + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts >= len(_PLACE)):
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    h[h == 0] = 1
    return h


def word_ends(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, is_space: np.ndarray = IS_SPACE) -> np.ndarray:
    """One past the last byte of each word."""
    inside = ~is_space[data]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = bounds[1:][np.diff(bounds) > 0] - 1
    last[tails] = inside[tails]
    return np.flatnonzero(last) + 1


class RunCache:
    """Fingerprint -> row number of what was computed for that run: an open-addressed table in two arrays."""

    def __init__(self, most: int = 1_000_000):
        self.most = most
        self.clear()

    def clear(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row numbers; -1 where unknown."""
        slot, out = self._slot(h), np.full(len(h), -1, np.int64)
        key = self.keys[slot]
        hit = key == h
        out[hit] = self.rows[slot[hit]]
        left = np.flatnonzero(~hit & (key != 0))
        mask = (1 << self.bits) - 1
        at = slot[left]
        while len(left):
            at = (at + 1) & mask
            key = self.keys[at]
            hit = key == h[left]
            out[left[hit]] = self.rows[at[hit]]
            go = ~hit & (key != 0)
            left, at = left[go], at[go]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Give new, distinct fingerprints the next row numbers."""
        rows = np.arange(self.n, self.n + len(h))
        if (self.n + len(h)) * 2 > len(self.keys):
            used = self.keys != 0
            keys, old = self.keys[used], self.rows[used]
            while (self.n + len(h)) * 2 > 1 << self.bits:
                self.bits += 1
            self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(keys, old)
        self._put(h, rows)
        self.n += len(h)
        return rows

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at, left = self._slot(h), np.arange(len(h))
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[left[free]]
            mine = self.keys[at] == h[left]
            self.rows[at[mine]] = rows[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & mask

    def full(self) -> bool:
        return self.n > self.most


class Ragged:
    """Growing rows of integers, end to end."""

    def __init__(self, dtype=np.uint32):
        self.flat, self.starts, self.sizes = np.empty(1 << 12, dtype), np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int64)
        self.n_flat = self.n = 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.n_flat + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(sizes) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.empty_like(a)]) for a in (self.starts, self.sizes))
        self.flat[self.n_flat : self.n_flat + len(flat)] = flat
        self.starts[self.n : self.n + len(sizes)] = self.n_flat + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.n_flat += len(flat)
        self.n += len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the rows end to end, their sizes)"""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - ends + sizes, sizes)
        return self.flat[where], sizes


def per_text(values: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the runs' values by text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.searchsorted(starts, bounds)])
