"""Words, shingles and windows of whole batches of texts as arrays of 64-bit hashes.

A word is a run of bytes other than the space and the bytes 9 to 13.  The hash of a
word of up to ``PLACES`` bytes adds up one random number for each byte and place, so
that a batch costs a few array operations whatever its texts are; longer words, which
are rare, are hashed one by one.  A window's hash adds up its words' hashes, each times
a random odd number of its place.  No numbers are powers of one another, so that words
and windows of a regular build collide no more often than others.  ``base`` chooses
between independent families of such hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text whose running sums are held at a time.
PIECE = 1 << 20
#: Bytes of a word that have random numbers of their own.
PLACES = 64


@cache
def _numbers(base: int) -> np.ndarray:
    """A random number for each place and byte."""
    return np.random.default_rng([7919, base]).integers(0, 1 << 64, PLACES * 256, np.uint64)


@cache
def _factors(size: int, base: int) -> np.ndarray:
    """A random odd number for each word of a window."""
    return np.random.default_rng([104729, base, size]).integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: bytes, where words begin and end in them, hashes, and word bounds of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    bound: np.ndarray

    def __len__(self) -> int:
        return len(self.bound) - 1

    def of(self, i: int) -> np.ndarray:
        return self.key[self.bound[i] : self.bound[i + 1]]

    def windows(self, size: int, base: int = 0) -> list[np.ndarray]:
        """For each text the hashes of all runs of ``size`` of its words."""
        every = windows(self.key, size, base)
        return [every[a : max(a, b - size + 1)] for a, b in zip(self.bound[:-1].tolist(), self.bound[1:].tolist())]

    def shingle_sets(self, size: int) -> list[np.ndarray]:
        """For each text its ``shingle_set``."""
        return [np.unique(h) if len(h) else shingle_set(self.of(i), size) for i, h in enumerate(self.windows(size))]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the bounds of its values; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    bound = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bound[0] : bound[-1]], bound - bound[0]


def _keys(part: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the words of a piece."""
    place = np.zeros(len(part), np.int64)
    place[lo] = lo
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(len(part)), place, out=place)
    np.minimum(place, PLACES - 1, out=place)
    place *= 256
    place += part
    sums = np.empty(len(part) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_numbers(base)[place], out=sums[1:])
    key = mix(sums[hi] - sums[lo])
    for i in np.flatnonzero(hi - lo > PLACES).tolist():
        key[i] = int.from_bytes(hashlib.blake2b(part[lo[i] : hi[i]].tobytes(), digest_size=8, salt=bytes([base])).digest(), "little")
    return key


def find(column: pa.Array, lower: bool = False, base: int = 0) -> Words:
    """The words of each text of a column; ``lower`` takes A to Z for a to z."""
    data, bound = buffers(column)
    begins = np.zeros(len(data) + 1, bool)
    begins[bound] = True
    starts, ends, keys = [], [], []
    at = 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        if to < len(data):  # cut where a word ends, or else behind the next word
            gap = np.flatnonzero(_SPACE[data[at:to]] | begins[at:to])
            if len(gap) and gap[-1] > 0:
                to = at + int(gap[-1])
            else:
                while to < len(data) and not (_SPACE[data[to]] or begins[to]):
                    ahead = np.flatnonzero(_SPACE[data[to : to + PIECE]] | begins[to : to + len(data[to : to + PIECE])])
                    to += int(ahead[0]) if len(ahead) else len(data[to : to + PIECE])
        part = data[at:to]
        space = _SPACE[part]
        first = ~space
        first[1:] &= space[:-1] | begins[at + 1 : to]
        edge = np.flatnonzero(first | space)
        after = np.append(edge[1:], len(part))
        real = first[edge]
        lo, hi = edge[real], after[real]
        starts.append(lo + at), ends.append(hi + at), keys.append(_keys(_LOWER[part] if lower else part, lo, hi, base))
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    return Words(data, start, end, key, np.searchsorted(start, bound))


def windows(key: np.ndarray, size: int, base: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` words within one row of words."""
    n = len(key) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = _factors(size, base)
    out = key[:n] * factor[0]
    for j in range(1, size):
        out += key[j : j + n] * factor[j]
    return mix(out)


def shingle_set(key: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``size`` make one shingle, none make none."""
    if not len(key):
        return np.zeros(0, np.uint64)
    return np.unique(windows(key, min(size, len(key))))


def grouped(batches: Iterator[pa.RecordBatch], column: int, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``size`` bytes of text each, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        _, bound = buffers(b.column(column))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(bound, bound[at] + size, "right")) - 1)
            yield b.slice(at, min(to, b.num_rows) - at)
            at = to
