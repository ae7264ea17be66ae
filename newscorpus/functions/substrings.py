"""Which strings of a text may be listed words: hashes of its bytes looked up in a bitmap of the list.

All on NumPy arrays, a chunk of bytes at a time. The bitmap has no word wrongly left out; what it lets
through must still be compared with the words. Bytes of UTF-8 hold each other where their texts do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses
CHUNK = 1 << 20
PROBES = 3


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


BYTES = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2^64."""
    both = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    return both[0], both[1]


class Hashes:
    """Hashes of any strings of ``data`` in constant time each."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(len(data), 1).bit_length()
        powers, self.back = _powers(n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int, whole: bool) -> np.ndarray:
        """Of the strings at ``start``; whole words and the beginnings of words are told apart."""
        h = (self.sums[start + length] - self.sums[start]) * self.back[start]
        salt = np.asarray(2 * np.asarray(length) + whole, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return _mixed(h + salt)


def _places(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    mask = np.uint64(size - 1)
    for i in range(PROBES):
        yield (h + np.uint64(i) * ((h >> np.uint64(32)) | np.uint64(1))) & mask


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of binary values, none of them null."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def beginning(length: np.ndarray, gram: int) -> np.ndarray:
    """Length of the beginning by which a word is first looked up: gram doubled while it fits."""
    length = np.asarray(length)
    return np.where(length < gram, length, gram << np.floor(np.log2(np.maximum(length // gram, 1))).astype(np.int64))


def add_words(bits: np.ndarray, words: pa.Array, gram: int) -> None:
    """Enter words, none of them empty, in the bitmap ``bits``, whose size is a power of two."""
    data, offsets = buffers(words)
    if not len(words):
        return
    hashes = Hashes(data[offsets[0] : offsets[-1]])
    start, length = offsets[:-1] - offsets[0], np.diff(offsets)
    for h in (hashes.of(start, beginning(length, gram), False), hashes.of(start, length, True)):
        for place in _places(h, 8 * len(bits)):
            np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))


def _found(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indexes of the hashes that the bitmap has."""
    left = np.arange(len(h))
    for place in _places(h, 8 * len(bits)):
        at = place[left]
        left = left[(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return left


def candidates(texts: pa.Array, bits: np.ndarray, lengths: list[int], gram: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row numbers, strings) of all strings of texts that may be words, which are of these lengths."""
    data, offsets = buffers(texts)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    classes: dict[int, list[int]] = {}
    for n in lengths:
        classes.setdefault(int(beginning(n, gram)), []).append(n)
    for lo in range(first, last, CHUNK):
        hi = min(lo + CHUNK, last)
        part = data[lo : min(hi + max(lengths), last)]
        hashes = Hashes(part)
        every = np.arange(hi - lo)
        row = np.searchsorted(offsets, every + lo, "right") - 1
        room = offsets[row + 1] - lo - every
        for size, members in classes.items():
            starts = every[room >= size]
            starts = starts[_found(bits, hashes.of(starts, size, False))]
            for n in members:
                some = starts[room[starts] >= n]
                some = some[_found(bits, hashes.of(some, n, True))]
                if len(some):
                    yield row[some], _cut(part, some, n)


def _cut(data: np.ndarray, starts: np.ndarray, n: int) -> pa.Array:
    strings = np.ascontiguousarray(data[starts[:, None] + np.arange(n)])
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(starts), [None, pa.py_buffer(strings)]).cast(pa.binary())
