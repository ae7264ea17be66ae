"""Word shingles of whole texts as sorted arrays of 64-bit numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from llm.common import Spans, mix

WIDTH = 5
#: Bytes of text hashed at a time; one longer text is one chunk.
CHUNK = 1 << 19
_FOLD = np.uint64(0x9DDFEA08EB382D69)


def _fold(hashes: np.ndarray, n: int, width: int) -> np.ndarray:
    """Hash of ``width`` words from each of the first ``n`` on."""
    out = hashes[:n] + np.uint64(width)
    for k in range(1, width):
        out = mix(out * _FOLD + hashes[k : k + n])
    return mix(out)


def _chunk(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join(texts), np.uint8)
    data = data + (np.uint8(32) * ((data >= 65) & (data <= 90)))
    edge = np.diff(((data != 32) & ((data < 9) | (data > 13))).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = Spans(data).of(starts, ends)
    size = np.array([len(t) + 1 for t in texts])
    first = np.searchsorted(starts, np.append(0, np.cumsum(size)))
    every = _fold(words, max(0, len(words) - width + 1), width)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            yield np.unique(every[a : b - width + 1])
        else:
            yield _fold(words[a:b], 1, b - a) if b > a else words[:0]


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The set of hashed shingles of each text: A to Z lowered, words split at ASCII white space;
    a text of fewer words is one shingle, one without words has none."""
    part: list[bytes] = []
    held = 0
    for text in texts:
        if part and held + len(text) > CHUNK:
            yield from _chunk(part, width)
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield from _chunk(part, width)
