"""Repeated windows of a byte array by difference-cover sample ranks, one block of suffixes at a time.

The cover's residues modulo 7 are such that any two positions reach sample positions by one common
small shift. Sample positions are ranked once, for ever longer prefixes, by doubling. Suffixes fall
into blocks by some of their words; within a block, long ties are resolved by two rank comparisons
and the few bytes around them, never by reading whole windows. Ranks name contents exactly.
"""

from __future__ import annotations

import numpy as np

PERIOD = 7
#: A perfect difference set: every difference modulo 7 occurs.
COVER = (0, 1, 3)
SHIFT = np.array(
    [[next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER) for j in range(PERIOD)] for i in range(PERIOD)]
)


def words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number; zeros follow the end."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | wide[k : k + len(data)]
    return out


def _rank(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.uint64)


def sample_ranks(word: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(slot, rank, depth): the ranks of the cover's positions by their first ``depth`` bytes, more
    than half of ``most`` and ``most`` at most; ``slot`` finds a position's rank."""
    at = np.flatnonzero(np.isin(np.arange(len(word)) % PERIOD, COVER))
    slot = np.zeros(len(word) + 1, np.int64)
    slot[at] = np.arange(len(at))
    rank, depth = _rank(word[at] >> np.uint64(8)), PERIOD
    while 2 * depth <= most:
        # A position beyond the end has rank 0; such prefixes are never asked for.
        later = at + depth
        inside = later < len(word)
        follow = np.zeros(len(at), np.uint64)
        follow[inside] = rank[slot[later[inside]]] + np.uint64(1)
        rank, depth = _rank(rank << np.uint64(32) | follow), 2 * depth
    return slot, rank, depth


def repeated(data: np.ndarray, starts: np.ndarray, length: int = 400) -> np.ndarray:
    """Whether the ``length`` bytes from each start are also those from another of ``starts``.

    Windows have to lie within the data. ``length`` is 16 at least.
    """
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    word = words(data)
    block = np.zeros(len(starts), np.uint64)
    for k in range(0, length - 7, 56):
        block = (block ^ word[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        block ^= block >> np.uint64(29)
    block = (block ^ word[starts + length - 8]) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(block, kind="stable")
    change = np.diff(block[order]) != 0
    alone = np.concatenate([[True], change]) & np.concatenate([change, [True]])
    order = order[~alone]
    if not len(order):
        return out
    # The shift leaves out 6 bytes at most in front. Two ranks, the second begun a whole number of
    # periods later, cover the rest but for 12 bytes at most behind.
    inner = length - PERIOD + 1
    slot, rank, depth = sample_ranks(word, inner)
    second = (inner - depth) // PERIOD * PERIOD
    while len(order):
        group = np.concatenate([[0], np.cumsum(np.diff(block[order]) != 0)])
        first = np.searchsorted(group, np.arange(group[-1] + 1))
        pivot = starts[order[first]][group]
        mine = starts[order]
        shift = SHIFT[mine % PERIOD, pivot % PERIOD]
        p, q = mine + shift, pivot + shift
        same = rank[slot[p]] == rank[slot[q]]
        same &= rank[slot[p + second]] == rank[slot[q + second]]
        same &= word[mine] == word[pivot]
        for back in (8, 16):
            same &= word[mine + length - back] == word[pivot + length - back]
        twins = np.bincount(group, same)
        out[order[same & (twins[group] > 1)]] = True
        rest = ~same
        left = np.bincount(group, rest)
        order = order[rest & (left[group] > 1)]
    return out
