"""The burst trie against nodes made one by one, with containers and windows of a few turns."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from llm import common, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, box string, id string, rep int"

def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", "i", 2) for r in rows], SCHEMA)


def rem(c):
    """Remainder with the sign of the number, as in SQL."""
    return abs(c) % 100 * (-1 if c < 0 else 1)


def sequences(rows, shared=lambda c: zlib.crc32(str(c).encode()) % 6):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(x)] for c, x in turns.items()}
    return {c: own.get(c - rem(c), [])[: shared(c)] + own[c][shared(c) :] for c in own}


def nodes_of(seqs):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = collections.defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out, leaves, saved = [], {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
        parent = min(members[path[:-1]]) if path else None
        out.append((len(path), min(members[path]), parent, len(members[path]), len(kids[path]), leaves[path], saved[path], digest))
    return sorted(out, key=repr)


def found(spark, rows, shared=None, **sizes):
    c = F.col("conv_id")
    shared = F.crc32(c.cast("string")) % 6 if shared is None else F.lit(shared)
    df = trie.conversation_nodes(frame(spark, rows), c - c % 100, shared, **sizes)
    names = [c for c in trie._NODE if not c.startswith("end_")]
    return sorted((tuple(r[n] for n in [*names, "ends_sha256"]) for r in df.collect()), key=repr)


def talk(seed=3):
    draw = random.Random(seed)
    rows = []
    for c in [*range(0, 12), 55, 100, 101, 150, 302, 303, -1, -100, -130, 250, 251]:
        for turn in range(draw.randint(1, 9)):
            rows.append((c, turn, draw.choice(["user", "assistant"]), draw.choice(["a", "b", "é😀", ""])))
    return rows


ODD = [
    (700, None, None, None), (700, 1, "user", None), (700, 1, "user", "x"), (700, 1, "user", "x"), (700, None, "", ""),
    (None, 1, "user", "nobody's"), (701, 5, None, "only"), (703, 2, "u", "z" * 100_000),
]


def test_small_tables(spark):
    rows = talk() + ODD
    assert found(spark, rows) == nodes_of(sequences(rows))


@pytest.mark.parametrize("window, box_rows, box_turns", [(2, 2, 100), (3, 100, 8)])
def test_bursts_and_windows(spark, window, box_rows, box_turns):
    rows = [(c, t, "u", str(x)) for c, seq in prefixes().items() for t, x in enumerate(seq)]
    want = nodes_of(sequences(rows, lambda c: 0))
    assert found(spark, rows, shared=0, window=window, box_rows=box_rows, box_turns=box_turns) == want


def prefixes():
    """Copies, prefixes of one another and forks, before, at and after the ends of windows of 2 and 3 turns."""
    line = [*range(7)]
    seqs = [line[:n] for n in range(1, 8)] + [line[:n] + [50 + n] for n in (0, 1, 3, 4)]
    seqs += [line, line[:4], line[:3] + [90, 91, 92], line[:3] + [90, 91, 92], [7] * 4, [7] * 3 + [8]]
    order = list(range(len(seqs)))
    random.Random(5).shuffle(order)
    return {c: seqs[i] for c, i in enumerate(order)}


def test_hot_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 5)
    monkeypatch.setattr(trie, "FEW", 0)
    rows = [(5, t, "u", str(t % 3)) for t in range(30)] + [(c, t, "u", str(t)) for c in range(100, 120) for t in range(3)]
    rows += [(c, t, "u", str(t)) for c in range(200, 210) for t in range(c % 4 + 1)]
    want = nodes_of(sequences(rows, lambda c: 0))
    assert found(spark, rows, shared=0, window=8, box_rows=2, box_turns=1000) == want
    members = spark.createDataFrame([(r, c) for r in (3, 4) for c in range(r, 60)], "rep bigint, conv_id bigint")
    want = {r: hashlib.sha256(",".join(map(str, range(r, 60))).encode()).hexdigest() for r in (3, 4)}
    assert {r: d for r, d in trie.member_digests(members, 7).collect()} == want


def test_no_conversations(spark):
    assert found(spark, []) == [] == found(spark, [(None, 1, "u", "x")])
