"""Ranked search by shared partial sums, against sums over every document and item."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import lexical
from llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, item_id int, terms string, n string, row int, rank int, score int"
ITEMS = "item_id bigint, text string, doc_id int, words string, block int, row int"


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def ranked(docs, items, k=50):
    """Rows of (item_id, rank, doc_id, score), by the rule as stated."""
    bags = [(d, collections.Counter(words(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, all_terms = len(bags), sum(n for *_, n in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b, n in bags:
            m = 100 - 50 + (50 * n * n_docs) // all_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m))
                for t in set(words(text)) & set(b)
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, 1, "t", "n", 2, 3, 4) for r in docs], DOCS)
    i = spark.createDataFrame([(*r, 1, "w", 2, 3) for r in items], ITEMS)
    return sorted((tuple(r) for r in lexical.search(d, i, **how).collect()), key=repr)


def corpus(n=300, seed=1):
    draw = random.Random(seed)
    letters = ["the", "and", "Écu", "écu", "naïve", "7up", "日本語", "x" * 70, *(f"w{i}" for i in range(80))]
    line = lambda: draw.choice([" ", "-", "\n", "\x00", "_"]).join(draw.choices(letters, [40, 30, *[3] * 86], k=draw.randint(0, 60)))
    return [(i, line()) for i in range(n)], [(i, line()) for i in range(25)]


def test_ranks_are_those_of_all_sums(spark):
    docs, items = corpus()
    docs += [(0, docs[0][1]), (4000, docs[7][1]), (None, docs[7][1]), (5000, None), (5001, ""), (5002, " .!? "), (5003, "the " * 90_000 + "écu")]
    items += [(3, items[3][1]), (3, "the THE tHe"), (None, "écu"), (90, None), (91, "-"), (92, "nowhere else")]
    for k in (3, 50):
        assert found(spark, docs, items, k=k) == ranked(docs, items, k)
    # Blocks of a few items each.
    assert found(spark, docs, items, block_terms=700) == ranked(docs, items)


def test_ties_go_to_smaller_ids(spark):
    docs = [(i, "same words here") for i in range(200, 0, -1)] + [(900, "other")] * 2
    assert [r[2] for r in sorted(found(spark, docs, [(1, "words")], k=7), key=lambda r: r[1])] == list(range(1, 8))


def test_small_chunks_and_accumulators(spark, monkeypatch):
    docs, items = corpus(60, 2)
    monkeypatch.setattr(lexical, "ACCUMULATORS", 1)
    data = [t.encode() for _, t in docs]
    for size in (1, 5, 1 << 20):
        got = collections.Counter()
        for part, owner in lexical.chunks(data, size):
            for a, b in zip(*lexical.terms(part)):
                got[int(owner[np.searchsorted(owner[:, 0], a, "right") - 1, 1]), part[a:b].tobytes().decode()] += 1
        assert got == collections.Counter((i, w) for i, (_, t) in enumerate(docs) for w in words(t))
    assert found(spark, docs, items) == ranked(docs, items)


def test_nothing_to_search(spark):
    docs, items = corpus(5)
    for d, i in (([], items), (docs, []), ([(1, None)], items), (docs, [(1, "?")])):
        assert found(spark, d, i) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14)), max_size=12), st.integers(0, 12))
def test_sharing_adds_up(sets, mined):
    graph = lexical.share([np.array(sorted(s), np.int64) for s in sets], 15, mined)
    # Each node as a set of terms: an item's nodes are disjoint and make the item.
    made = [{t for t in range(15) if graph.leaf[t] == n} for n in range(graph.leaves)]
    for a, b in graph.pairs:
        assert not made[a] & made[b]
        made.append(made[a] | made[b])
    for s, nodes in zip(sets, graph.nodes):
        parts = [made[n] for n in nodes]
        assert sum(map(len, parts)) == len(s) and set().union(*parts) == s


def test_sharing_saves_additions():
    terms = [np.array(sorted({*range(20), 20 + i, 30 + i % 3})) for i in range(10)]
    graph = lexical.share(terms, 40)
    assert graph.additions() < 30 < sum(len(t) - 1 for t in terms)


def test_vocabulary_compares_letters():
    known = lexical.Vocabulary([b"ab", b"abc", b"b"])
    data = np.frombuffer(b"abc b ab a", np.uint8)
    known.hashes[:] = known.hashes[0]  # all hashes alike
    which, number = known.find(data, *lexical.terms(data))
    assert set(zip(which.tolist(), number.tolist())) <= {(0, 1), (1, 2), (2, 0)}


def test_query_equals_rule_on_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_shared_lexical_search"](spark, sf).collect()), key=repr)
    assert got == ranked(rows("documents", "doc_id"), rows("benchmark", "item_id")) and "op11_shared_lexical_search" in ORACLES
