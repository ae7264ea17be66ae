"""Conversations, vectors, shards and packing: edge cases and brute force."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from checks.compare import compare, duck
from llm import chat, embed, packing, sharding, vafile
from llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), duck(SMALL), ORACLES[name]) == ""


# Conversations

TALK = "conv_id bigint, turn bigint, role string, text string, position int, own boolean"


def talk(spark, *rows):
    return spark.createDataFrame([(*r, 1, True) for r in rows], TALK)


def test_rotation_of_three_speakers(spark):
    df = talk(spark, (1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 2, "ann", None), (2, 0, None, "x"))
    rows = {(r["conv_id"], r["perspective"]): r for r in chat.render(df).collect()}
    assert set(rows) == {(1, "ann"), (1, "bob"), (2, "unknown")}
    ann = rows[1, "ann"]
    assert ann["text"] == "<|assistant|>\nhi<|end|>\n<|user|>\nbob: yo<|end|>\n<|assistant|>\n<|end|>\n"
    assert [ann["text"][m["start"] : m["end"]] for m in ann["mask"]] == ["hi<|end|>\n", "<|end|>\n"]
    assert rows[1, "bob"]["n_messages"] == 3


def test_parts_make_the_whole_and_ties_stay(spark):
    rows = [(7, t // 3, "abc"[t % 2], "m" * (t % 50)) for t in range(200)] + [(7, 5, "a", "same")] * 20 + [(None, None, "a", "q")] * 2
    whole = {(r["conv_id"], r["perspective"]): r for r in chat.render(talk(spark, *rows), 1 << 30).collect()}
    parts = chat.render(talk(spark, *rows), 300).orderBy("part").collect()
    assert len(parts) > 20 and max(len(p["text"]) for p in parts) < 300 + 100
    for key, row in whole.items():
        mine = [p for p in parts if (p["conv_id"], p["perspective"]) == key]
        assert "".join(p["text"] for p in mine) == row["text"]
        cut = [p["text"][m["start"] : m["end"]] for p in mine for m in p["mask"]]
        assert cut == [row["text"][m["start"] : m["end"]] for m in row["mask"]]
    assert chat.render(talk(spark, *rows).limit(0)).count() == 0


# Vectors


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.integers(-60, 60, (400, 8)).tolist()
    vectors[10] = vectors[11] = vectors[12]
    rows = [(i if i != 399 else 0, v, 9) for i, v in enumerate(vectors)] + [(1000, [1, 2], 9), (2000, [3, 4], 9)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>, row int")
    got = vafile.top_k(df, F.col("vec_id") % 20 == 0, 5, candidates=64, queries=8).collect()
    want = []
    for i, (q, v, _) in enumerate(rows):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), x, j) for j, (x, w, _) in enumerate(rows) if j != i and len(w) == len(v))
            want += [(q, r + 1, x, -s) for r, (s, x, _) in enumerate(scored[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_search_reads_few_exact_vectors():
    rng = np.random.default_rng(1)
    vectors = np.floor(64 * rng.normal(size=(4000, 64)) / 8).astype(np.int64)
    low = vectors.min(axis=0)
    width = (vectors.max(axis=0) - low) // vafile.CELLS + 1
    i, j, lower, upper = vafile.scan(vectors[:3], np.arange(3), (vectors - low) // width, np.arange(4000), low, width, 20)
    exact = vectors[:3] @ vectors.T
    assert ((lower <= exact[i, j]) & (exact[i, j] <= upper)).all() and len(i) < 3 * 400
    np.fill_diagonal(exact, -(10**9))
    for q in range(3):
        assert set(np.argsort(-exact[q], kind="stable")[:20]) <= set(j[i == q]) and q not in j[i == q]


def test_copies_of_a_vector_are_few_pairs(spark):
    rng = np.random.default_rng(3)
    vectors = [[5, 5, 5, 5]] * 300 + rng.integers(-9, 9, (100, 4)).tolist() + [[], []]
    rows = [(i, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    got = vafile.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()
    want = []
    for q, v in rows[::20]:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), x) for x, w in rows if x != q and len(w) == len(v))
        want += [(q, r + 1, x, -s) for r, (s, x) in enumerate(scored[:5])]
    assert sorted(map(tuple, got)) == sorted(want)
    stored = df.select("vec_id", "vector", F.size("vector").alias("dim"), (F.col("vec_id") % 20 == 0).alias("q"), F.col("vec_id").alias("row"))
    assert vafile.candidate_pairs(stored, 5).count() < 21 * 60


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], None, [nan, 0.0], [inf, 1.0], [None, 1.0], [0.99, 0.01], [0.0, 0.0], [0.0, 1.0], [1.0, 0.0], [], [1e200, 1e200]]
    rows = [(i, v, 1 if i != 8 else None, "k") for i, v in enumerate(vectors)] + [(0, [1.0, 0.0], 1, "k"), (None, [1.0, 0.0], 1, "k")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, links string")
    assert [r[0] for r in df.where(vafile.usable(F.col("embedding"))).select("vec_id").collect()] == [0, 5, 6, 7, 8, 9, 10, 0, None]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed.near_duplicates(df).collect()), key=str)
    linked = [(0, 3, 0, True), (0, 3, 0, True), (5, 3, 0, False), (None, 3, 0, False)]
    assert got == sorted(linked + [(i, 0, i, True) for i in (1, 2, 3, 4, 6, 7, 8, 9, 10)], key=str)
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_tiles_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    v = (centres[rng.integers(0, 12, 500)] + rng.normal(scale=0.22, size=(500, 16))).astype(np.float32)
    v[:40] = v[0]
    label = rng.integers(0, 2, 500)
    df = spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, label))], "vec_id bigint, embedding array<float>, label int")
    d = v.astype(float)
    cos = d @ d.T / np.outer(np.linalg.norm(d, axis=1), np.linalg.norm(d, axis=1))
    link = (cos >= 0.93) & (label[:, None] == label) & ~np.eye(500, dtype=bool)
    root = embed.roots(500, *np.nonzero(link))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed.near_duplicates(df, tile=64).collect()}
    assert got == {i: (int(link[i].sum()), int(root[i])) for i in range(500)}
    assert link.sum() > 1000


def test_bounds_hold():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(50, 32)) * 10.0 ** rng.integers(-9, 9, (50, 1))
    norms, small, scale, error = embed.quantise(v)
    near = small.astype(float) @ small.T * np.outer(scale, scale)
    cos = v @ v.T / np.outer(norms, norms)
    assert (np.abs(near - cos) <= error[:, None] + (1 + error[:, None]) * error).all()


# Shards


def jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_loop(spark):
    keys = [0, 1, 2, -1, -5, 2**63 - 1, -(2**63), 123456789012345, None, *range(1000, 1400)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    rows = df.select("k", sharding.jump_hash(F.col("k"), 16).alias("a"), sharding.jump_hash(F.col("k"), 17).alias("b"),
                     sharding.jump_hash(F.col("k"), 1).alias("one")).collect()
    for r in rows:
        assert (r["a"], r["b"], r["one"]) == (jump(r["k"] or 0, 16), jump(r["k"] or 0, 17), 0)
        assert r["b"] in (r["a"], 16)


def test_slots_have_no_gaps_with_repeated_keys(spark):
    rows = [(k, "s", 1) for k in [5] * 300 + [None] * 50 + list(range(200))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, slot int").select("doc_id", "text").repartition(7)
    got = sharding.shard(df, "doc_id", 16, ["doc_id", "text"]).collect()
    for s in range(16):
        mine = sorted(r["slot"] for r in got if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert len(got) == 550 and sharding.shard(df.limit(0), "doc_id", 16, ["doc_id"]).count() == 0


# Packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_are_whole_and_sequences_full(spark):
    texts = [None, "", "a b c", "word " * 9000, "<|endoftext|> x", "same", "same"] + [f"text {i} " * (i % 40) for i in range(300)]
    rows = [(i, t, "hot" if i % 3 else ("cold" if i % 2 else None), "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, window string").repartition(5, "doc_id")
    pieces = packing.pack(df, PATH, length=256, window=4).collect()
    library = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for i, t in enumerate(texts):
        mine = sorted(by_doc[i], key=lambda p: p["start"])
        ids = np.concatenate([np.frombuffer(p["ids"], np.uint16) for p in mine]).tolist()
        assert ids == [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert {p["doc_tokens"] for p in mine} == {len(ids)}
    last = max(by_sequence)
    assert sorted(by_sequence) == list(range(last + 1))
    for s, mine in by_sequence.items():
        mine.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in mine] == np.cumsum([0, *(p["length"] for p in mine[:-1])]).tolist()
        assert s == last or sum(p["length"] for p in mine) == 256
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_long_runs_of_blanks(spark):
    texts = [f"a{' ' * 1_200_000}b", "\n" * 1_200_000, "x<|endoftext|>" + "\t " * 600_000 + "<|endoftext|>y", "a " * 100_000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    library = Tokenizer.from_file(PATH)
    for r in packing.tokenised(df, PATH).collect():
        assert np.frombuffer(r["ids"], np.uint16).tolist() == [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1]


def test_mixture_holds_and_deficits_carry(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "abc"[i % 3], int(n)) for i, n in enumerate(rng.integers(1, 90, 3000))]
    df = spark.createDataFrame(rows, "row bigint, source string, n bigint")
    shares, width = {"a": 0.5, "b": 0.3, "c": 0.2}, 64 * 8
    placed = packing.layout(df, shares, length=64, window=8).join(df, "row").orderBy("begin").collect()
    ends = np.cumsum([r["n"] for r in placed])
    assert [r["begin"] for r in placed] == [0, *ends[:-1].tolist()]
    for source, share in shares.items():
        total, mine = 0, [r for r in placed if r["source"] == source]
        for w in range(40):
            # Sent by the end of each window: its quanta so far, and less than a document beyond them.
            total = sum(r["n"] for r in mine if r["window"] <= w)
            assert 0 <= total - share * width * (w + 1) < 90
    alone = packing.layout(df, {"a": 1.0}, length=64, window=8).join(df, "row").orderBy("begin").collect()
    assert [r["source"] for r in alone[:1000]] == ["a"] * 1000


def test_digests_are_of_32_bit_ids(spark):
    df = spark.createDataFrame([(1, "hello", "s")], "doc_id bigint, text string, source string")
    row = packing.digested(packing.pack(df, PATH), PATH).first()
    ids = [*Tokenizer.from_file(PATH).encode("hello").ids, 1]
    assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
