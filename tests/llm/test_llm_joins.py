"""Near duplicates, repeated strings and the pipeline, against plain re-implementations."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm import pii, repeats, shingles, sigtree, suffix
from llm.common import components
from llm.queries import QUERIES
from newscorpus.operators import keyed

SMALL = "/root/testdata/sf0.001"
EXTRA = "key string, n int, tid string, component_id string, start int, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "t", "c", 2, 3) for r in rows], f"doc_id bigint, text string, {EXTRA}")


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def linked(ids, texts):
    """{doc_id: (n_shingles, component_id)} by comparing all sets that share a shingle."""
    sets, have, root = sets_of(texts), collections.defaultdict(list), list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in have[g]).items():
            if 100 * n >= 75 * len(s | sets[j]):
                root[find(i)] = find(j)
        for g in s:
            have[g].append(i)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, d in enumerate(ids)}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in sigtree.similar_documents(df).collect()}


@pytest.fixture(scope="module")
def edited():
    """Texts in groups of near copies with edits around the threshold, a common line in all."""
    rng, rows = random.Random(4), []
    words = [f"w{i}" for i in range(3000)]
    for group in range(40):
        base = rng.choices(words, k=rng.choice([3, 4, 5, 6, 12, 40, 120, 400]))
        for _ in range(rng.choice([1, 2, 3, 12])):
            text = list(base)
            for _ in range(int(len(text) * rng.choice([0, 0.01, 0.03, 0.05, 0.08]))):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text = text[: int(len(text) * rng.uniform(0.7, 1))]
            line = "The very common line of all of these texts \n" if len(text) > 60 else ""
            rows.append(line + rng.choice([" ", "\t", "\n"]).join(text).upper())
    return list(enumerate(rows + rows[:5]))


def test_components_of_edited_texts(spark, edited, monkeypatch):
    ids, texts = zip(*edited)
    want = linked(ids, texts)
    assert 1 < len({c for _, c in want.values()}) < len(want) - 10
    assert found(docs(spark, edited)) == want
    # The same with many tiles: every pair of tiles of a group is a task of its own.
    monkeypatch.setattr(sigtree, "TILE_SETS", 4)
    monkeypatch.setattr(sigtree, "BUCKET", 500)
    assert found(docs(spark, edited)) == want


def test_joins_by_shuffle_give_the_same(spark, edited, monkeypatch):
    monkeypatch.setattr(keyed, "MAX_BROADCAST_KEYS", 1)
    monkeypatch.setattr(repeats, "BROADCAST", 0)
    ids, texts = zip(*edited)
    assert found(docs(spark, edited)) == linked(ids, texts)
    assert judged(repeats.removals(docs(spark, edited))) == dict(zip(ids, removed(texts)))


def test_a_large_group_of_near_copies(spark):
    """Some hundreds of texts that share most tokens: frequent tokens, chains of links."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(300):
        text = list(base)
        for k in range(i // 30):
            text[k * 6] = f"x{k}"
        text[59] = f"y{rng.randrange(50)}"
        rows.append((i, " ".join(text)))
    assert found(docs(spark, rows)) == linked(*zip(*rows))


def test_set_edge_cases(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "one"), (2, "ONE"), (8, "a b c d"), (7, long), (6, long + " end"),
            (6, long + " end"), (1, "é É"), (None, "a b c d"), (None, "alone here")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in sigtree.similar_documents(docs(spark, rows)).collect()), key=str)
    want = [(5, 0, 5), (4, 0, 4), (3, 0, 3), (9, 1, 2), (2, 1, 2), (8, 1, 8), (7, 29_996, 6), (6, 29_997, 6), (6, 29_997, 6),
            (1, 1, 1), (None, 1, 8), (None, 1, None)]
    assert got == sorted(want, key=str)
    kept = sigtree.first_of_each(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]) for r in kept)) == sorted(["5", "4", "3", "2", "8", "6", "1", "None"])
    assert kept[0]["key"] == "k" and sigtree.similar_documents(docs(spark, [])).count() == 0


def test_join_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op7_signature_tree_join"](spark, SMALL).collect()}
    assert got == linked(*zip(*rows))


def test_pruning_never_loses_a_pair():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 120)).astype(np.uint64)) for _ in range(60)]
    x, y = sigtree.Tree(sets[:30], 64), sigtree.Tree(sets[30:], 64)
    for level in range(len(x.levels)):
        i, j = np.arange(len(x.levels[level][0])), np.arange(len(y.levels[level][0]))
        may = sigtree.possible(x, y, level, level, i, j)
        for a in range(30):
            for b in range(30):
                if sigtree.linked(sigtree.overlap(x.sets[a], y.sets[b]), len(x.sets[a]), len(y.sets[b])):
                    assert may[a // 8**level, b // 8**level]


def test_prefixes_meet():
    """Any two linked sizes share what ``least_common`` says, for the least overlap they may have."""
    for a in range(1, 200):
        for b in range(a, 200):
            o = next((o for o in range(1, a + 1) if sigtree.linked(o, a, b)), None)
            if o is not None:
                for n, m in ((a, b), (b, a)):
                    missed = max(0, (n - o) - (n - sigtree.prefix(n)))  # at worst the prefix has all others
                    assert min(sigtree.prefix(n), n) - (n - o) >= min(sigtree.least_common(n), sigtree.least_common(m)), (a, b, missed)


def test_shingles_of_chunks_equal_those_of_texts():
    texts = ["a b c d e f".encode(), b"", "X y Z".encode(), b"p  q\tr\ns t u"]
    one = [next(shingles.shingle_sets([t])).tolist() for t in texts]
    assert [s.tolist() for s in shingles.shingle_sets(texts)] == one and [len(s) for s in one] == [2, 0, 1, 2]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (500, 499), (499, 500)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = dict(tuple(r) for r in components(df).collect())
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 160)}, 499: 499, 500: 499}
    assert components(df.limit(0)).count() == 0


# Repeats


def removed(texts, length=400):
    raw, seen = [(t or "").encode() for t in texts], collections.Counter()
    for x in raw:
        seen.update(hash(x[i : i + length]) for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[hash(x[i : i + length])] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def judged(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats_against_brute_force(spark, hot):
    rng = random.Random(6)
    passages = ["".join(rng.choices("abcdé ", k=n)) for n in (390, 399, 400, 401, 450, 900)]
    texts = [None, "", "x" * 399, "y" * 400, "z" * 401, "ab" * 900, passages[5], passages[5]]
    for i in range(60):
        filler = ["".join(rng.choices("efgh ", k=rng.randrange(0, 300))) for _ in range(3)]
        texts.append(filler[0] + rng.choice(passages) + filler[1] + rng.choice(passages)[rng.randrange(0, 60) :] + filler[2])
    rows = list(enumerate(texts))
    assert judged(repeats.removals(docs(spark, rows).repartition(5, "doc_id"), hot)) == dict(enumerate(removed(texts)))


@pytest.mark.parametrize("length", [200, 250])
def test_repeats_of_other_lengths(spark, length):
    rng = random.Random(length)
    passages = ["".join(rng.choices("abcdé ", k=n)) for n in (length - 1, length, length + 40, 399, 700)]
    texts = [None, "", "x" * (length - 1), "y" * length, "z" * (length + 1)]
    for _ in range(40):
        filler = ["".join(rng.choices("efgh ", k=rng.randrange(0, 200))) for _ in range(3)]
        texts.append(filler[0] + rng.choice(passages) + filler[1] + rng.choice(passages)[rng.randrange(0, 60) :] + filler[2])
    for hot in (repeats.HOT, 2):
        assert judged(repeats.removals(docs(spark, list(enumerate(texts))), hot, length)) == dict(enumerate(removed(texts, length)))


def test_passages_by_words(spark):
    rng = random.Random(9)
    words = lambda n, least=4: " ".join("".join(rng.choices("abcdefgh", k=least + i % 3)) for i in range(n))
    long, short, wide, other = words(50), words(44), "".join(rng.choices("漢字仮名", k=140)), words(52, 2)
    texts = [f"{words(20)} {p} {words(20)}" for p in (long, short, wide, other) for _ in (0, 1)]
    rows = list(enumerate(texts))
    clash = spark.createDataFrame([(*r, "mine", 7) for r in rows], "doc_id bigint, text string, _start string, __end int")
    cut = repeats.without_repeats(clash, 200, 50).orderBy("doc_id").collect()
    assert {(r["_start"], r["__end"]) for r in cut} == {("mine", 7)}
    for (i, text), row in zip(rows, cut):
        passage = [long, short, wide, other][i // 2]
        gone = len(text) - len(row["text"])
        # 50 words and 400 bytes go whole, 44 words and short words (less than 200 bytes) stay.
        assert (gone >= len(passage) and passage not in row["text"]) if i // 2 in (0, 2) else gone == 0 or i // 2 == 3
    assert len(other.encode()) < 260


def test_pipeline_leaves_columns_of_its_own_names(spark):
    rows = [(i, f"the quick brown fox {i} jumps over it", "en", 7.5, "mine", 0.25, "k", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double, lang_pred string, certainty double, _key string, _start int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SMALL)
        assert out.columns == df.columns
        assert {tuple(r)[2:] for r in out.collect()} <= {r[2:] for r in rows}


def test_repeats_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op8_difference_cover_dedup"](spark, SMALL).collect()}
    assert got == dict(zip((r["doc_id"] for r in rows), removed([r["text"] for r in rows])))


def test_repeats_of_equal_rows_and_no_rows(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=900))
    same = repeats.removals(docs(spark, [(1, text), (1, text), (None, text), (None, text)])).collect()
    assert [(r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in same] == [(900, 1, b"")] * 4
    cut = repeats.without_repeats(docs(spark, [(1, "é" + text), (2, text + "é"), (3, None)])).orderBy("doc_id").collect()
    assert [(r["text"], r["n_chars"], r["key"]) for r in cut] == [("é", 1, "k"), ("é", 1, "k"), (None, 3, "k")]
    assert repeats.removals(docs(spark, [])).count() == 0


def test_a_passage_between_distinct_surroundings_meets_in_no_task(spark, monkeypatch):
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh", k=450))
    around = lambda: "".join(rng.choices("ijklmnop", k=200))
    texts = [around() + passage + around() for _ in range(1500)]
    rows = [*enumerate(texts), (0, texts[0])]
    largest = []

    def watched(df, *rest):
        size = sum(F.octet_length(c) for c, kind in df.dtypes if kind == "binary")
        largest.append(df.groupBy("bucket").agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0] or 0)
        return by_bucket(df, *rest)

    by_bucket = repeats.by_bucket
    monkeypatch.setattr(repeats, "by_bucket", watched)
    monkeypatch.setattr(repeats, "BUCKET", 5_000)
    monkeypatch.setattr(repeats, "BLOCK", 100_000)
    got = judged(repeats.removals(docs(spark, rows), hot=50))
    want = removed([t for _, t in rows])
    assert got == dict(enumerate(want[:-1])) and got[0] == want[-1] and max(largest) < 500_000


@pytest.mark.parametrize("length", [16, 29, 64, 100, 400])
def test_ranks_name_windows_exactly(length):
    rng = np.random.default_rng(length)
    for letters in (1, 2, 4):
        data = rng.integers(97, 97 + letters, 1500).astype(np.uint8)
        data[700:1300] = data[:600]
        starts = np.sort(rng.choice(1500 - length + 1, 700, replace=False))
        counts = collections.Counter(data[s : s + length].tobytes() for s in starts)
        want = [counts[data[s : s + length].tobytes()] > 1 for s in starts]
        assert suffix.repeated(data, starts, length).tolist() == want


def test_equal_windows_choose_equal_anchors():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 3000).astype(np.uint8)
    data[2000:2700] = data[100:800]
    anchor, _, at, lo, hi = repeats.anchors(data)
    chosen = {s: (int(a), int(p - s)) for a, p, x, y in zip(anchor, at, lo, hi) for s in range(x, y + 1)}
    assert sorted(chosen) == list(range(2601))
    assert all(chosen[100 + k] == chosen[2000 + k] for k in range(301))


# Pipeline


def test_pipeline_stage_by_stage(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "12 34 !!", None, "s", 8)]
    given = given.unionAll(spark.createDataFrame(odd, given.schema))
    tables = {}
    now = given
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SMALL)
        tables[name] = now = spark.createDataFrame(now.collect(), now.schema)
        assert name == "packing" or now.columns == given.columns
    start = {r["doc_id"]: r["text"] for r in given.collect()}
    lang = {r["doc_id"]: r["text"] for r in tables["language"].collect()}
    assert lang == {i: t for i, t in start.items() if i >= 0}  # clean documents stay
    near = {r["doc_id"]: r["text"] for r in tables["near_duplicates"].collect()}
    parts = linked(list(lang), list(lang.values()))
    assert near == {i: lang[i] for i, (_, root) in parts.items() if i == root}
    cut = {r["doc_id"]: r["text"] for r in tables["repeats"].collect()}
    want = dict(zip(near, removed(list(near.values()))))
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in cut.items()} == {i: w[3] for i, w in want.items()}
    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in tables["personal_data"].collect()}
    found_any = 0
    for i, text in cut.items():
        spans = pii.find_spans(text, pii._automaton())
        found_any += bool(spans)
        assert (masked[i][0] == text) == (not spans) and masked[i][1] == len(masked[i][0])
    assert found_any and set(masked) == set(near)
    pieces = tables["packing"]
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == set(near)
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).orderBy("sequence_id").collect()
    assert all(r["n"] == 2048 for r in sizes[:-1]) and [r["sequence_id"] for r in sizes] == list(range(len(sizes)))


def test_language_stage_keeps_clean_documents(spark):
    rng = random.Random(2)
    parts = {"aa": ["tion", "ing", "the"], "bb": ["keit", "sch", "und"], "cc": ["oqua", "lliz", "vexo"]}
    write = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(n))
    rows = [(3 * i + k, write(lang, 60), lang) for i in range(60) for k, lang in enumerate(parts)]
    rows += [(1000 + i, " ".join(write(lang, 40) for lang in parts), None) for i in range(5)] + [(2000, "12 !", None), (2001, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    want = sorted(r[0] for r in rows if r[0] < 2000)
    for given in (df, df.withColumn("lang", F.lit(None).cast("string"))):
        kept = corpus_pipeline.keep_languages(spark, given, SMALL)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == want


def test_pipeline_runs_as_a_query(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_op8_tells_passages_shorter_than_its_strings(spark):
    passage = " ".join(f"word{i}" for i in range(55))  # 50 words and more, under 400 bytes
    rows = [(1, "alpha " + passage + " beta"), (2, "gamma " + passage + " delta"), (3, "nothing of it"), (4, None)]
    got = repeats.removals(docs(spark, rows), passages=(200, 50)).collect()
    assert 200 < len(passage) < 400
    assert {r["doc_id"]: (r["n_removed"], r["n_passages"], r["n_passage_bytes"] >= len(passage)) for r in got} == {
        1: (0, 1, True), 2: (0, 1, True), 3: (0, 0, False), 4: (0, 0, False)}
