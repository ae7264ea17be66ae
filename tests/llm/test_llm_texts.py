"""Personal data, language, BPE and shingles: edge cases and plain re-implementations."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import bpe, language, pii
from llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
#: Names that operators use themselves.
EXTRA = "key string, n int, ids string, start int, kind string, score double"
CLASH = ("k", 1, "i", 2, "x", 0.5)


def docs(spark, *texts):
    rows = [(i, t, *CLASH) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {EXTRA}")


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@@..-+0123456789 ()é", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    found = [s for s in pii.find_spans(text, pii._automaton()) if s[2] in BASE]
    assert found == plain_spans(text)


def test_personal_data_edge_cases(spark):
    long = "word " * 50_000 + "a@b.co " * 3 + "4111 1111 1111 1111"
    found = pii.pii_spans(docs(spark, None, "", "x.y@mail.example.com", long, "no data here", "x.y@mail.example.com"))
    rows = found.orderBy("doc_id").collect()
    assert [[(s["kind"], s["start"], s["end"]) for s in r["pii"]] for r in rows] == [
        [], [], [("email", 0, 20)], [(k, a, b) for a, b, k in plain_spans(long)], [], [("email", 0, 20)]]
    assert rows[2]["kind"] == "x" and pii.pii_spans(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("IBAN DE89 3704 0044 0532 0130 00.", ["account"]),
        ("IBAN DE00 3704 0044 0532 0130 00.", []),
        ("Account number: 12-345-678", ["account"]),
        ("on account of rain", []),
        ("see https://example.org/a?b=c, now", ["url"]),
        ("lives at 12 Long Meadow Street now", ["address"]),
        ("The street was empty", []),
    ],
)
def test_cues_and_schemes(text, kinds):
    assert [k for *_, k in pii.find_spans(text, pii._automaton())] == kinds


def test_redaction_keeps_rows_and_other_columns(spark):
    df = docs(spark, None, "", "mail a@b.co or http://a@b.co/x now", "clean").withColumn("n_chars", F.char_length("text").cast("bigint"))
    rows = pii.redact(df).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == [None, "", "mail [EMAIL] or [URL] now", "clean"]
    assert [r["n_chars"] for r in rows] == [None, 0, 25, 5] and rows[0]["key"] == "k"


@pytest.mark.parametrize(
    "part", ["http://", "http://.", "a@", "a@b.", "@", "+1", "+1 ", "1", "1.", "4 ", "iban ", "iban 1", "account: 12 ", " street", "12 Oak street ", "Oak ", "mailto:a@b.c"]
)
def test_time_follows_length(part):
    found = pii._automaton()
    start = time.perf_counter()
    pii.find_spans(part * (2_000_000 // len(part)), found)
    assert time.perf_counter() - start < 30


def test_pii_query_equals_patterns(spark):
    rows = QUERIES["op1_pii_anchor_expansion"](spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["n_email"] == sum(k == "email" for *_, k in spans)


# Language


def test_held_out_accuracy(spark):
    found = QUERIES["op3_crf_language"](spark, SMALL).join(
        spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id"
    )
    row = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] >= 0.97 and 0 <= row[1] and row[2] <= 1


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    stems = {"aa": ["tion", "ing", "the", "er"], "bb": ["keit", "sch", "und", "ein"]}
    texts, langs = [], []
    for lang, parts in stems.items():
        for _ in range(60):
            texts.append(" ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(80)))
            langs.append(lang)
    return language.train(texts, langs)


def test_code_switched_words(model):
    words = ["thetion", "ingthe", "er"] * 5 + ["schkeit", "undein", "ein"] * 5
    marginal, owner = language.word_marginals([words], model, {}, [])
    assert (marginal.argmax(axis=1) == np.repeat([0, 1], 15)).mean() > 0.95
    assert np.allclose(marginal.sum(axis=1), 1, atol=1e-4)


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(0)
    scores, move, start = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = language.forward_backward(scores, np.ones((1, 4), bool), move, start)[0][0]
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        weight = np.exp(start[path[0]] + sum(scores[0, t, k] for t, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        for t, k in enumerate(path):
            want[t, k] += weight
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True))


def test_language_edge_cases(spark, model):
    df = docs(spark, None, "", "123 !!", "thetion " * 30_000, "schkeit", "schkeit")
    rows = language.predict(df, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows] == ["und", "und", "und", "aa", "bb", "bb"]
    assert all(0 <= r["score"] <= 1 for r in rows) and rows[0]["key"] == "k" and rows[4]["score"] == rows[5]["score"]
    nothing = language.fit(spark.createDataFrame([("x", None), (None, "en")], "text string, lang string"))
    assert {r["lang_pred"] for r in language.predict(df, nothing).collect()} == {"und"}
    assert language.predict(df.limit(0), model).count() == 0


def test_more_languages_than_bits():
    rng = random.Random(4)
    letters = [chr(0x0E01 + i) + chr(0x10D0 + i % 30) for i in range(70)]
    texts = [" ".join("".join(rng.choices(letters[k] + "aeiou", k=4)) for _ in range(30)) + " common words" for k in range(70) for _ in range(3)]
    langs = [f"l{k:02}" for k in range(70) for _ in range(3)]
    model = language.train(texts, langs, epochs=2)
    assert len(model.labels) == 70 and max(model.lexicon.values()) >= 1 << 64
    marginal, owner = language.word_marginals([language.WORD.findall(t) for t in texts], model, {}, [])
    right = [model.labels[np.bincount(marginal[owner == i].argmax(axis=1)).argmax()] == lang for i, lang in enumerate(langs)]
    assert np.mean(right) > 0.9


def test_every_letter_of_a_long_run_is_read(spark, model):
    run = "thetion" * 4 + "schkeit" * 400 + "thetion" * 4
    rows = language.predict(docs(spark, run, "thetioning" * 50 + "schkeitund" * 50), model).orderBy("doc_id").collect()
    assert rows[0]["lang_pred"] == "bb" and rows[0]["score"] > 0.9 and 0.4 < rows[1]["score"] < 0.6


def test_sample_has_all_languages_and_distinct_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_DOCS", 60)
    common = spark.range(8000).select(F.concat(F.lit("word "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 8).alias("lang"))
    rare = spark.range(20).select(F.concat(F.lit("rare "), "id").alias("text"), F.lit("rare").alias("lang"))
    copies = spark.range(5000).select(F.concat(F.lit("same "), F.col("id") % 3).alias("text"), F.lit("copied").alias("lang"))
    texts, langs = language.sample(common.unionAll(rare).unionAll(copies))
    assert len(texts) == len(set(texts)) and {lang: langs.count(lang) for lang in langs} == {
        **{f"l{k}": 6 for k in range(8)}, "rare": 6, "copied": 3}


# BPE

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["ΑΣ ΟΔΟΣ Σ", "a\x1cb\x1fc", "İstanbul I'LL don'T", "x<|startoftext|>Yé<|endoftext|>", "a\x85b​ c", "日本語 ١٢٣ ½ ²",
       "é́ ᾼ ǅ", "🙂👍🏽 a_b", "ab" * 40_000, "", "\x00", "<|endoftext|> <|endoftex", "ﬁ Ⅷ", "thing,thing. (thing)"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text(alphabet="aSΣσİß'.,1²Ж \t\u0301é…", max_size=40), max_size=4))
def test_bpe_equals_the_library(texts):
    ours, theirs = bpe.load(PATH), LIBRARY
    ids = [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    packed = ours.encode_batch(texts)
    assert packed.to_pylist() == ids == [ours.encode(t) for t in texts]
    assert ours.decode_batch(packed).to_pylist() == [theirs.decode(i, skip_special_tokens=False) for i in ids]


def test_bpe_odd_texts_and_edge_cases(spark):
    theirs = LIBRARY
    rows = bpe.encode_decode(docs(spark, None, *ODD, ODD[0]), PATH).orderBy("doc_id").collect()
    want = [theirs.encode(t or "", add_special_tokens=False).ids for t in [None, *ODD, ODD[0]]]
    assert [r["ids"] for r in rows] == want and rows[0]["key"] == "k"
    assert [r["decoded"] for r in rows] == [theirs.decode(i, skip_special_tokens=False) for i in want]
    assert bpe.encode_decode(docs(spark).limit(0), PATH).count() == 0


def test_one_tree_and_many_agree():
    ours = bpe.WordBpe(PATH)
    for word in ("a", "ab", "internationalization", "a" * 31, "a" * 33, "zzzzzzzzqqqq"):
        raw = word.encode()
        tree = bpe.merge([*(ours.plain[b] for b in raw[:-1]), ours.last[raw[-1]]], ours.pairs)
        assert tree == ours.encode(word)
