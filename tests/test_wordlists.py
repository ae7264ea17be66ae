"""Long word lists against a loop over the words."""

from __future__ import annotations

import itertools
import random

from newscorpus.operators import cleaning, keyed, wordlists

PAGE = "page int, blocks array<struct<pos:bigint,tag:string,text:string>>, text string, id int, word string"


def frame(spark, pages):
    rows = [(i, None if b is None else [(p, "p", t) for p, t in enumerate(b)], "t", 1, "w") for i, b in enumerate(pages)]
    return spark.createDataFrame(rows, PAGE)


def kept(df):
    return {r["page"]: r["blocks"] and [b["text"] for b in r["blocks"]] for r in df.collect()}


def test_many_words_against_a_loop(spark, monkeypatch):
    draw = random.Random(3)
    word = lambda n: "".join(draw.choices("abcdé😀", k=n))
    words = [word(draw.choice([2, 3, 4, 5, 6, 7, 8])) for _ in range(400)] + ["", None, "abcd", "abcd"]
    pages = [[word(draw.randint(0, 14)) for _ in range(draw.randint(0, 6))] for _ in range(120)]
    pages += [["abcd"], ["xabcdx", "q"], [], None, [pages[0][0] if pages[0] else "", "q"]]
    listed = spark.createDataFrame([(w, 1) for w in words], "word string, id int")
    want = {i: b and [t for t in b if not any(w and w in t for w in words)] for i, b in enumerate(pages)}
    assert 0 < sum(len(b or []) for b in want.values()) < sum(len(b or []) for b in pages)
    assert kept(wordlists.drop_listed(frame(spark, pages), listed)) == want
    monkeypatch.setattr(keyed, "MAX_BROADCAST_KEYS", 2)  # all joins by shuffle
    assert kept(wordlists.drop_listed(frame(spark, pages), listed)) == want


def test_no_words_and_no_pages(spark):
    none = spark.createDataFrame([], "word string")
    some = spark.createDataFrame([("a",)], "word string")
    assert kept(wordlists.drop_listed(frame(spark, [["a", "b"]]), none)) == {0: ["a", "b"]}
    assert kept(wordlists.drop_listed(frame(spark, []), some)) == {}


def test_the_same_as_the_short_way(spark):
    df = frame(spark, [["one Advertisement", "two", "Photo: x"], ["plain"]])
    words = spark.createDataFrame([("Advertisement",), ("Photo:",)], "word string")
    assert kept(wordlists.drop_listed(df, words)) == kept(cleaning.drop_blocklisted(df, ["Advertisement", "Photo:"]))


def test_a_word_is_found_by_its_rarest_string(spark):
    texts = spark.createDataFrame([(i, "common" + ("xyzw" if i == 7 else "")) for i in range(20)], "id int, text string")
    words = spark.createDataFrame([("commonxyzw",), ("nowhere",)], "word string")
    anchors = {r["word"]: r["gram"] for r in wordlists.rarest_grams(words, texts).collect()}
    assert set(anchors) == {"commonxyzw"} and anchors["commonxyzw"] in {"monx", "onxy", "nxyz", "xyzw"}
    assert [r["id"] for r in wordlists.holding(texts, words).collect()] == [7]


def test_rows_do_not_grow_with_texts_times_words(spark, monkeypatch):
    words = ["".join(w) for w in itertools.product("ab", repeat=11)]
    short = ["".join(w) for w in itertools.product("ab", repeat=4)]
    pages = [[" ".join(random.Random(i).sample(short, 16)), words[i * 7]] for i in range(60)]  # the first holds all strings of 4
    frame_type, rows = type(spark.range(0)), []

    def counted(self, *a, f=frame_type.checkpoint, **b):
        out = f(self, *a, **b)
        rows.append(out.count())
        return out

    monkeypatch.setattr(frame_type, "checkpoint", counted)
    listed = spark.createDataFrame([(w,) for w in words], "word string")
    assert kept(wordlists.drop_listed(frame(spark, pages), listed)) == {i: b[:1] for i, b in enumerate(pages)}
    assert max(rows) <= len(words)


def test_strings_that_may_be_words(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from newscorpus.functions import substrings

    monkeypatch.setattr(substrings, "CHUNK", 64)  # chunks end inside of texts and words
    draw = random.Random(5)
    text = lambda n: "".join(draw.choices("abcdé😀", k=n))
    texts = [text(draw.choice([0, 1, 5, 40, 300])) for _ in range(200)]
    words = list({text(draw.randint(1, 9)).encode() for _ in range(900)} | {texts[-1].encode()[3:60], b"abc" * 50})
    bits = np.zeros(1 << 13, np.uint8)
    substrings.add_words(bits, pa.array(words, pa.binary()), 4)
    column = pa.array(["x"] + texts).cast(pa.binary())[1:]
    lengths = sorted({len(w) for w in words} - {0})
    met = {(r, w) for rows, found in substrings.candidates(column, bits, lengths, 4) for r, w in zip(rows.tolist(), found.to_pylist())}
    held = {(r, w) for r, t in enumerate(texts) for w in words if w and w in t.encode()}
    assert held <= met and all(w in texts[r].encode() for r, w in met)
    assert len(met) <= 1.1 * len(held)
