"""The registered queries without SQL, whole results against the libraries and plain rules."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_llm_texts import BASE, plain_spans
from tokenizers import Tokenizer

from llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r[0]: (r[1], r[2]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op5_is_the_library(spark, texts):
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_padding()
    library.no_truncation()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op5_bpe_segment_tree"](spark, SMALL).collect()}
    want = {}
    for d, (text, _) in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[d] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert got == want


def test_op10_pieces_make_the_documents(spark, texts):
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in QUERIES["op10_mixture_packing"](spark, SMALL).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for d, (text, _) in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, length, crc, whole in sorted(pieces[d]):
            assert start == at and whole == len(ids) and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    for n, spans in places.items():
        ends = np.cumsum([length for _, length in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and (ends[-1] == 2048 or n == max(places) and ends[-1] < 2048)


def test_op1_counts_and_spans(spark, texts):
    for r in QUERIES["op1_pii_anchor_expansion"](spark, SMALL).collect():
        text = texts[r["doc_id"]][0] or ""
        base = plain_spans(text)
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert [(int(a), int(b), k) for k, a, b in spans if k in BASE] == base
        assert all(r[f"n_{k}"] == sum(kind == k for *_, kind in base) for k in BASE)
        assert all(0 <= int(a) < int(b) <= len(text) for _, a, b in spans)


def test_op3_learns_from_the_others_only(spark, texts):
    learned = {lang for d, (_, lang) in texts.items() if zlib.crc32(str(d).encode()) % 5 and lang}
    right = []
    for r in QUERIES["op3_crf_language"](spark, SMALL).collect():
        text, lang = texts[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in learned or (r["lang_pred"] == "und" and not any(c.isalpha() for c in text or ""))
        if r["held_out"] and lang and text:
            right.append(r["lang_pred"] == lang)
    assert np.mean(right) > 0.9
