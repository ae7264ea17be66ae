"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A word's adjacent pairs are the leaves of a tree of minima over (rank, place): the root names the
leftmost pair of lowest rank. A merge changes three leaves and their ancestors, so a word of n
symbols takes O(n log n), however long it is. The trees of many short words are rows of one array
and are worked on together; a long word has a tree of its own. Words are encoded once per worker
and then looked up.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.common import table

#: Words after which a worker's store begins a new generation; words in use survive the change.
CACHE = 400_000
#: Bytes up to which words share arrays: those of each width together, so many at a time.
WIDTHS, TOGETHER = (8, 16, 32), 20_000
#: Characters of text encoded at a time; a longer text is one step.
FLUSH = 4_000_000

_SPACE = r"\p{White_Space}"
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: Separators that the vocabulary's pattern does not take for white space, and characters beyond
#: the scripts whose classes and cases are the same in every version of Unicode.
_ODD = re.compile("[\x1c-\x1f]|[^\x00-\u0377\u0400-\u052f\u2000-\u206f\u20a0-\u20b5\u2190-\u23ff]")
_NONE = 1 << 62


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def merge(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Merge the leftmost pair of lowest rank until none is left.

    ``pairs`` maps ``a << 16 | b`` to (rank << 32, merged); ``symbols`` is used up.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    tree = [_NONE] * (2 * size)
    find, i = pairs.get, size
    for a, b in zip(symbols, symbols[1:]):
        if found := find(a << 16 | b):
            tree[i] = found[0] | i
        i += 1
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (low := tree[1]) != _NONE:
        # A leaf holds its own place in the tree, so of equal ranks the leftmost is least.
        i = (low & 0xFFFFFFFF) - size
        j = after[i]
        k = after[i] = after[j]
        symbols[i] = merged = find(symbols[i] << 16 | symbols[j])[1]
        symbols[j] = -1
        changed = [(size + i, _NONE)]
        if k < n:
            before[k] = i
            changed.append((size + j, _NONE))
            if found := find(merged << 16 | symbols[k]):
                changed[0] = (size + i, found[0] | (size + i))
        if (h := before[i]) >= 0:
            found = find(symbols[h] << 16 | merged)
            changed.append((size + h, found[0] | (size + h) if found else _NONE))
        for i, value in changed:
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low
    return [s for s in symbols if s >= 0]


class Pairs:
    """Ranks and results of all merges, looked up for arrays of pairs."""

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] >> 32 for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)

    def find(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf values (rank, then place) and merged symbols; a symbol of -1 has no pair."""
        key = a << 16 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at] << 8 | place, _NONE), self.merged[at]


def merge_many(symbols: np.ndarray, pairs: Pairs) -> np.ndarray:
    """``merge`` for rows of symbols, filled up with -1 at their ends; merged ones become -1."""
    n, width = symbols.shape
    # Column `width` stands for the end of a word, column `width + 1` for what is before its start.
    symbols = np.concatenate([symbols, np.full((n, 2), -1)], axis=1)
    after = np.tile(np.append(np.arange(1, width + 1), [width, width]), (n, 1))
    after[:, :width][symbols[:, 1 : width + 1] < 0] = width
    before = np.tile(np.append([width + 1], np.arange(width + 1)), (n, 1))
    before = np.concatenate([before[:, : width + 1], np.full((n, 1), width + 1)], axis=1)
    tree = np.full((n, 2 * width), _NONE)
    result = np.zeros((n, width), np.int64)
    tree[:, width:], result[:] = pairs.find(symbols[:, :width], symbols[:, 1 : width + 1], np.arange(width))
    for i in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        i = tree[rows, 1] & 0xFF
        j = after[rows, i]
        k = after[rows, j]
        h = before[rows, i]
        merged = result[rows, i]
        symbols[rows, i], symbols[rows, j] = merged, -1
        after[rows, i], before[rows, k] = k, i
        tree[rows, width + j] = _NONE
        tree[rows, width + i], result[rows, i] = pairs.find(merged, symbols[rows, k], i)
        some = h < width
        tree[rows[some], width + h[some]], result[rows[some], h[some]] = pairs.find(symbols[rows[some], h[some]], merged[some], h[some])
        for leaf, of in ((i, rows), (j, rows), (h[some], rows[some])):
            node = (width + leaf) >> 1
            while node.size and node[0]:
                tree[of, node] = np.minimum(tree[of, 2 * node], tree[of, 2 * node + 1])
                node = node >> 1
        rows = rows[tree[rows, 1] != _NONE]
    return symbols[:, :width]


class WordBpe:
    """A vocabulary file of the word kind: lower case, white space dropped, word ends marked."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        if len(self.vocab) > 1 << 16:
            raise ValueError("pairs are keyed by two ids of 16 bits")
        self.pairs = {
            self.vocab[a] << 16 | self.vocab[b]: (rank << 32, self.vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])
        }
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.plain = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        self._arrays, self._plain, self._last = Pairs(self.pairs), np.array(self.plain), np.array(self.last)
        names = {i: t for t, i in (self.vocab | self.special).items()}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        # Normalises and cuts texts of other scripts, as its own version of Unicode has it.
        library = Tokenizer.from_file(path)
        self._normalizer, self._cutter = library.normalizer, library.pre_tokenizer
        self._split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        # Ids as packed 32-bit numbers: half a million lists would keep the garbage collector busy.
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> None:
        """Encode words that this generation has not met."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw])
        done = 0
        for width in WIDTHS:
            fit = np.flatnonzero((size > done) & (size <= width))
            done = width
            for at in range(0, len(fit), TOGETHER):
                part = fit[at : at + TOGETHER]
                data = np.frombuffer(b"".join(raw[i] for i in part), np.uint8)
                n = size[part]
                row, place = np.repeat(np.arange(len(part)), n), np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)
                symbols = np.full((len(part), width), -1)
                symbols[row, place] = np.where(place == n[row] - 1, self._last[data], self._plain[data])
                symbols = merge_many(symbols, self._arrays)
                kept = symbols >= 0
                ends = np.cumsum(kept.sum(axis=1)).tolist()
                flat, start = symbols[kept].astype(np.int32).tobytes(), 0
                for i, end in zip(part.tolist(), ends):
                    self._known[words[i]] = flat[4 * start : 4 * end]
                    start = end
        for i in np.flatnonzero(size > done).tolist():
            ids = merge([*(self.plain[b] for b in raw[i][:-1]), self.last[raw[i][-1]]], self.pairs)
            self._known[words[i]] = np.array(ids, np.int32).tobytes()

    def _learn(self, parts: Iterable[str], cut: bool = True) -> None:
        """Make ids of all parts known: runs without white space, or words that are ``cut`` already."""
        if len(self._known) > CACHE:
            self._older, self._known = self._known, {}
        known, older = self._known, self._older
        parts = [w for w in parts if w not in known]
        known.update((w, older[w]) for w in parts if w in older)
        new = {w: _WORDS.findall(w) if cut else [w] for w in parts if w not in older}
        self._words(list({w for words in new.values() for w in words if w not in known}))
        for w, words in new.items():
            if w not in known:
                known[w] = b"".join(known[x] for x in words)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self._split.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                plain = self._normalizer.normalize_str(part)
                words = [plain[a:b] for _, (a, b) in self._cutter.pre_tokenize_str(plain)]
                self._learn(words, cut=False)
                ids += np.frombuffer(b"".join(self._known[w] for w in words), np.int32).tolist()
        return ids

    def encode_batch(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text.

        No word spans white space, so texts are cut there and the distinct runs looked up. Texts
        with special tokens or odd characters go one by one.
        """
        odd = [i for i, t in enumerate(texts) if "<|" in t or _ODD.search(t)]
        of_odd = {i: self.encode(texts[i]) for i in odd}
        # Capital sigma is lowered by itself: final forms depend on neighbours otherwise.
        plain = ["" if i in of_odd else unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for i, t in enumerate(texts)]
        runs = pc.utf8_split_whitespace(pa.array(plain, pa.large_string()))
        coded = runs.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn(w for w in distinct if w)
        of_run = [self._known[w] if w else b"" for w in distinct]
        size = np.fromiter(map(len, of_run), np.int64, len(of_run)) // 4
        values = np.frombuffer(b"".join(of_run), np.int32)
        code = coded.indices.to_numpy()
        count = size[code]
        ends = np.cumsum(count)
        begin = (np.cumsum(size) - size)[code]
        flat = values[np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends)[runs.offsets.to_numpy()]
        if not odd:
            return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
        out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for i, ids in of_odd.items():
            out[i] = np.array(ids, np.int32)
        return pa.array(out, pa.list_(pa.int32()))

    def decode_batch(self, ids: pa.ListArray) -> pa.StringArray:
        """Tokens with a blank between them, as a vocabulary without a decoder is decoded."""
        words = pa.array(self.tokens, pa.string()).take(ids.flatten())
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, words), " ")

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """The columns of ``docs`` but text, with ``ids`` (array of int) and ``decoded``.

    A null text is empty: no ids, an empty string. Special tokens in a text are that token. The
    vocabulary file has to lie at ``path`` on every worker. Map-only; columns of these names are
    replaced.
    """
    kept = docs.drop("ids", "decoded")
    names = [c for c in kept.columns if c != "text"]
    schema = kept.select(*names, F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("string").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            rest, at = batch.select(names), 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= FLUSH):
                    held += len(texts[end])
                    end += 1
                ids = bpe.encode_batch(texts[at:end])
                decoded = bpe.decode_batch(ids).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*rest.slice(at, end - at).columns, ids, decoded], [*names, "ids", "decoded"])
                at = end

    return kept.mapInArrow(run, schema)


def op5_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
