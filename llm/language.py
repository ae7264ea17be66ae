"""Language of each word by a linear-chain conditional random field, and of each document by its words.

Words are described by their form, affixes, character n-grams and lexicon entries, all hashed into
one weight table. Emissions and transitions are trained together, with gradients from
forward-backward, on a bounded sample of labelled documents that is spliced into code-switched
chains, so that transitions learn both to stay and to switch. Marginals come from forward-backward
as well; a document's language is the one with the largest share of its letters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import mix, powers, release, stored, table
from newscorpus.operators.keyed import broadcast_if_few

#: Letters of a word; a longer run of letters, as in scripts without blanks, is several words.
LETTERS = 24
WORD = re.compile(rf"[^\W\d_]{{1,{LETTERS}}}")
HASH_BITS = 18
#: Bounds of the training sample: documents of each language and of all, characters of each language.
TRAIN_DOCS = 400
MOST_DOCS = 20_000
TRAIN_CHARS = 400_000
#: Words of one chain; a longer text is several chains, each entered by the start weights.
CHAIN = 64
LEXICON = 400
#: Bit sets of more languages than fit 64 bits are taken modulo this prime.
WIDE = 2**64 - 59
CACHE = 200_000


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (2**HASH_BITS, labels), float32
    move: np.ndarray  # (labels, labels)
    start: np.ndarray
    lexicon: dict[str, int]  # word -> bit set of the languages it is frequent in


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs: form, prefixes and suffixes of 1 to 4, n-grams of 1 to 4, lexicon bits."""
    size = np.array([len(w) for w in words]) + 2
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(size)
    starts = ends - size
    row = np.repeat(np.arange(len(words)), size)
    up = powers(0x100000001B3, 5)
    rows, ids = [], []
    for n in range(1, 5):
        gram = sum(flat[k : len(flat) - n + 1 + k] * up[k] for k in range(n)) if len(flat) >= n else flat[:0]
        inside = row[: len(gram)] == row[n - 1 : n - 1 + len(gram)]
        rows.append(row[: len(gram)][inside])
        ids.append(mix(gram[inside] + np.uint64(n << 40)))
        long = size >= n + 2  # affixes: a plain n-gram with the edge it touches
        at = np.flatnonzero(long)
        for tag, place in ((5, starts[long] + 1), (6, ends[long] - 1 - n)):
            rows.append(at)
            ids.append(mix(gram[place] + np.uint64((tag << 44) + (n << 40))))
    form = np.add.reduceat(mix(flat + (np.arange(len(flat)) - np.repeat(starts, size)).astype(np.uint64) * np.uint64(0x10001)), starts)
    rows.append(np.arange(len(words)))
    ids.append(mix(form))
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if known:
        rows.append(np.array([i for i, _ in known]))
        ids.append(mix(np.array([b % WIDE for _, b in known], np.uint64) + np.uint64(7 << 44)))
    return np.concatenate(rows), (np.concatenate(ids) & np.uint64(2**HASH_BITS - 1)).astype(np.int64)


def emissions(words: list[str], model: Model) -> np.ndarray:
    row, feature = features(words, model.lexicon)
    return np.stack(
        [np.bincount(row, model.weights[feature, k], len(words)) for k in range(len(model.labels))], axis=1
    )


def forward_backward(scores: np.ndarray, valid: np.ndarray, move: np.ndarray, start: np.ndarray):
    """Marginals (chain, step, label) and expected transitions, of chains padded at their ends."""
    chains, steps, labels = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    m, alpha, beta = np.exp(move), np.empty_like(e), np.ones_like(e)
    a = np.exp(start) * e[:, 0]
    alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[:, t - 1] @ m) * e[:, t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, t] = np.where(valid[:, t, None], a, alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        b = (beta[:, t + 1] * e[:, t + 1]) @ m.T
        b /= b.sum(axis=1, keepdims=True)
        beta[:, t] = np.where(valid[:, t + 1, None], b, 1.0)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=2, keepdims=True)
    return marginal, alpha, beta, e, m


def train(texts: list[str], langs: list[str], seed: int = 7, epochs: int = 4, batch: int = 256) -> Model:
    """Fit on labelled texts. Chains are runs of words of one text, or of two or three spliced."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    runs: list[tuple[int, list[str]]] = []
    counts: list[dict[str, int]] = [{} for _ in labels]
    for text, lang in zip(texts, langs):
        words, k = WORD.findall(text.lower()), labels.index(lang)
        for w in words:
            counts[k][w] = counts[k].get(w, 0) + 1
        at = 0
        while at < len(words):
            n = int(rng.integers(1, CHAIN + 1))
            runs.append((k, words[at : at + n]))
            at += n
    lexicon: dict[str, int] = {}
    for k, c in enumerate(counts):
        for w in sorted(c, key=lambda w: (-c[w], w))[:LEXICON]:
            lexicon[w] = lexicon.get(w, 0) | 1 << k
    model = Model(labels, np.zeros((2**HASH_BITS, len(labels)), np.float32), np.zeros((len(labels),) * 2), np.zeros(len(labels)), lexicon)
    if not runs or len(labels) < 2:
        return model
    order = rng.permutation(len(runs))
    chains, at = [], 0
    while at < len(order):
        n = int(rng.choice([1, 1, 1, 2, 3]))
        picked = [runs[i] for i in order[at : at + n]]
        words = [w for _, run in picked for w in run][:CHAIN]
        chains.append((words, [k for k, run in picked for _ in run][:CHAIN]))
        at += n
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws, _ in chains for w in ws))}
    row, feature = features(list(vocabulary), lexicon)
    by = np.argsort(row, kind="stable")
    row, feature = row[by], feature[by]
    first = np.searchsorted(row, np.arange(len(vocabulary) + 1))
    square, step = np.full_like(model.weights, 1e-6), 0.5
    sums = [np.full_like(model.move, 1e-6), np.full_like(model.start, 1e-6)]
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for at in range(0, len(order), batch):
            part = [chains[i] for i in order[at : at + batch]]
            steps = max(len(ws) for ws, _ in part)
            ids = np.zeros((len(part), steps), np.int64)
            gold = np.zeros((len(part), steps), np.int64)
            valid = np.zeros((len(part), steps), bool)
            for i, (ws, ks) in enumerate(part):
                ids[i, : len(ws)] = [vocabulary[w] for w in ws]
                gold[i, : len(ks)] = ks
                valid[i, : len(ws)] = True
            used, place = np.unique(ids[valid], return_inverse=True)
            lens = first[used + 1] - first[used]
            wrow = np.repeat(np.arange(len(used)), lens)
            wfeat = feature[np.repeat(first[used] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())]
            scale = 1 / np.sqrt(lens)[:, None]
            word_scores = np.stack([np.bincount(wrow, model.weights[wfeat, k], len(used)) for k in range(len(labels))], 1) * 1.0
            scores = np.zeros((len(part), steps, len(labels)))
            scores[valid] = word_scores[place]
            marginal, alpha, beta, e, m = forward_backward(scores, valid, model.move, model.start)
            want = np.eye(len(labels))[gold]
            wrong = (marginal - want)[valid]
            per_word = np.stack([np.bincount(place, wrong[:, k], len(used)) for k in range(len(labels))], 1) * scale
            grad = np.stack([np.bincount(wfeat, per_word[wrow, k], len(model.weights)) for k in range(len(labels))], 1)
            hit = np.unique(wfeat)
            g = grad[hit] / len(part) + 1e-6 * model.weights[hit]
            square[hit] += g * g
            model.weights[hit] -= step * 0.2 * g / np.sqrt(square[hit])
            both = valid[:, 1:]
            pair = (alpha[:, :-1, :, None] * m) * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            seen = want[:, :-1, :, None] * want[:, 1:, None, :]
            for value, total, g in (
                (model.move, sums[0], ((pair - seen) * both[:, :, None, None]).sum(axis=(0, 1)) / len(part)),
                (model.start, sums[1], (marginal[:, 0] - want[:, 0]).sum(axis=0) / len(part)),
            ):
                total += g * g
                value -= step * 0.2 * g / np.sqrt(total)
    return model


def word_marginals(texts: list[list[str]], model: Model, cache: dict[str, int], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all words of the texts, one after the other, and each word's text."""
    words = [w for ws in texts for w in ws]
    owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in texts])
    new = list(dict.fromkeys(w for w in words if w not in cache))
    if new:
        if len(cache) > CACHE:
            cache.clear()
            rows.clear()
            new = list(dict.fromkeys(words))
        base = len(cache)
        cache.update({w: base + i for i, w in enumerate(new)})
        rows.append(emissions(new, model).astype(np.float32))
        rows[:] = [np.concatenate(rows)] if len(rows) > 8 else rows
    scores = (np.concatenate(rows) if len(rows) > 1 else rows[0])[np.fromiter((cache[w] for w in words), np.int64, len(words))]
    # Chains: each text's words in runs of CHAIN.
    nth = np.arange(len(words)) - np.searchsorted(owner, owner)
    head = np.flatnonzero(nth % CHAIN == 0)
    chain = np.cumsum(nth % CHAIN == 0) - 1
    place = np.arange(len(words)) - head[chain]
    out = np.empty((len(words), len(model.labels)), np.float32)
    for at in range(0, len(head), 4096):
        lo = head[at]
        hi = head[at + 4096] if at + 4096 < len(head) else len(words)
        c, p = chain[lo:hi] - at, place[lo:hi]
        padded = np.zeros((c[-1] + 1, p.max() + 1, len(model.labels)), np.float32)
        valid = np.zeros(padded.shape[:2], bool)
        padded[c, p], valid[c, p] = scores[lo:hi], True
        out[lo:hi] = forward_backward(padded, valid, model.move.astype(np.float32), model.start.astype(np.float32))[0][c, p]
    return out, owner


def sample(docs: DataFrame, docs_per_lang: int = TRAIN_DOCS, chars_per_lang: int = TRAIN_CHARS) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled texts for the fit: of each language ``docs_per_lang`` distinct
    texts, or its share of MOST_DOCS where languages are many, chosen by a digest of their text, and
    of each a window of characters at a place the digest sets, so that no language brings more than
    about ``chars_per_lang`` characters.
    """
    langs = docs.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).withColumnRenamed("lang", "_lang")
    langs = stored(langs, "languages")
    most = min(docs_per_lang, max(1, MOST_DOCS // max(1, langs.count())))
    # More are drawn than are kept, so that chance and the estimated counts leave no language short.
    drawn = most + 5 * math.sqrt(most) + 10
    width = max(1, chars_per_lang // docs_per_lang)
    draw = F.pmod(F.xxhash64("text", F.lit("draw")), F.lit(1 << 30))
    spare = F.greatest(F.char_length("text") - width, F.lit(0))
    rows = (
        docs.join(broadcast_if_few(langs), docs["lang"] == langs["_lang"])
        .where(draw < F.lit(float(1 << 30)) * drawn / F.col("n"))
        .select("lang", draw.alias("draw"), F.expr("pmod(xxhash64(text, 'place'), 1000003)").alias("_at"), spare.alias("_spare"), "text")
        .select("lang", "draw", F.substr("text", (F.floor(F.col("_at") / 1000003 * F.col("_spare")) + 1).cast("int"), F.lit(width)).alias("text"))
        .distinct()
        .withColumn("_nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text")))
        .where(F.col("_nth") <= most)
        .orderBy("draw", "lang", "text")
        .collect()
    )
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame) -> Model:
    """A model from rows with text and lang; rows without either are passed over."""
    return train(*sample(docs.where("text is not null and lang is not null").select("text", "lang")))


def predict(docs: DataFrame, model: Model, certainty: bool = False, prefix: str = "") -> DataFrame:
    """The columns of ``docs`` with ``lang_pred`` and ``score``, the mean marginal of that language
    over the text's letters. Null texts and texts without letters, and all texts if nothing was
    learned, give ``und`` and 0. Columns of these names are replaced. Map-only.

    ``certainty`` adds a column of that name, the mean over the text's letters of each word's
    likeliest language, whichever it is: 0 without letters, else 1 if nothing was learned.
    ``prefix`` goes before the names of all new columns.
    """
    added = [prefix + n for n in ("lang_pred", "score", "certainty")[: 2 + int(certainty)]]
    kept = docs.drop(*added)
    schema = kept.withColumns(dict(zip(added, (F.lit(""), F.lit(0.0), F.lit(0.0))))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        rows: list[np.ndarray] = []
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            split = [WORD.findall(t.lower()) if t else [] for t in texts]
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            sure = np.array([1.0 if ws else 0.0 for ws in split])
            if model.labels and any(split):
                marginal, owner = word_marginals(split, model, cache, rows)
                letters = np.array([len(w) for ws in split for w in ws], float)
                share = np.stack([np.bincount(owner, marginal[:, k] * letters, len(texts)) for k in range(len(model.labels))], 1)
                total = np.bincount(owner, letters, len(texts))
                some = total > 0
                best[some] = share[some].argmax(axis=1)
                score[some] = np.clip(share[some].max(axis=1) / total[some], 0, 1)
                sure[some] = np.clip(np.bincount(owner, marginal.max(axis=1) * letters, len(texts))[some] / total[some], 0, 1)
            names = pa.array([model.labels[b] if b >= 0 else "und" for b in best], pa.string())
            columns = [names, pa.array(score), pa.array(sure)][: len(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *added])
        release()

    return kept.mapInArrow(run, schema)


def held_out() -> F.Column:
    """True for the fifth of documents that is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
