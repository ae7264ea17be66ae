"""Ranked lexical search of many items at once, their common subexpressions evaluated once.

A document's score for an item is a sum over the item's terms. ``share`` mines term sets that items
have in common and makes them nodes of a graph: terms that occur in the same items are one node, and
the two nodes that most items hold side by side become a new one, as long as two items share it. For
each document a node's partial sum (its accumulator) is made once, and items add up a few nodes.

Items are taken in blocks of a bounded number of terms, whose vocabulary and graph go to all tasks.
Documents are read once for each block; what is kept of them are the counts of the block's terms.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import Spans, stored, table
from newscorpus.operators.ordering import with_positions

#: Results for each item.
TOP = 50
#: Terms of a block of items (an item counts as ITEM_COST terms more); one larger item is a block.
BLOCK_TERMS, ITEM_COST = 200_000, 200
#: Nodes among which shared sets are mined; rarer ones are summed as they are.
MINED = 1_000
#: Bytes of text looked at at once, and numbers of accumulators held at once.
CHUNK, ACCUMULATORS = 1 << 20, 1 << 22

# The bytes between terms (ASCII but letters and digits) and the score's constants.
GAPS = np.array([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
UNIT, RATE, LONG, LENGTH_SHARE = 1_000_000_000, 1000, 20, 50

_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.ones(256, bool)
_INSIDE[GAPS] = False


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, text number of each byte's piece as bounds): texts joined by blanks, long ones cut between terms.

    Yields the lowered bytes and an array of (first byte, text) rows.
    """
    parts: list[bytes] = []
    owner: list[tuple[int, int]] = []
    held = 0

    def flush():
        return _LOWER[np.frombuffer(b" ".join(parts), np.uint8)], np.array(owner)

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > size:
                gap = _GAP.search(text, at + size)
                end = gap.start() if gap else end
            if parts and held + end - at > size:
                yield flush()
                parts, owner, held = [], [], 0
            parts.append(text[at:end])
            owner.append((held, i))
            held += end - at + 1
            at = end
    if parts:
        yield flush()


def terms(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of letters, digits and bytes beyond ASCII."""
    edge = np.diff(_INSIDE[data].astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def distinct_terms(text: bytes) -> list[bytes]:
    found: set[bytes] = set()
    for data, _ in chunks([text]):
        raw = data.tobytes()
        found.update(raw[a:b] for a, b in zip(*(x.tolist() for x in terms(data))))
    return sorted(found)


class Vocabulary:
    """Numbers of known terms, found by hash and confirmed byte by byte."""

    def __init__(self, words: list[bytes]):
        self.bytes = np.frombuffer(b" ".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size + 1) - size - 1
        hashes = Spans(self.bytes).of(start, start + size)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.start, self.size, self.number = hashes[order], start[order], size[order], order

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the runs are known, their numbers)."""
        hashes = Spans(data).of(start, end)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        near = np.flatnonzero((self.hashes[at] == hashes) & (self.size[at] == end - start)) if len(self.hashes) else np.zeros(0, int)
        at, size = at[near], self.size[at[near]]
        # Equal hashes and lengths: compare the letters.
        first = np.cumsum(size) - size
        nth = np.arange(size.sum()) - np.repeat(first, size)
        differs = data[np.repeat(start[near], size) + nth] != self.bytes[np.repeat(self.start[at], size) + nth]
        same = np.add.reduceat(differs, first) == 0 if len(near) else np.zeros(0, bool)
        return near[same], self.number[at[same]]


class Sharing(NamedTuple):
    """``leaf`` is each term's node; node ``leaves + i`` is the sum of the two nodes ``pairs[i]``; an
    item is the sum of its ``nodes``."""

    leaves: int
    leaf: np.ndarray
    pairs: list[tuple[int, int]]
    nodes: list[np.ndarray]

    def additions(self) -> int:
        """Additions of accumulators for a document."""
        return len(self.pairs) + sum(max(0, len(n) - 1) for n in self.nodes)


def share(items: list[np.ndarray], n_terms: int, mined: int = MINED) -> Sharing:
    """The graph of term sets that ``items`` (arrays of distinct term numbers) share."""
    holders: list[list[int]] = [[] for _ in range(n_terms)]
    for i, item in enumerate(items):
        for t in item.tolist():
            holders[t].append(i)
    groups: dict[tuple[int, ...], int] = {}
    leaf = np.array([groups.setdefault(tuple(h), len(groups)) for h in holders], np.int64)
    sets = list(groups)
    common = sorted((n for n, held in enumerate(sets) if len(held) > 1), key=lambda n: (-len(sets[n]), n))[:mined]
    k, room = len(common), 3 * len(common)
    has = np.zeros((room, len(items)), np.float32)
    for row, n in enumerate(common):
        has[row, list(sets[n])] = 1
    both = np.zeros((room, room), np.float32)
    both[:k, :k] = has[:k] @ has[:k].T
    np.fill_diagonal(both, 0)
    most, arg = (both.max(1), both.argmax(1)) if k else (np.zeros(0), np.zeros(0, int))
    rows: list[tuple[int, int]] = []
    for new in range(k, room):
        i = int(most.argmax())
        j = int(arg[i])
        if most[i] < 2:
            break
        rows.append((i, j))
        has[new] = has[i] * has[j]
        has[i] -= has[new]
        has[j] -= has[new]
        three = [i, j, new]
        counts = has[three] @ has[: new + 1].T
        counts[[0, 1, 2], three] = 0
        both[three, : new + 1] = counts
        both[: new + 1, three] = counts.T
        stale = np.flatnonzero((arg == i) | (arg == j) | (both[:, new] > most))
        stale = np.union1d(stale, three)
        most[stale], arg[stale] = both[stale].max(1), both[stale].argmax(1)
    named = lambda row: common[row] if row < k else len(sets) + row - k
    alone = [n for n in range(len(sets)) if n not in set(common)]
    nodes: list[list[int]] = [[] for _ in items]
    for n in alone:
        for i in sets[n]:
            nodes[i].append(n)
    for row in range(k + len(rows)):
        for i in np.flatnonzero(has[row]).tolist():
            nodes[i].append(named(row))
    pairs = [(named(i), named(j)) for i, j in rows]
    return Sharing(len(sets), leaf, pairs, [np.array(n, np.int64) for n in nodes])


def accumulate(graph: Sharing, term: np.ndarray, doc: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores (item, document) from what each (term, document) is worth; accumulators are made once."""
    sums = np.zeros((graph.leaves + len(graph.pairs), n_docs), np.int64)
    np.add.at(sums, (graph.leaf[term], doc), value)
    for n, (a, b) in enumerate(graph.pairs, graph.leaves):
        np.add(sums[a], sums[b], out=sums[n])
    out = np.zeros((len(graph.nodes), n_docs), np.int64)
    for i, nodes in enumerate(graph.nodes):
        if len(nodes):
            np.sum(sums[nodes], axis=0, out=out[i])
    return out


def counted(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """doc_id, n, terms, counts: the number of all terms, and packed numbers and frequencies of known
    ones (32 bits each), for documents with a term."""
    known = docs.sparkSession.sparkContext.broadcast(words)  # of one block: bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(known.value)
        wide = np.int64(max(1, len(known.value)))
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            total, met = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)]
            for data, owner in chunks(texts):
                start, end = terms(data)
                text = owner[np.searchsorted(owner[:, 0], start, "right") - 1, 1]
                total += np.bincount(text, minlength=len(texts))
                which, number = vocabulary.find(data, start, end)
                met.append(text[which] * wide + number)
            pairs, times = np.unique(np.concatenate(met), return_counts=True)
            some = np.flatnonzero(total)
            first = np.searchsorted(pairs, some * wide)
            last = np.searchsorted(pairs, (some + 1) * wide)
            number, times = (pairs % wide).astype(np.uint32), times.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(some)), pa.array(total[some]),
                *(pa.array([x[a:b].tobytes() for a, b in zip(first, last)], pa.binary()) for x in (number, times)),
            ], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, terms binary, counts binary"
    )


def document_frequencies(found: DataFrame, n_terms: int) -> DataFrame:
    """term, df of rows of ``counted``; counts combine in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some])], ["term", "df"])

    return found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Best:
    """The best documents of each item so far; a document below the kth of an item is not held."""

    def __init__(self, items: int, k: int):
        self.k, self.least, self.parts, self.held = k, np.ones(items, np.int64), [], 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        if len(item):
            self.parts.append((item, scores[item, at], ids[at]))
            self.held += len(item)
            if self.held > 4 * self.k * len(self.least):
                self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            none = np.zeros(0, np.int64)
            return none, none, none
        item, score, ids = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(item, prepend=-1))
        nth = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        full = nth == self.k - 1
        self.least[item[full]] = score[full]
        kept = nth < self.k
        self.parts, self.held = [(item[kept], score[kept], ids[kept])], int(kept.sum())
        return self.parts[0]


def _search(found: DataFrame, graph: Sharing, rows: list[int], weight: np.ndarray, n_docs: int, all_terms: int, k: int) -> DataFrame:
    """item (its row), doc_id, score: the k best of each task."""
    sent = found.sparkSession.sparkContext.broadcast((graph, weight, np.array(rows, np.int64)))
    none = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weight, rows = sent.value
        best = Best(len(rows), k)
        step = max(1, ACCUMULATORS // (graph.leaves + len(graph.pairs) + len(rows) + 1))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                ids = part.column("doc_id").fill_null(none).to_numpy()
                packed = part.column("terms").to_pylist()
                number = np.frombuffer(b"".join(packed), np.uint32).astype(np.int64)
                times = np.frombuffer(b"".join(part.column("counts").to_pylist()), np.uint32).astype(np.int64)
                doc = np.repeat(np.arange(len(part)), [len(x) // 4 for x in packed])
                # Numbers of any size: the product may leave 64 bits where texts are very long.
                norm = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // all_terms for n in part.column("n").to_pylist()], np.int64)
                value = weight[number] * (UNIT * times // (RATE * times + LONG * norm[doc]))
                best.add(accumulate(graph, number, doc, value, len(part)), ids)
        item, score, ids = best.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[item]), pa.array([None if i == none else i for i in ids.tolist()], pa.int64()), pa.array(score)],
            ["item", "doc_id", "score"],
        )

    return found.mapInArrow(run, "item long, doc_id long, score long")


def item_blocks(items: DataFrame, most: int = BLOCK_TERMS) -> tuple[DataFrame, int]:
    """(row, item_id, words, block) for each item, stored, and the number of blocks."""
    kind = dict(items.dtypes)["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [distinct_terms(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words, pa.list_(pa.binary()))], ["row", "item_id", "words"])

    rows = items.select(F.monotonically_increasing_id().alias("row"), "item_id", "text")
    rows = stored(rows.mapInArrow(run, f"row long, item_id {kind}, words array<binary>"), "items")
    sizes = rows.select("row", (F.size("words") + ITEM_COST).cast("long").alias("cost"))
    placed = with_positions(sizes, [], [F.col("row")], running={"cost": "before"})
    blocks = placed.select("row", F.floor(F.col("before") / most).cast("int").alias("block"))
    last = blocks.agg(F.max("block")).first()[0]
    return stored(rows.join(blocks, "row"), "blocks"), 0 if last is None else last + 1


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for each item.

    Equal scores are ranked by ascending doc_id (a number; null last). Every row of ``docs`` is a
    document and every row of ``items`` an item, repeated ids and texts included; a null text has no
    terms, and an item or document without terms no results. Texts of any length are read whole.
    Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows, blocks = item_blocks(items, block_terms)
    best = None
    for block in range(blocks):
        taken = rows.where(F.col("block") == block).select("row", "words").orderBy("row").collect()  # a bounded block
        words = sorted({bytes(w) for r in taken for w in r["words"]})
        if not words:
            continue
        found = stored(counted(docs, words), "counted")
        n_docs, all_terms = found.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        weight = np.zeros(len(words), np.int64)
        for term, df in document_frequencies(found, len(words)).collect():  # a row for each of the block's terms
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        number = {w: i for i, w in enumerate(words)}
        graph = share([np.array([number[bytes(w)] for w in r["words"]], np.int64) for r in taken], len(words))
        part = _search(found, graph, [r["row"] for r in taken], weight, n_docs, all_terms, k)
        best = part if best is None else best.unionAll(part)
    if best is None:
        kind = dict(items.dtypes)["item_id"]
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # In two steps, since each task of a large corpus sends k rows for each item.
    for by in ([F.col("item"), F.pmod(F.xxhash64("doc_id"), F.lit(64))], [F.col("item")]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    named = rows.select(F.col("row").alias("item"), "item_id")
    return best.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_shared_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of all for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
d AS (SELECT row, doc_id, terms, len(terms) AS n FROM t WHERE len(terms) > 0),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS all_terms FROM d),
i AS (
  SELECT row_number() OVER () AS item, item_id,
    list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
  FROM benchmark),
q AS (SELECT item, item_id, unnest(terms) AS term FROM i),
f AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM f, c GROUP BY term),
s AS (
  SELECT item, item_id, doc_id, row,
    sum(weight * (({UNIT} * tf) // ({RATE} * tf + {LONG} * (100 - {LENGTH_SHARE} + ({LENGTH_SHARE} * n * n_docs) // all_terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN d USING (row), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
