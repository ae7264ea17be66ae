"""Mixture-controlled packing: deficit round-robin over sources, in closed form.

Every source is a queue of documents with a quantum per window, its target share of the window's
tokens. A queue sends documents while its quantum lasts; what the last one takes beyond it is a
deficit that the queue repays in the next windows. So the document that begins at token S of its
queue is sent in window floor(S / quantum): deficits need no state, and carry over windows and over
partitions alike. Sent documents form one stream, cut every ``length`` tokens into full sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.bpe import byte_letters
from llm.common import stored, table
from newscorpus.operators.ordering import with_positions

LENGTH = 2048
#: Sequences of a window, over which the mixture holds.
WINDOW = 32
#: Token after each document.
SEPARATOR = 1
#: The pattern that byte-level vocabularies split text by; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blanks in a row from which on a text goes to the slower library: the faster one fails near a million.
BLANKS = 100_000
_MANY_BLANKS = re.compile(rf"(?<!\s)\s{{{BLANKS}}}")


@lru_cache(2)
def load(path: str) -> tiktoken.Encoding:
    """A byte-level vocabulary file, read into the faster of two libraries with the same ids."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte = {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(2)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def encode(text: str, path: str) -> list[int]:
    """Ids of a text of any length, with whatever runs of blanks."""
    if len(text) >= BLANKS and _MANY_BLANKS.search(text):
        return library(path).encode(text, add_special_tokens=False).ids
    return load(path).encode(text, allowed_special="all")


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, row, n, ids (unsigned 32-bit numbers, or 16-bit where the vocabulary fits).

    Each document's ids, then the separator. A null text is empty; special tokens in a text are that
    token. ``row`` tells rows apart. The vocabulary file has to lie at ``path`` on every worker.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.monotonically_increasing_id().alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _kind(load(path))
        for batch in batches:
            ids = []
            for text in batch.column(3).to_pylist():
                ids.append(np.array([*encode(text or "", path), SEPARATOR], kind))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["doc_id", "source", "row", "n", "ids"],
            )

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, source string, row long, n long, ids binary")


def _kind(encoding: tiktoken.Encoding) -> type:
    return np.uint16 if encoding.n_vocab <= 1 << 16 else np.uint32


def layout(queued: DataFrame, shares: dict[str, float] | None = None, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """row, window, begin (place in the packed stream) for rows of (row, source, n).

    ``shares`` are target proportions by source, those named nowhere having none left over: a
    source without a share is sent after all others. None: each source's share of all tokens. A
    source's queue follows ``row``. When a queue is empty the rest goes on at its own proportions.
    """
    totals = queued.groupBy("source").agg(F.sum("n").alias("_tokens"))
    if shares is None:
        everything = totals.agg(F.sum("_tokens")).first()[0] or 1
        quanta = totals.select(F.col("source").alias("_source"), (F.col("_tokens") / F.lit(float(everything)) * (length * window)).alias("_quantum"))
    else:
        whole = sum(shares.values())
        quanta = queued.sparkSession.createDataFrame(
            [(s, p / whole * length * window) for s, p in shares.items()], "_source string, _quantum double"
        )
    in_queue = with_positions(queued, ["source"], [F.col("row")], position="_nth", running={"n": "_before"})
    sent = in_queue.join(quanta, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "row",
        "source",
        "n",
        F.coalesce(F.floor(F.col("_before") / F.col("_quantum")), F.lit((1 << 62) - 1)).cast("bigint").alias("window"),
        "_before",
    )
    order = [F.col("window"), F.col("source").asc_nulls_first(), F.col("_before"), F.col("row")]
    return with_positions(sent, [], order, position="_nth", running={"n": "begin"}).select("row", "window", "begin")


def pack(docs: DataFrame, path: str, shares: dict[str, float] | None = None, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids (as in ``tokenised``),
    doc_tokens, sequence_id, offset, window.

    Only the last sequence may be short of ``length``. Documents are cut at the ends of sequences
    and nowhere else. Repeated rows are packed as often as they occur; a null source is a queue of
    its own; an empty table has no pieces. Other columns are ignored.
    """
    tokens = stored(tokenised(docs, path), "tokens")
    placed = layout(tokens.select("row", "source", "n"), shares, length, window)
    rows = tokens.select("doc_id", "row", "n", "ids").join(placed, "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(_kind(load(path))).itemsize
        for batch in batches:
            n, begin = batch.column("n").to_numpy(), batch.column("begin").to_numpy()
            ids = batch.column("ids")
            row, start, size = [], [], []
            for i in range(len(n)):
                at = 0
                while at < n[i]:
                    step = min(n[i] - at, length - (begin[i] + at) % length)
                    row.append(i)
                    start.append(at)
                    size.append(step)
                    at += step
            row, start, size = (np.array(x, np.int64) for x in (row, start, size))
            place = begin[row] + start
            data = [ids[i].as_py() for i in range(len(n))]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(row)),
                "start": start,
                "length": size,
                "ids": pa.array([data[i][a * width : (a + s) * width] for i, a, s in zip(row, start, size)], pa.binary()),
                "doc_tokens": n[row],
                "sequence_id": place // length,
                "offset": place % length,
                "window": batch.column("window").to_numpy()[row],
            })

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window long"
    return rows.mapInArrow(cut, schema)


def digested(pieces: DataFrame, path: str) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``, the checksum of the ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _kind(load(path))
        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            at = batch.schema.get_field_index("ids")
            columns = batch.columns
            columns[at] = pa.array(sums, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, [n if n != "ids" else "ids_crc32" for n in batch.schema.names])

    schema = ", ".join(f"{'ids_crc32' if c == 'ids' else c} {'long' if c == 'ids' else t}" for c, t in pieces.dtypes)
    return pieces.mapInArrow(run, schema)


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed at the corpus's own proportions of sources."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return digested(pack(table(spark, sf_dir, "documents"), path), path)
