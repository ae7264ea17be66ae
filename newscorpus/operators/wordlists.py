"""Word lists too long to be tried one by one: the strings of a text are looked up in the list.

A bitmap of the list, of bounded size, goes to all tasks. A string of a text that begins and is as long
as a word, as far as the bitmap tells, is joined with the words as a whole. So no text meets the words
that only share a part with it, and the rows grow with the texts, not with texts times words.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from newscorpus.functions import substrings
from newscorpus.operators.cleaning import BLOCKS
from newscorpus.operators.keyed import broadcast_if_few
from newscorpus.session import shared_dir

GRAM = 4
# The bitmap of a list: its greatest size, reached at 16 million words, and the pieces it is made in.
MAX_BYTES, PIECE = 1 << 26, 1 << 17


def _grams(text: Column, size: int) -> Column:
    """Distinct strings of ``size`` characters of a text."""
    ends = F.sequence(F.lit(1), F.length(text) - size + 1)
    every = F.transform(ends, lambda i: F.substr(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def rarest_grams(words: DataFrame, texts: DataFrame, gram: int = GRAM) -> DataFrame:
    """(gram, word): for each word of ``gram`` characters or more that of its strings which the fewest
    texts hold; a word with a string that no text holds is left out, as nothing can hold it.
    """
    long = words.where(F.length("word") >= gram).select("word", F.explode_outer(_grams(F.col("word"), gram)).alias("gram"))
    wanted = broadcast_if_few(long.select("gram").distinct())
    held = texts.select(F.explode_outer(_grams(F.col("text"), gram)).alias("gram"))
    counts = held.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    told = long.join(counts, "gram", "left").select("word", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("_g"))
    return told.groupBy("word").agg(F.min("_g").alias("_g")).where("_g.n > 0").select("_g.gram", "word")


def _bitmap(listed: DataFrame, n_words: int, gram: int) -> Broadcast:
    """The words (column ``word``, binary) as a bitmap of 32 bits a word, of MAX_BYTES at most."""
    n_bytes = min(max(1 << (4 * n_words).bit_length(), PIECE), MAX_BYTES)

    def enter(batches):
        bits = np.zeros(n_bytes, np.uint8)
        for batch in batches:
            substrings.add_words(bits, batch.column(0), gram)
        for i in range(0, n_bytes, PIECE):
            if bits[i : i + PIECE].any():
                yield pa.RecordBatch.from_pylist([{"at": i, "bits": zlib.compress(bits[i : i + PIECE].tobytes(), 1)}], schema)

    def unite(pieces):
        every = [np.frombuffer(zlib.decompress(b.as_py()), np.uint8) for b in pieces["bits"]]
        return pa.Table.from_pylist([{"at": pieces["at"][0].as_py(), "bits": zlib.compress(np.bitwise_or.reduce(every).tobytes(), 1)}], schema)

    schema = pa.schema([("at", pa.int64()), ("bits", pa.binary())])
    pieces = listed.mapInArrow(enter, "at bigint, bits binary").groupBy("at").applyInArrow(unite, "at bigint, bits binary")
    bits = np.zeros(n_bytes, np.uint8)
    for r in pieces.collect():
        bits[r["at"] : r["at"] + PIECE] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return listed.sparkSession.sparkContext.broadcast(bits)


def ids_holding(texts: DataFrame, words: DataFrame, gram: int = GRAM) -> DataFrame:
    """``id`` of the rows of ``texts`` (id, text) whose text holds one of the words (column ``word``).

    Null and empty words count for nothing, repeated ones once; a null text holds no word. Every string
    of a text is looked up in a bitmap of the words, and those that it has are joined with the words.
    """
    shared_dir(texts.sparkSession)
    listed = words.select("word").where(F.length("word") > 0).distinct().select(F.col("word").cast("binary").alias("word")).checkpoint()
    sizes = [(r["n"], r["n_words"]) for r in listed.groupBy(F.octet_length("word").alias("n")).agg(F.count("*").alias("n_words")).collect()]
    found = StructType([texts.schema["id"], StructField("word", BinaryType())])
    if not sizes:
        return texts.sparkSession.createDataFrame([], found).select("id")
    lengths = sorted(n for n, _ in sizes)
    bitmap = _bitmap(listed, sum(n for _, n in sizes), gram)

    def look_up(batches):
        for batch in batches:
            for rows, strings in substrings.candidates(batch.column(1), bitmap.value, lengths, gram):
                some = pa.table({"row": rows, "word": strings}).group_by(["row", "word"], use_threads=False).aggregate([])
                met = pa.table({"id": batch.column(0).take(some["row"].combine_chunks()), "word": some["word"]})
                yield from met.combine_chunks().to_batches()

    maybe = texts.where("text is not null").select("id", F.col("text").cast("binary").alias("text")).mapInArrow(look_up, found)
    return maybe.join(listed, "word", "left_semi").select("id").distinct()


def holding(texts: DataFrame, words: DataFrame, gram: int = GRAM) -> DataFrame:
    """Rows of ``texts`` (id, text) whose text holds one of the words; ``id`` tells rows apart."""
    return texts.join(broadcast_if_few(ids_holding(texts, words, gram).checkpoint()), "id", "left_semi")


def drop_listed(df: DataFrame, words: DataFrame, gram: int = GRAM) -> DataFrame:
    """Pages with ``blocks``, without the blocks that hold one of the words.

    The same as ``cleaning.drop_blocklisted`` with ``contains``, for lists of any length. A block is known
    by its page and its place there, so that no text is shuffled to be found again. Pages are neither lost
    nor gained.
    """
    shared_dir(df.sparkSession)
    number = df.withColumn("_page", F.monotonically_increasing_id()).checkpoint()
    every = number.select("_page", F.posexplode_outer(F.transform(BLOCKS, lambda b: b["text"])).alias("_at", "text"))
    gone = ids_holding(every.select(F.struct("_page", "_at").alias("id"), "text"), words, gram)
    lists = gone.groupBy("id._page").agg(F.collect_set("id._at").alias("_gone"))
    places = F.array_except(F.sequence(F.lit(0), F.size(BLOCKS) - 1), F.col("_gone"))
    # Where a block goes, those without text go, too.
    kept = F.filter(F.transform(places, lambda i: F.get(BLOCKS, i)), lambda b: b["text"].isNotNull())
    met = number.join(lists, "_page", "left")
    return met.withColumn(BLOCKS, F.when(F.col("_gone").isNull(), F.col(BLOCKS)).otherwise(kept)).drop("_page", "_gone")
