"""Helpers of the operators: stored intermediate tables, packed number columns, linked components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newscorpus.session import shared_dir, work_path

#: Rows of an Arrow batch that goes to a Python worker; long texts make larger rows useless.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release() -> None:
    """Give freed memory of a Python worker back: workers are kept, and later stages need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with batches for Python kept small enough for very long texts."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and fixes values for later reads."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_prefix(columns: list[str]) -> str:
    """Underscores that no column begins with, for names of columns that are added for a while."""
    prefix = "_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


#: A key of more than one row in this many is hot; so there are at most this many hot keys.
HOT_SHARE = 1000


def lookup(rows: DataFrame, named: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row that ``named`` has for each ``key`` (how: inner or left).

    Any share of ``rows`` may have one key: those of hot keys, at most HOT_SHARE of them, meet their
    rows of ``named`` by broadcast, only the others by shuffle. Both sides are read twice; pass
    stored, narrow rows without null keys.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = stored(counts.where(F.col("_n") * HOT_SHARE > total).select(key), "hot")
    if hot.isEmpty():
        return rows.join(named, key, how)
    of_hot = F.broadcast(named.join(F.broadcast(hot), key, "left_semi"))
    often = rows.join(F.broadcast(hot), key, "left_semi").join(of_hot, key, how)
    return often.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(named, key, how))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)


class Spans:
    """Hashes of any span of a byte array in constant time each, from prefix sums modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15
    _up = _down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Spans._up) < n:
            size = max(n, 1 << 16)
            Spans._up = powers(self.BASE, size)
            Spans._down = powers(pow(self.BASE, -1, 2**64), size)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Spans._up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Spans._down[start] + (end - start).astype(np.uint64))


# Packed rows: a few rows of binary columns that hold numpy arrays, one row per bucket and batch.
# The shuffle then moves blocks, not millions of rows.


def packed_schema(names: list[str]) -> str:
    return "bucket int, " + ", ".join(f"{n} binary" for n in names)


def pack(buckets: int, by: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Deal equally long arrays out to buckets by the hash ``by``, one packed row for each."""
    if not len(by):
        return
    bucket = (by % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    ids = bucket[order][bounds]
    ends = np.append(bounds[1:], len(order))
    cut = {n: c[order] for n, c in columns.items()}
    yield pa.RecordBatch.from_pydict(
        {"bucket": pa.array(ids, pa.int32())}
        | {n: pa.array([c[a:b].tobytes() for a, b in zip(bounds, ends)], pa.binary()) for n, c in cut.items()}
    )


def unpack(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist() if x is not None]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def by_bucket(df: DataFrame, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``fn`` to all packed rows of each bucket."""

    def run(group: pa.Table) -> pa.Table:
        batches = list(fn(group))
        release()
        return pa.Table.from_batches(batches) if batches else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return df.groupBy("bucket").applyInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b) edges; the component is its smallest node.

    Alternates two star steps: each node hands its smallest neighbour to its larger neighbours,
    then to its smaller ones. The number of rounds grows with the logarithm of the longest chain;
    minima combine on the map side, and each round is checkpointed. Loops are ignored.
    """
    shared_dir(edges.sparkSession)

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = tidy(edges).checkpoint()
    seen = sign(now)
    while seen[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = tidy(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.*")
        now = tidy(small).checkpoint()
        seen, before = sign(now), seen
        if seen == before:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return roots.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy(
        "node").agg(F.min("component").alias("component"))


def joined(spans: Column) -> Column:
    """kind:start:end of an array of such structs, with commas between them."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
