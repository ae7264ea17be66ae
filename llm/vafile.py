"""Exact top-k inner product search with vector-approximation files.

Each dimension's integer range is cut into equal cells, once for all rows; a vector's approximation is
its row of small cell numbers. Blocks of queries scan blocks of approximations, an eighth of the
vectors' size: each candidate gets bounds on its score, and only those that may be among a query's k
best go on. Exact vectors are then read in the order of the bounds, first a few for each query, then
those whose bound still reaches the kth result so far. What is not read cannot be a result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import stored, table
from newscorpus.operators.keyed import broadcast_if_few

#: Cells per dimension, and rows of a block of candidates and of queries.
CELLS = 64
CANDIDATES = 16_384
QUERIES = 2_048
#: Exact vectors read first for a query, times k.
READ = 2


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in the narrowest type that holds every partial sum exactly."""
    most = np.abs(a).astype(float).max(initial=0) * np.abs(b).astype(float).max(initial=0) * max(a.shape[1], 1)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
    return (a.astype(kind) @ b.T.astype(kind)).astype(np.int64)


def scan(queries: np.ndarray, q_rows: np.ndarray, cells: np.ndarray, v_rows: np.ndarray, low: np.ndarray, width: np.ndarray, k: int):
    """(query position, candidate position, lower bound, upper bound) of the candidates of a block that
    may be among a query's k best: those whose upper bound reaches the kth largest lower bound.

    A component lies in [low + cell * width, ... + width - 1].
    """
    base = low + cells.astype(np.int64) * width
    found = []
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        scores = _product(q, base)  # of the cells' lower ends
        least = np.minimum(q, 0) @ (width - 1)
        most = np.maximum(q, 0) @ (width - 1)
        for i in range(len(q)):
            others = np.flatnonzero(v_rows != q_rows[at + i])
            if not len(others):
                continue
            line = scores[i][others]
            want = min(k, len(line))
            floor = np.partition(line, len(line) - want)[len(line) - want] + least[i]
            near = np.flatnonzero(line + most[i] >= floor)
            found.append((np.full(len(near), at + i), others[near], line[near] + least[i], line[near] + most[i]))
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found) if found else ([], [], [], []))]


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def integers(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each query row.

    ``vectors`` has vec_id and vector (array of bigint, no nulls). Ties go to the smaller vec_id. A
    vector is compared with those of its own length only. Rows are told apart by a number of their
    own, so repeated ids are separate candidates, and a query that repeats gives its rows once for
    each. Sums beyond 64 bits are out of range. Fewer rows than k give all; an empty table nothing.
    """
    # Row numbers deal rows out evenly whatever their ids; stored, since they must not change.
    rows = stored(
        vectors.select("vec_id", "vector", F.size("vector").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("q"),
                       F.monotonically_increasing_id().alias("row")),
        "vectors",
    )
    near = candidate_pairs(rows, k, candidates, queries)
    # Exact vectors, in the order of the bounds: first a few, whose kth score is the least a result can have.
    order = Window.partitionBy("q_row").orderBy(F.desc("upper"), "v_row")
    ranked = stored(near.withColumn("_nth", F.row_number().over(order)), "near")
    first = stored(_exact(ranked.where(F.col("_nth") <= READ * k), rows), "first")
    best = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "v_row"))
    kth = first.withColumn("_nth", best).where(F.col("_nth") == k).select("q_row", F.col("score").alias("_kth"))
    unread = ranked.where(F.col("_nth") > READ * k).join(kth, "q_row").where(F.col("upper") >= F.col("_kth"))
    results = first.unionAll(_exact(unread, rows))
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "v_row")
    return (
        results.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _exact(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """q_row, v_row, query_id, vec_id, score of pairs of rows, from the vectors themselves."""
    theirs = rows.select(F.col("row").alias("v_row"), "vec_id", F.col("vector").alias("_v"))
    ours = rows.where("q").select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"), F.col("vector").alias("_q"))
    score = F.aggregate(F.zip_with("_q", "_v", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, x: a + x)
    met = pairs.select("q_row", "v_row").join(theirs, "v_row").join(ours, "q_row")
    return met.select("q_row", "v_row", "query_id", "vec_id", score.alias("score"))


def approximations(rows: DataFrame, chosen: DataFrame, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """(row, dim, cells) of the chosen rows, and dim, low, width: the cells of vectors of that length."""
    parts = rows.select("dim", F.posexplode_outer("vector").alias("pos", "x")).where("pos is not null")
    ends = parts.groupBy("dim", "pos").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    wide = F.floor((F.col("high") - F.col("low")) / F.lit(cells)).cast("bigint") + 1
    ends = ends.select("dim", F.struct("pos", "low", wide.alias("width")).alias("e"))
    every = F.array_sort(F.collect_list("e"))
    ends = ends.groupBy("dim").agg(every.alias("e"))
    column = lambda name: F.coalesce(F.transform("e", lambda e: e[name]), F.array().cast("array<bigint>")).alias(name)
    ranges = stored(rows.select("dim").distinct().join(ends, "dim", "left").select("dim", column("low"), column("width")), "ranges")
    above = F.zip_with("vector", "low", lambda x, low: x - low)
    cell = F.zip_with(above, "width", lambda x, width: F.floor(x / width).cast("smallint"))
    filed = chosen.join(broadcast_if_few(ranges), "dim").select("row", "dim", cell.alias("cells"))
    return stored(filed, "approximations"), ranges


def candidate_pairs(rows: DataFrame, k: int, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """q_row, v_row, lower, upper of the pairs whose bounds let them be among the query's k best.

    Of equal vectors the k + 1 of the smallest vec_id are candidates: ties go to these, and a query is
    one of them at most. So many copies of a vector are not many pairs.
    """
    copies = Window.partitionBy("dim", F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")).orderBy(F.col("vec_id").asc_nulls_last(), "row")
    filed, ranges = approximations(rows, rows.withColumn("_nth", F.row_number().over(copies)).where(F.col("_nth") <= k + 1))
    total = filed.count(), rows.where("q").count()
    across, down = (max(1, math.ceil(n / size)) for n, size in zip(total, (candidates, queries)))
    spread = F.shiftrightunsigned(F.xxhash64("row"), 1)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = rows.where("q").join(broadcast_if_few(ranges), "dim").select("row", "dim", "vector", "low", "width")
    left = asked.withColumn("qb", spread % down).withColumn("cb", numbers(across))
    right = filed.withColumn("cb", spread % across).withColumn("qb", numbers(down))
    names = ["q_row", "v_row", "lower", "upper"]

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        if not len(q) or not len(v):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        dim = q["dim"][0].as_py()
        ours, theirs = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), dim) for t, c in ((q, "vector"), (v, "cells")))
        low, width = (np.array(q[c][0].as_py(), np.int64) for c in ("low", "width"))
        rows_q, rows_v = q["row"].to_numpy(), v["row"].to_numpy()
        i, j, lower, upper = scan(ours, rows_q, theirs, rows_v, low, width, k)
        return pa.table([pa.array(x, pa.int64()) for x in (rows_q[i], rows_v[j], lower, upper)], names=names)

    schema = ", ".join(f"{n} long" for n in names)
    near = stored(left.groupBy("qb", "cb", "dim").cogroup(right.groupBy("qb", "cb", "dim")).applyInArrow(run, schema), "candidates")
    if across == 1:
        return near
    # The kth largest lower bound of all blocks.
    nth = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("lower"), "v_row"))
    floor = near.withColumn("_nth", nth).where(F.col("_nth") == k).select("q_row", F.col("lower").alias("_floor"))
    return near.join(floor, "q_row", "left").where(F.col("_floor").isNull() | (F.col("upper") >= F.col("_floor"))).select(*names)


def op4_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other rows for every row whose vec_id is divisible by 20, among all usable rows."""
    rows = table(spark, sf_dir, "embeddings")
    good = rows.where(usable(F.col("embedding"))).select("vec_id", integers(F.col("embedding")).alias("vector"))
    return top_k(good, F.col("vec_id") % 20 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    list_sum(list_transform(list_zip(q.vector, v.vector), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
