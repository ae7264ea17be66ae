"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Unit vectors are rounded to 8 bits. The rounding error of each vector is measured, and with it the
product of two rounded vectors bounds their cosine from both sides. Whole tiles are multiplied in
8-bit numbers; only pairs that the bound lets reach the threshold are computed in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import components, lookup, stored, table
from llm.vafile import usable

THRESHOLD = 0.93
TILE = 2048
#: Rows of a tile multiplied at a time, and pairs computed in double precision at a time.
STRIPE, PAIRS = 256, 32_768


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Norms, 8-bit numbers, their scale, and the length of each unit vector's rounding error."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    unit = vectors / norms[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    error = unit - small * scale[:, None]
    return norms, small, scale, np.sqrt(np.einsum("ij,ij->i", error, error)) + 1e-12


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, threshold: float = THRESHOLD):
    """Index pairs (i, j) of rows of ``a`` and ``b`` with cosine at or above the threshold; i < j
    where both are the ``same`` tile."""
    (na, qa, sa, ea), (nb, qb, sb, eb) = quantise(a), quantise(b)
    kind = np.float32 if a.shape[1] * 127**2 < 2**24 else np.float64  # holds the integer sums exactly
    right, found = qb.T.astype(kind), []
    for at in range(0, len(a), STRIPE):
        rows = slice(at, at + STRIPE)
        near = (qa[rows].astype(kind) @ right).astype(np.float64) * sa[rows, None] * sb
        # |u.v - u'v'| <= |u - u'| |v| + |u'| |v - v'|, with |u'| <= 1 + |u - u'|
        bound = ea[rows, None] + (1 + ea[rows, None]) * eb + 1e-9
        i, j = np.nonzero(near + bound >= threshold)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        for p in range(0, len(i), PAIRS):
            x, y = i[p : p + PAIRS], j[p : p + PAIRS]
            hit = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
            found.append((x[hit], y[hit]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component, by handing minima along the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding, label).

    Rows link when their labels are equal and not null and their cosine, in double precision,
    reaches the threshold. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; vectors of unequal length do not link. Equal vectors of a label are compared
    once and counted as often as they occur, so no group of copies is expanded into pairs; tiles
    report link counts and one root per vector, never all pairs. ``kept`` is whether vec_id is the
    smallest of its component; rows that repeat a vec_id are separate. An empty table gives none.
    """
    all_rows = stored(rows.select("vec_id", "embedding", "label", F.monotonically_increasing_id().alias("_row")), "rows")
    good = usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull()
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    kept = all_rows.where(good).select("vec_id", "_row", "label", doubles.alias("v"))
    # Equal vectors of a label are a class, told by 128 bits of hashes: rows meet their class on these,
    # not on whole vectors, and any share of the rows may be of one class.
    key = F.struct(F.xxhash64("label", "v").alias("one"), F.xxhash64("v", F.lit(1), "label").alias("two"))
    keyed = stored(kept.select("vec_id", "_row", key.alias("key")), "keys")
    first = keyed.groupBy("key").agg(F.min("_row").alias("c"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = stored(kept.join(first, F.col("_row") == F.col("c")).select("key", "label", "v", "c", "copies", "least"), "classes")
    classes = classes.withColumn("dim", F.size("v"))
    tiles = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("bigint").alias("tiles"))
    dealt = classes.join(tiles, ["label", "dim"]).select(
        "label",
        "dim",
        "c",
        "copies",
        "v",
        F.pmod(F.xxhash64("c"), "tiles").alias("own"),
        F.explode(F.expr("sequence(0L, tiles - 1)")).alias("other"),
    )
    met = dealt.select("*", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    schema = "c long, links long, root long"

    def run(group: pa.Table) -> pa.Table:
        c, own, copies = (group[n].to_numpy() for n in ("c", "own", "copies"))
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        v = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(group), -1)
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        i, j = tile_links(v[left], v[right], lo == hi, threshold)
        i, j = left[i], right[j]
        links = np.bincount(i, copies[j], len(c)) + np.bincount(j, copies[i], len(c))
        order = np.argsort(c)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        root = c[order][roots(len(c), rank[i], rank[j])][rank]
        some = links > 0
        return pa.table({"c": c[some], "links": links[some].astype(np.int64), "root": root[some]})

    found = stored(met.groupBy("label", "dim", "lo", "hi").applyInArrow(run, schema), "links")
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    named = classes.select("key", "c", "copies", "least").join(counts, "c", "left").join(
        groups.withColumnRenamed("node", "c"), "c", "left"
    ).select("key", "c", "copies", "least", "links", F.coalesce("component", "c").alias("component"))
    named = stored(named, "named")
    least = stored(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    of_class = lookup(named, least, "component").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = lookup(keyed, stored(of_class, "classes"), "key").select("vec_id", "n_links", "component_id")
    alone = all_rows.where(~F.coalesce(good, F.lit(False))).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_int8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP9_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= {THRESHOLD}),
r AS (SELECT a AS n, a AS m FROM p UNION SELECT p.b, r.m FROM r JOIN p ON p.a = r.n),
g AS (SELECT n, min(m) AS m FROM r GROUP BY n),
k AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(g.m, vec_id) AS component_id, vec_id = coalesce(g.m, vec_id) AS kept
FROM embeddings LEFT JOIN g ON g.n = vec_id LEFT JOIN k ON k.a = vec_id
"""
