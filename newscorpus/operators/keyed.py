"""Reduce rows to one per key before anything is joined on that key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newscorpus.session import shared_dir


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row that comes first by ``order`` for each key, as an aggregate.

    Unlike a ranking window this combines on the map side, so a key that holds a third of all
    rows reaches its reducer as one row per map task.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = order + [c for c in rest if c not in order]
    return (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*ranked)).alias("_first"))
        .select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])
    )


def null_safe(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join in which a null key meets a null key; the columns of ``df``, then the others of ``other``."""
    own = {k: f"_key_{k}" for k in keys}
    same = [F.col(k).eqNullSafe(F.col(own[k])) for k in keys]
    return df.join(other.withColumnsRenamed(own), same, how).drop(*own.values())


# More repeated keys than this are joined by shuffle, not broadcast.
MAX_BROADCAST_KEYS = 100_000


def broadcast_if_few(df: DataFrame) -> DataFrame:
    """Mark rows of keys for broadcast if counting shows that they are few."""
    few = df.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
    return F.broadcast(df) if few else df


def one_copy(
    df: DataFrame, keys: list[str], row_id: str, ids: DataFrame | None = None
) -> DataFrame:
    """One row per key for wide rows: the one with the least ``row_id``, which must be unique.

    Only keys and ids are aggregated: those of ``ids``, where ``df`` is costly to make and they can
    be had from what it is made of. The repeated keys, usually few, are counted and broadcast
    when there are few, so that the wide rows do not move at all; when there are many, the rows
    are joined by shuffle.
    """
    shared_dir(df.sparkSession)
    repeated = (
        (df if ids is None else ids)
        .groupBy(*keys)
        .agg(F.min(row_id).alias("_keep"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
        .checkpoint()
    )
    return (
        df.join(broadcast_if_few(repeated), keys, "left")
        .where(F.col("_keep").isNull() | (F.col(row_id) == F.col("_keep")))
        .select(*df.columns)
    )
