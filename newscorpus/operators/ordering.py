"""Positions and running totals over ordered groups, without one task per group.

A plain ``row_number`` window sorts each group in one task. With a few dozen sections, of which
one may hold a third of all rows, that does not scale, so rows are range-sorted across the
cluster, numbered inside each sort partition, and shifted by what the earlier partitions of
their group hold. The only windows left run over one row per (group, partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newscorpus.session import shared_dir


def with_positions(
    df: DataFrame,
    groups: list[str],
    order: list[Column],
    position: str = "position",
    first: int = 1,
    running: dict[str, str] | None = None,
) -> DataFrame:
    """Add each row's place in its group, and for ``running`` {column: name} the sum before it.

    ``order`` must be total within a group. Pass only narrow columns: the rows are sorted and
    checkpointed, since sort ranges come from sampling and have to be read back unchanged by
    both the numbering and the totals.
    """
    running = running or {}
    shared_dir(df.sparkSession)
    placed = (
        df.orderBy(*[F.col(g) for g in groups], *order)
        .withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_seq", 33))
        .checkpoint()
    )
    # One key for the totals, the window and the join, never null though groups may be: what is
    # shuffled for the window meets the totals without moving again.
    at = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], F.col("_part").alias("part"))
    keyed = placed.withColumn("_at", at)
    spans = keyed.groupBy("_at").agg(
        F.min("_seq").alias("_start"),
        F.count("*").alias("_rows"),
        *[F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(f"_sum_{c}") for c in running],
    )
    earlier = (
        Window.partitionBy(*[F.col(f"_at.g{i}") for i in range(len(groups))])
        .orderBy("_at.part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = spans.select(
        F.col("_at").alias("_of"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_start")).alias("_shift"),
        *[
            F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}")
            for c in running
        ],
    )
    inside = Window.partitionBy("_at").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.withColumns(
        {
            f"_inside_{c}": F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(inside), F.lit(0))
            for c in running
        }
    )
    return summed.join(before, F.col("_at") == F.col("_of")).select(
        *df.columns,
        (F.col("_seq") + F.col("_shift") + F.lit(first)).cast("bigint").alias(position),
        *[
            (F.col(f"_inside_{c}") + F.col(f"_before_{c}")).cast("bigint").alias(name)
            for c, name in running.items()
        ],
    )
