"""The ledger of finished sections, which makes runs resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completed_rows(counts: DataFrame, run_ts: str) -> DataFrame:
    """Ledger rows for sections that a run has finished, from (section_key, n_links)."""
    return counts.select(
        "section_key",
        F.lit(True).alias("completed"),
        F.col("n_links").cast("bigint").alias("n_links"),
        F.lit(run_ts).cast("timestamp_ntz").alias("updated_at"),
    )


def update_ledger(ledger: DataFrame, updates: DataFrame, tie_break: str | None = None) -> DataFrame:
    """Upsert: the latest row of each section, as a map-side combinable maximum."""
    rest = [c for c in ledger.columns if c not in ("section_key", "updated_at", tie_break)]
    order = ["updated_at"] + ([tie_break] if tie_break else []) + rest
    return (
        ledger.unionByName(updates)
        .groupBy("section_key")
        .agg(F.max(F.struct(*order)).alias("_last"))
        .select(*[F.col(c) if c == "section_key" else F.col(f"_last.{c}").alias(c) for c in ledger.columns])
    )


def resume_sections(
    sections: DataFrame, ledger: DataFrame, forced: list[str] | None = None
) -> DataFrame:
    """Sections not completed yet, and those named in ``forced`` whatever the ledger says."""
    key = F.lower("section_key")
    done = ledger.where("completed").select(F.lower("section_key").alias("_done")).distinct()
    again = key.isin([f.lower() for f in forced or []])
    return (
        sections.join(done, key == F.col("_done"), "left")
        .where(F.col("_done").isNull() | again)
        .drop("_done")
    )
