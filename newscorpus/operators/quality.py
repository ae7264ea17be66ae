"""What to look for in cleaned text, as measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newscorpus import values
from newscorpus.functions.blocks import listed


def script_share(df: DataFrame, text: str = "body", script: str = "Gujarati") -> DataFrame:
    """Characters in the expected script, their share, and replacement characters."""
    in_script = F.length(F.regexp_replace(text, rf"\P{{Is{script}}}+", ""))
    replaced = F.length(text) - F.length(F.replace(F.col(text), F.lit("�"), F.lit("")))
    return (
        df.withColumn("n_chars", F.length(text).cast("bigint"))
        .withColumn("n_script", in_script.cast("bigint"))
        .withColumn("n_replacement", replaced.cast("bigint"))
        .withColumn(
            "share",
            F.when(F.col("n_chars") > 0, F.col("n_script").cast("double") / F.col("n_chars")),
        )
    )


def repeat_tokens(df: DataFrame, text: str = "body") -> DataFrame:
    """Runs of ampersands, the usual trace of badly decoded text."""
    return df.withColumn("n_runs", F.regexp_count(text, F.lit("(?:& ?){2,}")).cast("bigint"))


def residual_markup(
    df: DataFrame, text: str = "body", words: list[str] | None = None
) -> DataFrame:
    """Tags left in text, and whether an unwanted word is."""
    words = values.CLEAN_BLOCKLIST if words is None else words
    return df.withColumn(
        "n_tags", F.regexp_count(text, F.lit("<[a-zA-Z/][^>]*>")).cast("bigint")
    ).withColumn("has_listed", listed(F.col(text), words))


def corpus_report(articles: DataFrame) -> DataFrame:
    """Per section: articles, rejects, and what became of their blocks. Takes ``clean_corpus``."""

    def total(column: str, name: str):
        return F.sum(column).cast("bigint").alias(name)

    return articles.groupBy("section_key").agg(
        F.count_if(F.col("n_blocks") > 0).alias("n_articles"),
        F.count_if(F.col("n_blocks") == 0).alias("n_rejects"),
        total("n_raw", "blocks_seen"),
        total("n_blocks", "blocks_kept"),
        total("n_unwanted", "blocks_unwanted"),
        total("n_repeated", "blocks_repeated"),
    )
