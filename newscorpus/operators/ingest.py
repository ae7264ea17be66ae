"""Work lists and outcomes of ingest. Fetching itself is someone else's job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newscorpus import values
from newscorpus.functions import keys
from newscorpus.operators.cleaning import parse_provenance
from newscorpus.operators.keyed import broadcast_if_few, first_per_key

KEY = ["section_key", "article_key"]


def _keyed(links: DataFrame) -> DataFrame:
    return links.where(F.coalesce("url", F.lit("")) != "").withColumn(
        "article_key", keys.article_key(F.col("url"))
    )


def pending_articles(links: DataFrame, cached: DataFrame) -> DataFrame:
    """Links whose article is not stored yet, one row per (section, article).

    Both sides are reduced to one row per key first; the join then reuses that partitioning.
    """
    order = [c for c in ("page_no", "pos", "rank") if c in links.columns]
    todo = first_per_key(_keyed(links), KEY, order + ["url"])
    return todo.join(cached.select(*KEY).distinct(), KEY, "left_anti")


def unchanged_rerun(links: DataFrame, cached: DataFrame) -> DataFrame:
    """Per section, how many links are stored already and how many are still to do."""
    wanted = _keyed(links).groupBy(*KEY).agg(F.count("*").alias("n"))
    stored = cached.select(*KEY).distinct().withColumn("stored", F.lit(True))
    done = F.col("stored").isNotNull()
    return (
        wanted.join(stored, KEY, "left")
        .groupBy("section_key")
        .agg(
            F.sum(F.when(done, F.col("n")).otherwise(0)).cast("bigint").alias("n_cached"),
            F.sum(F.when(done, 0).otherwise(F.col("n"))).cast("bigint").alias("n_todo"),
        )
    )


def fetch_outcomes(
    attempts: DataFrame,
    max_retries: int = values.MAX_RETRIES,
    delay: float = values.RETRY_DELAY_SECONDS,
    backoff: float = values.RETRY_BACKOFF,
) -> DataFrame:
    """What became of each link: success within ``1 + max_retries`` attempts, retries, waiting.

    ``attempts`` holds one row per (section, url, attempt from 1, ok). After the k-th failure a
    fetcher waits ``delay * backoff^(k-1)`` seconds as long as a retry is left. An attempt
    number that is null stands for a link that was never tried.
    """
    first_ok = F.min(F.when(F.col("ok"), F.col("attempt")))
    made = F.least(F.coalesce(F.max("attempt"), F.lit(0)), F.lit(max_retries + 1))
    failures = F.when(F.col("_ok").isNotNull(), F.col("_ok") - 1).otherwise(F.col("_made"))
    waits = F.least(failures, F.lit(max_retries))
    seconds = (
        waits * F.lit(delay)
        if backoff == 1
        else F.lit(delay) * (F.pow(F.lit(backoff), waits) - 1) / F.lit(backoff - 1)
    )
    return (
        attempts.where(F.col("attempt").isNull() | (F.col("attempt") <= max_retries + 1))
        .groupBy("section_key", "url")
        .agg(first_ok.alias("_ok"), made.alias("_made"))
        .select(
            "section_key",
            "url",
            F.col("_ok").isNotNull().alias("success"),
            F.greatest(F.coalesce("_ok", "_made") - 1, F.lit(0)).cast("bigint").alias("n_retries"),
            seconds.cast("double").alias("wait_seconds"),
        )
    )


def fetch_summary(outcomes: DataFrame) -> DataFrame:
    """Successes and links per section and in all. Links without URL count, but cannot succeed."""
    fetched = F.col("success") & (F.coalesce("url", F.lit("")) != "")
    per_section = outcomes.groupBy("section_key").agg(
        F.count_if(fetched).alias("ok"), F.count("*").alias("n")
    )
    return per_section.rollup("section_key").agg(
        F.sum("ok").cast("bigint").alias("n_success"),
        F.sum("n").cast("bigint").alias("n_total"),
        F.grouping_id().cast("bigint").alias("level"),
    )


def attach_url(files: DataFrame, links: DataFrame, default: str = values.BASE_URL) -> DataFrame:
    """URL of each stored article by key, or the default when no link is known."""
    known = first_per_key(_keyed(links).select(*KEY, "url"), KEY, ["url"])
    return files.join(known, KEY, "left").withColumn("url", F.coalesce("url", F.lit(default)))


def identify_pages(files: DataFrame, links: DataFrame, html: str = "html") -> DataFrame:
    """Stored files (section_key, short_key, html) as pages: with url, article_key, n_urls.

    The URL is the one the file's own footer names, if its digest agrees with the file's name, else
    the only one of the section's links that does. Where several links share the short key and no
    footer tells, ``n_urls`` counts them, and url and article_key are null; so they are for a file
    that nothing names (``n_urls`` 0).
    """
    width = F.length("short_key")
    widths = [r[0] for r in files.select(width).where(width.between(1, 32)).distinct().collect()]
    named = links.where(F.coalesce("url", F.lit("")) != "").select(
        F.lower("section_key").alias("_section"), F.col("url").alias("_url"), keys.article_key(F.col("url")).alias("_digest")
    )
    named = named.distinct().select(
        "_section", "_url", F.explode(F.transform(F.array(*[F.lit(w) for w in widths] or [F.lit(8)]), lambda w: F.substr("_digest", F.lit(1), w))).alias("_short")
    )
    known = named.groupBy("_section", "_short").agg(F.min("_url").alias("_url"), F.count("*").alias("_n"))
    own = F.col("source.url")
    agrees = F.startswith(keys.article_key(own), F.col("short_key"))
    found = parse_provenance(files, html).withColumn("_own", F.when(agrees, own)).drop("source")
    same = (F.lower("section_key") == F.col("_section")) & (F.col("short_key") == F.col("_short"))
    url = F.coalesce("_own", F.when(F.col("_n") == 1, F.col("_url")))
    return found.join(broadcast_if_few(known), same, "left").select(
        *files.columns,
        url.alias("url"),
        keys.article_key(url).alias("article_key"),
        F.when(F.col("_own").isNotNull(), 1).otherwise(F.coalesce("_n", F.lit(0))).cast("bigint").alias("n_urls"),
    )
