"""Links of listing pages: extraction, first sighting, rank, and where a crawl stops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newscorpus import values
from newscorpus.functions import markup
from newscorpus.operators.cleaning import decode_entities
from newscorpus.operators.keyed import first_per_key
from newscorpus.operators.ordering import with_positions


def visible_markup(df: DataFrame, html: str = "html") -> DataFrame:
    """Comments, scripts and styles out, as a parser leaves them out of the tree."""
    return df.withColumn(html, markup.visible(F.col(html)))


def strip_chrome(
    df: DataFrame,
    html: str = "html",
    classes: list[str] | None = None,
    exact: bool = True,
    raw: bool = True,
) -> DataFrame:
    """Remove every element of the given classes with all it encloses.

    ``raw`` pages, here and below, lose comments, scripts and styles first; pass False for markup
    that has been through ``visible_markup``.
    """
    classes = values.CHROME_CLASSES if classes is None else classes
    df = visible_markup(df, html) if raw else df
    # Pages without any such class are not split at all: their arrays stay null.
    named = F.rlike(html, F.lit("(?i)" + markup.class_pattern(classes, exact)))
    found = df.withColumn(
        "_pieces", F.when(named, markup.split_at_tags(F.col(html)))
    ).withColumn("_ranges", markup.container_ranges(F.col("_pieces"), classes, exact))
    return found.withColumn(
        html,
        F.when(
            F.size("_ranges") > 0, markup.outside_ranges(F.col("_pieces"), F.col("_ranges"))
        ).otherwise(F.col(html)),
    ).drop("_pieces", "_ranges")


def scope_container(
    df: DataFrame,
    html: str = "html",
    classes: list[str] | None = None,
    exact: bool = True,
    fallback: bool = True,
    raw: bool = True,
) -> DataFrame:
    """Narrow to the inside of the first element of a class; the whole page, or null, without one."""
    classes = values.LISTING_CLASSES if classes is None else classes
    df = visible_markup(df, html) if raw else df
    name, rest = markup.first_of_class(F.col(html), classes, exact)
    found = df.withColumn("_name", name).withColumn(
        "_rest", F.when(F.col("_name") != "", rest)
    )
    inner = markup.until_closed(F.col("_name"), F.col("_rest"))
    return found.withColumn(
        html, F.coalesce(inner, F.col(html)) if fallback else inner
    ).drop("_name", "_rest")


def extract_links(df: DataFrame, html: str = "html", outer: str = "h3", raw: bool = True) -> DataFrame:
    """First anchor of every ``outer`` element: section, page, place on the page, URL, title.

    Elements without an anchor, or whose anchor has no target, give no row.
    """
    df = visible_markup(df, html) if raw else df
    pieces = F.slice(
        F.split(F.col(html), rf"(?i)<{outer}(?=[\s>])"), 2, 2147483647
    )
    anchor = rf"(?is)<a(\s{markup.ATTRS})?>(.*?)(?:</a|\z)"
    inner = F.regexp_extract("_piece", rf"(?is)^{markup.ATTRS}>(.*?)(?:</{outer}|\z)", 1)
    links = (
        df.select("section_key", "page_no", F.posexplode_outer(pieces).alias("pos", "_piece"))
        .where(F.col("pos").isNotNull())
        .withColumn("_inner", inner)
        .select(
            "section_key",
            "page_no",
            F.col("pos").cast("bigint").alias("pos"),
            markup.attribute(F.regexp_extract("_inner", anchor, 1), "href").alias("url"),
            markup.strip_tags(F.regexp_extract("_inner", anchor, 2)).alias("title"),
        )
        .where("url <> ''")
    )
    return decode_entities(links, "url", "title").withColumn(
        "title", markup.tidy(F.col("title"))
    )


def dedup_links(df: DataFrame) -> DataFrame:
    """First sighting of each URL in a section; URLs are compared exactly."""
    return first_per_key(df, ["section_key", "url"], ["page_no", "pos"])


def discovery_rank(df: DataFrame) -> DataFrame:
    """0-based place of each link in its section's list."""
    return with_positions(
        df,
        ["section_key"],
        [F.col("page_no"), F.col("pos"), F.col("url")],
        position="rank",
        first=0,
    )


def discovery_counts(df: DataFrame) -> DataFrame:
    """Links per listing page, per section and in all; null marks a total."""
    pages = df.groupBy("section_key", "page_no").agg(F.count("*").alias("n"))
    return pages.rollup("section_key", "page_no").agg(
        F.sum("n").cast("bigint").alias("n_links"),
        F.grouping_id().cast("bigint").alias("level"),
    )


def stamp_run(df: DataFrame, run_ts: str, column: str = "discovered_at") -> DataFrame:
    """Stamp the run's time and lower-case the section."""
    return df.withColumn(column, F.lit(run_ts).cast("timestamp_ntz")).withColumn(
        "section_key", F.lower("section_key")
    )


def listing_stops(
    log: DataFrame, max_errors: int = values.MAX_CONSECUTIVE_ERRORS
) -> DataFrame:
    """First stopping page of each section and why: too many failures in a row, or no links.

    A page may have several rows, one per attempt: it is ok if any of them is, and a null is a
    failure. A page is the one failure too many when it and the ``max_errors`` pages before it all
    failed. Every failure therefore votes for itself and the pages after it, and votes are
    counted per page: no window runs over a section's whole log.
    """
    own = F.struct(F.col("page_no").alias("at"), F.lit(0).alias("failed"), F.lit(1).alias("empty"))
    votes = F.transform(
        F.sequence("page_no", F.col("page_no") + max_errors),
        lambda at: F.struct(at.alias("at"), F.lit(1).alias("failed"), F.lit(0).alias("empty")),
    )
    tried = log.groupBy("section_key", "page_no").agg(
        F.max(F.coalesce("ok", F.lit(False))).alias("ok"),
        F.max(F.when(F.col("ok"), F.col("n_links"))).alias("n_links"),
    )
    return (
        tried.where(~F.col("ok") | (F.col("n_links") == 0))
        .select("section_key", F.inline(F.when(F.col("ok"), F.array(own)).otherwise(votes)))
        .groupBy("section_key", "at")
        .agg(F.sum("failed").alias("failed"), F.max("empty").alias("empty"))
        .where((F.col("failed") > max_errors) | (F.col("empty") == 1))
        .groupBy("section_key")
        .agg(
            F.min(
                F.struct(
                    F.col("at"),
                    F.when(F.col("empty") == 1, F.lit("no links"))
                    .otherwise(F.lit("errors"))
                    .alias("reason"),
                )
            ).alias("_stop")
        )
        .select("section_key", F.col("_stop.at").alias("stop_page"), F.col("_stop.reason").alias("stop_reason"))
    )


def listing_stop(
    log: DataFrame,
    max_errors: int = values.MAX_CONSECUTIVE_ERRORS,
    max_pages: int | None = None,
) -> DataFrame:
    """Pages of the log that a crawl gets to use: those before the stop, and within the cap."""
    kept = log.join(listing_stops(log, max_errors), "section_key", "left").where(
        F.col("stop_page").isNull() | (F.col("page_no") < F.col("stop_page"))
    )
    return kept if max_pages is None else kept.where(F.col("page_no") <= max_pages)
