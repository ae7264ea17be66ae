"""Section lookup, choice of sections, listing pages to visit, article keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newscorpus import values
from newscorpus.functions import keys


def normalize_section(
    df: DataFrame, sections: DataFrame, key_col: str = "section_key"
) -> DataFrame:
    """Add ``section_name`` and ``section_path``, with a derived pair for unknown keys.

    No broadcast is forced: the section table is a local relation of known size, which Spark
    broadcasts by itself below its threshold and joins by shuffle above it. Of sections equal but
    for case the one that sorts first counts.
    """
    lookup = sections.groupBy(F.lower("section_key").alias("_key")).agg(
        F.min(F.struct("section_key", "name_english", "path")).alias("_first")
    )
    lookup = lookup.select(
        "_key", F.col("_first.name_english").alias("_name"), F.col("_first.path").alias("_path")
    )
    return (
        df.join(lookup, F.lower(key_col) == F.col("_key"), "left")
        .withColumn("section_name", F.coalesce("_name", keys.capitalized(F.col(key_col))))
        .withColumn(
            "section_path",
            F.coalesce("_path", F.concat(F.lit("/category/"), F.lower(key_col), F.lit("/"))),
        )
        .drop("_key", "_name", "_path")
    )


def select_sections(sections: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The named sections in any case, or all of them."""
    if names is None:
        return sections
    return sections.where(F.lower("section_key").isin([n.lower() for n in names]))


def resolve_sections(sections: DataFrame, names: list[str]) -> DataFrame:
    """section_key, section_name, section_path of each named section, once, in any case; one that is
    not known gets a derived name and path instead of being left out."""
    rows = [(n,) for n in sorted({n.lower() for n in names})]
    wanted = sections.sparkSession.createDataFrame(rows, "section_key string")
    return normalize_section(wanted, sections)


def demo_section(sections: DataFrame) -> DataFrame:
    return select_sections(sections, [values.DEMO_SECTION])


def listing_frontier(
    sections: DataFrame, base_url: str = values.BASE_URL, max_pages: int = values.DEMO_MAX_PAGES
) -> DataFrame:
    """Listing URL of each (section, page); the first page is the section's own URL."""
    root = F.when(
        F.rlike("path", F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*://")), F.col("path")
    ).otherwise(F.concat(F.lit(base_url.rstrip("/")), F.col("path")))
    return sections.select(
        F.lower("section_key").alias("section_key"),
        root.alias("_root"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(max_pages).cast("bigint"))).alias(
            "page_no"
        ),
    ).select(
        "section_key",
        "page_no",
        F.when(F.col("page_no") == 1, F.col("_root"))
        .otherwise(F.concat("_root", F.lit("page/"), F.col("page_no").cast("string"), F.lit("/")))
        .alias("url"),
    )


def with_article_key(df: DataFrame, url: str = "url") -> DataFrame:
    """Add the join key and its short form."""
    return df.withColumn("article_key", keys.article_key(F.col(url))).withColumn(
        "short_key", keys.short_key(F.col(url))
    )


def key_collisions(
    df: DataFrame, url: str = "url", width: int = keys.SHORT_KEY_LENGTH
) -> DataFrame:
    """Distinct URLs of a section that share a short key, one row per URL.

    URLs are reduced to distinct ones first, so repeats of one URL cost nothing later.
    """
    urls = (
        df.where(F.col(url).isNotNull())
        .select("section_key", keys.short_key(F.col(url), width).alias("short_key"),
                F.col(url).alias("url"))
        .distinct()
    )
    shared = (
        urls.groupBy("section_key", "short_key")
        .agg(F.count("*").alias("n_urls"))
        .where("n_urls > 1")
    )
    return urls.join(shared, ["section_key", "short_key"])
