"""From page HTML to ordered text blocks and article records.

Blocks stay an array in the page's own row, so the whole pass is map-only and a page that was
fetched many times, or a section that holds a third of all pages, never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newscorpus import schemas, values
from newscorpus.functions import blocks, density, markup

BLOCKS = "blocks"


def needs_cleaning(df: DataFrame, html: str = "html", done: bool = False) -> DataFrame:
    """Rows that are not whole pages any more; with ``done`` the others."""
    whole = F.contains(F.lower(html), F.lit("<html"))
    return df.where(whole if done else ~whole)


def main_content(
    df: DataFrame, html: str = "html", out: str = "content", drop_tags: list[str] | None = None
) -> DataFrame:
    """Boilerplate out: comments and furniture elements dropped, the article element kept."""
    return df.withColumn(
        out, markup.article_or_all(markup.drop_elements(F.col(html), drop_tags))
    )


def decode_entities(df: DataFrame, *columns: str) -> DataFrame:
    """Decode entities once. Only texts with an uncommon entity are sent to Python."""
    for c in columns:
        odd = F.when(F.rlike(c, F.lit(markup.UNCOMMON_ENTITY)), F.col(c))
        df = (
            df.withColumn("_odd", odd)
            .withColumn("_odd", markup.decode_any("_odd"))
            .withColumn(
                c, F.coalesce(markup.join_nbsp(F.col("_odd")), markup.decode_common(F.col(c)))
            )
            .drop("_odd")
        )
    return df


def mark_blocks(df: DataFrame, content: str, tags: list[str]) -> DataFrame:
    """Replace ``content`` by ``_marked``: its text with block boundaries, decoded."""
    df = df.withColumn("_marked", markup.mark_blocks(F.col(content), tags))
    return decode_entities(df, "_marked")


def split_blocks(
    df: DataFrame,
    content: str = "content",
    tags: list[str] | None = None,
    loose_text: bool = True,
) -> DataFrame:
    """Add ``blocks``: array of (pos, tag, text) in page order, blank blocks included.

    A block ends at the next block-level open or close tag, so nested blocks do not repeat text.
    ``loose_text`` keeps what stands outside the block elements, under the tag ``''``.
    """
    tags = values.CLEAN_TAGS if tags is None else tags
    found = blocks.cut(markup.collapse(F.col("_marked")), tags)
    return (
        mark_blocks(df, content, tags)
        .withColumn(BLOCKS, found if loose_text else blocks.tagged_only(found))
        .drop("_marked")
    )


def explode_blocks(df: DataFrame, *keep: str) -> DataFrame:
    """One row per block.

    The outer form, since for the other one the optimizer adds a filter on the array's size and
    pushes it to the scan: everything that makes the array would be computed twice.
    """
    return df.select(*keep, F.inline_outer(BLOCKS)).where(F.col("pos").isNotNull())


def drop_empty_blocks(df: DataFrame) -> DataFrame:
    return df.withColumn(BLOCKS, blocks.nonempty(F.col(BLOCKS)))


def drop_blocklisted(
    df: DataFrame, words: list[str] | None = None, mode: str = "contains"
) -> DataFrame:
    """Drop blocks holding (``contains``) or being (``equals``) a listed word."""
    words = values.CLEAN_BLOCKLIST if words is None else words
    return df.withColumn(BLOCKS, blocks.unlisted(F.col(BLOCKS), words, mode))


def dedup_blocks(df: DataFrame) -> DataFrame:
    """Keep the first block of each text within a page."""
    return df.withColumn(BLOCKS, blocks.first_copies(F.col(BLOCKS)))


def tag_blocks(df: DataFrame, headings: list[str] | None = None) -> DataFrame:
    """Headings of any level become ``h2``, everything else ``p``."""
    headings = values.CLEAN_HEADINGS if headings is None else headings
    return df.withColumn(BLOCKS, blocks.simplified(F.col(BLOCKS), headings))


def assemble_articles(df: DataFrame, escape: bool = False) -> DataFrame:
    """Add ``body``, one tagged line per block, and its block and byte counts."""
    return (
        df.withColumn("n_blocks", F.size(BLOCKS).cast("bigint"))
        .withColumn("body", blocks.joined(F.col(BLOCKS), escape))
        .withColumn("n_bytes", F.octet_length("body").cast("bigint"))
    )


def cleaning_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split cleaned pages into (articles, rejects with a reason)."""
    kept = df.where(F.col("n_blocks") > 0)
    rejects = df.where(F.coalesce(F.col("n_blocks"), F.lit(0)) <= 0).withColumn(
        "reason",
        F.when(F.col("n_blocks").isNull(), F.lit("no content"))
        .when(F.col("n_raw") == 0, F.lit("no text"))
        .otherwise(F.lit("only unwanted blocks")),
    )
    return kept, rejects


def attach_provenance(df: DataFrame, url: str, section: str, fetched_at: str) -> DataFrame:
    """Carry where and when a page was found in a column, not inside its markup."""
    return df.withColumn(
        "source",
        F.struct(
            F.col(url).alias("url"),
            F.lower(section).alias("category"),
            F.col(fetched_at).cast("timestamp_ntz").alias("scraped_date"),
        ),
    )


def parse_provenance(df: DataFrame, html: str = "html") -> DataFrame:
    """Read it back from pages that carry it as a footer line; null when they do not."""
    footer = rf'<p class="{values.FOOTER_CLASS}">Source:\s*(.*?)</p>'
    payload = F.regexp_extract(html, footer, 1)
    return df.withColumn(
        "source", F.from_json(F.when(payload != "", payload), schemas.SOURCE)
    )


def clean_corpus(
    df: DataFrame,
    html: str = "html",
    words: list[str] | None = None,
    mode: str = "contains",
    content: str = "tags",
) -> DataFrame:
    """Pages to articles in one map-only pass; the HTML column is left behind.

    The content is what the article element holds, else the whole page without its furniture
    (``tags``), or of that the run of blocks with the densest text (``density``).

    ``n_raw`` counts blocks with text, ``n_unwanted`` those dropped by the word list,
    ``n_repeated`` later copies of a text, ``n_blocks`` what the body holds.
    """
    words = values.CLEAN_BLOCKLIST if words is None else words
    if content not in ("tags", "density"):
        raise ValueError(f"unknown content {content!r}")
    dense = content == "density"
    if dense:
        df = df.withColumn("_content", density.mark_links(markup.article_or_all(markup.drop_elements(F.col(html)))))
        df = mark_blocks(df, "_content", values.CLEAN_TAGS)
    else:
        df = mark_blocks(main_content(df, html, "_content"), "_content", values.CLEAN_TAGS)

    def cleaned(kept: Column) -> Column:
        return blocks.simplified(blocks.first_copies(kept), values.CLEAN_HEADINGS)

    def record(raw: Column) -> Column:
        return markup.let(
            blocks.unlisted(raw, words, mode),
            lambda kept: F.struct(
                F.size(raw).cast("bigint").alias("n_raw"),
                (F.size(raw) - F.size(kept)).cast("bigint").alias("n_unwanted"),
                F.size(kept).cast("bigint").alias("_n_kept"),
                cleaned(kept).alias(BLOCKS),
            ),
        )

    marked = markup.collapse(F.col("_marked"))
    if dense:
        scored = density.scored(density.balance_links(marked), values.CLEAN_TAGS)
        cut = density.densest(scored, values.CLEAN_HEADINGS)
    else:
        cut = blocks.cut(marked, values.CLEAN_TAGS)
    # A generator, since later filters on these columns do not pass one. They would pass a
    # projection, taking along a copy of the whole expression to be computed twice.
    df = df.select(
        *[c for c in df.columns if c not in (html, "_content", "_marked")],
        F.inline_outer(F.array(markup.let(blocks.nonempty(cut), record))),
    )
    return (
        assemble_articles(df)
        .withColumn("n_repeated", F.col("_n_kept") - F.col("n_blocks"))
        .drop(BLOCKS, "_n_kept")
    )
