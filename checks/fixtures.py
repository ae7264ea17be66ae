"""Inputs of the registered queries, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newscorpus import values
from newscorpus.functions import keys, markup
from newscorpus.operators import cleaning, compilation, discovery
from newscorpus.operators.ordering import with_positions
from newscorpus.plans import archive
from newscorpus.session import shared_dir
from newscorpus.sources.tables import read_pages, read_sections, spread_small

RUN_TS = "2026-06-19 08:30:00"
# Spanish pages stay without an entry, so the fallback for unknown sections is used.
SECTION_ROWS = [
    ("en", "English", "English", "/category/en/"),
    ("FR", "Français", "French", "/category/fr/"),
    ("de", "Deutsch", "German", "/category/misc/de/"),
]
# Junk that occurs in the given pages, so that the word list has something to drop.
WORDS = values.CLEAN_BLOCKLIST + ["###", "qui "]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_pages(spark, f"{sf_dir}/pages.parquet")
    return with_keys(df)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for queries that work through their HTML."""
    return with_keys(spread_small(read_pages(spark, f"{sf_dir}/pages.parquet")))


def with_keys(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "section_key", F.regexp_extract("url", "^[^/]+//[^/]+/([^/?#]+)", 1)
    ).withColumn("article_key", keys.article_key(F.col("url")))


def sections(spark: SparkSession) -> DataFrame:
    return read_sections(spark, SECTION_ROWS)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).withColumnRenamed("page_id", "page_no")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.extract_links(listings(spark, sf_dir), outer="li")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication and fetch time per page; every seventh page has no publication date."""
    return orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("page_id"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("published_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL '40' DAY")).alias("fetched_at"),
    )


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by article."""
    keyed = pages(spark, sf_dir).select("page_id", "section_key", "article_key")
    return keyed.join(dates(spark, sf_dir), "page_id").drop("page_id")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked links to two thirds of the pages; some are listed a second time further back."""
    some = pages(spark, sf_dir).where(F.col("page_id") % 3 != 0)
    found = some.select(
        "section_key",
        F.floor(F.col("page_id") / 25).cast("bigint").alias("page_no"),
        (F.col("page_id") % 25).alias("pos"),
        "url",
        "article_key",
    )
    again = found.where((F.col("page_no") * 25 + F.col("pos")) % 6 == 1).withColumn(
        "page_no", F.col("page_no") + 1000000000
    )
    return discovery.discovery_rank(found.unionByName(again))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_corpus(corpus(spark, sf_dir), words=WORDS)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article rows without bodies, dated after cleaning so that no HTML is shuffled."""
    shared_dir(spark)
    narrow = cleaned(spark, sf_dir).select(
        "page_id", "section_key", "article_key", "n_blocks", "n_bytes"
    )
    # Kept, since sorting reads its input twice and cleaning should run once.
    return narrow.checkpoint().join(dates(spark, sf_dir), "page_id")


def compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compilation.compile_monthly(articles(spark, sf_dir), page_links(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section per user; an ``error`` is a failed page, some sign-ups are empty listings."""
    log = events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("section_key"),
        "event_id",
        "ts",
        (F.col("event_type") != "error").alias("ok"),
        F.when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0), 0)
        .otherwise(1)
        .cast("bigint")
        .alias("n_links"),
    )
    return with_positions(
        log, ["section_key"], [F.col("ts"), F.col("event_id")], position="page_no"
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as attempts at one article per user; every 50th user's link has no URL."""
    return fetch_log(spark, sf_dir).select(
        (F.col("section_key").cast("bigint") % 14).cast("string").alias("section_key"),
        F.when(
            F.col("section_key").cast("bigint") % 50 != 0, F.concat(F.lit("/a/"), "section_key")
        )
        .otherwise("")
        .alias("url"),
        F.col("page_no").alias("attempt"),
        "ok",
    )


def page_day(df: DataFrame) -> DataFrame:
    """A date per page, computed from its number so that no page has to be joined."""
    day = F.expr("date_add(DATE '2020-01-01', CAST(page_id % 1500 AS INT))")
    return df.withColumn("day", F.date_format(day, "yyyy-MM-dd"))


def bylined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with author and date elements spliced in after the heading."""
    kind = F.col("page_id") % 4
    author = F.concat(
        F.lit('<span class="td-Author-line"><i>'),
        "section_key",
        F.lit("</i>"),
        F.repeat(F.lit("x"), (F.col("page_id") % 60).cast("int")),
        F.lit("</span>"),
    )
    timed = F.concat(F.lit("<time>"), "day", F.lit("</time>"))
    spelled = F.date_format(F.to_date("day"), "MMMM d, yyyy")
    classed = F.concat(
        F.lit('<div class="meta entry-date"><div></div><b> '), spelled, F.lit(" </b></div>")
    )
    extra = (
        F.when(kind == 0, F.lit(""))
        .when(kind == 1, F.concat(author, timed))
        .when(kind == 2, F.concat(classed, author))
        .otherwise(F.concat(classed, timed))
    )
    return page_day(corpus(spark, sf_dir)).withColumn(
        "html", F.replace(F.col("html"), F.lit("</h1>"), F.concat(F.lit("</h1>"), extra))
    )


def footered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page but each fifth carries its provenance as a footer line."""
    footer = F.format_string(
        '\n<p class="metadata_footer">Source: '
        "{'url': '%s', 'category': '%s', 'scraped_date': '%sT10:20:30'}</p>",
        F.col("url"),
        F.col("section_key"),
        F.col("day"),
    )
    return page_day(corpus(spark, sf_dir)).withColumn(
        "html",
        F.when(F.col("page_id") % 5 != 0, F.concat("html", footer)).otherwise(F.col("html")),
    )


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, one paragraph per line: lines repeat within many of them."""
    text = F.col("text")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "</p><p>")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return spread_small(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "lang", F.concat(F.lit("<p>"), text, F.lit("</p>")).alias("html")
    )


#: Elements that pages of plain divs do without.
BOXES = "article|nav|ul|li|footer"


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose article, menu and footer are plain divs."""
    return corpus(spark, sf_dir).withColumn("html", F.regexp_replace("html", rf"(?i)<(/?)(?:{BOXES})(?=[\s>])", "<$1div"))


def spanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose paragraphs have their first and last words in spans."""
    first = F.regexp_replace("html", r"(<p>)([^\s<&]+)(\s)", "$1<span>$2</span>$3")
    last = F.regexp_replace(first, r"(\s)([^\s<&]+)(</p>)", '$1<span class="w"><b>$2</b></span>$3')
    return corpus(spark, sf_dir).withColumn("html", last)


# What no parser reads: comments, a script, a style, all with look-alikes of what is searched for.
DECOY = (
    '<!-- <h1>old</h1><ul><li><a href="/old">o</a></li></ul><p>old > new</p> -->'
    "<script>var s = \"<li><a href='/js'>j</a></li><h1>js</h1><p>js</p>\";</script>"
    "<style>h1:after{content:'<h1>css</h1>'}</style>"
)


def decoyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages behind such decoys, with ">" in quoted attributes and a block inside the heading."""
    html = F.concat(F.lit(DECOY), F.col("html"))
    for plain, odd in (
        ("<p>", "<p data-x='1 > 0' class=it's>"),
        ("<li>", '<li data-q="a > b">'),
        ("<h1>", '<h1 title="x > y"><div>'),
        ("</h1>", "</div></h1>"),
    ):
        html = F.replace(html, F.lit(plain), F.lit(odd))
    return corpus(spark, sf_dir).withColumn("html", html)


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a date that only the attribute of its element tells."""
    timed = F.concat(F.lit('</h1><time title="a > b" datetime="'), "day", F.lit("T06:07:08\">દિવસ</time>"))
    return page_day(corpus(spark, sf_dir)).withColumn("html", F.replace(F.col("html"), F.lit("</h1>"), timed))


def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetch log with two attempts at each page; some failures are nulls."""
    return fetch_log(spark, sf_dir).select(
        "section_key",
        F.floor((F.col("page_no") + 1) / 2).cast("bigint").alias("page_no"),
        "event_id",
        F.when(F.col("ok") | (F.col("event_id") % 2 == 0), F.col("ok")).alias("ok"),
        "n_links",
    )


def archived(spark: SparkSession, sf_dir: str, out_dir: str) -> archive.Archive:
    """A run whose listings lead to two thirds of the pages; section keys come in both cases."""
    cased = F.when(F.col("page_id") % 2 == 1, F.upper("section_key")).otherwise(F.col("section_key"))
    some = pages(spark, sf_dir).where(F.col("page_id") % 3 != 0)
    link = F.struct("page_id", F.concat(F.lit('<h3><a href="'), markup.escape(F.col("url")), F.lit('">x</a></h3>')).alias("h"))
    listed = some.groupBy(
        F.when(F.col("page_id") % 40 < 20, F.upper("section_key")).otherwise(F.col("section_key")).alias("section_key"),
        F.floor(F.col("page_id") / 20).cast("bigint").alias("page_no"),
    ).agg(F.array_join(F.transform(F.sort_array(F.collect_list(link)), lambda x: x["h"]), "").alias("html"))
    return archive.run_archive(
        spark,
        listed,
        corpus(spark, sf_dir).withColumn("section_key", cased),
        fetches(spark, sf_dir),
        sections(spark),
        out_dir,
        RUN_TS,
        part_bytes=20000,
    )
