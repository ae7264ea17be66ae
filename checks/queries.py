"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from newscorpus.functions import keys, markup
from newscorpus.operators import (
    articles,
    cleaning,
    compilation,
    discovery,
    extraction,
    ingest,
    ledger,
    quality,
    sections,
    statistics,
    wordlists,
)
from newscorpus.plans import archive
from newscorpus.session import work_path
from newscorpus.sources import progress, tables, tree
from newscorpus.streaming import jobs

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# Sources and sinks


@query
def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.pages(spark, sf_dir)
    return df.select("page_id", "url", "section_key", F.length("html").cast("bigint").alias("n_chars"))


@query
def read_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages stored as HTML files; those of two sections read back, by their folders."""
    path = work_path(spark, "tree")
    files = fx.pages(spark, sf_dir).select("section_key", keys.article_key(F.col("url")).alias("short_key"), "html")
    tree.write_tree(files, path)
    found = tree.read_tree(spark, path).where(F.col("section_key").isin("en", "de"))
    return found.select("section_key", "short_key", F.md5(F.col("html").cast("binary")).alias("digest"))


@query
def read_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = fx.pages(spark, sf_dir).groupBy(F.col("section_key").alias("page_section")).agg(
        F.count("*").alias("n_pages")
    )
    known = fx.sections(spark)
    same = F.lower(known["section_key"]) == keyed["page_section"]
    return known.join(keyed, same, "left").drop("page_section")


@query
def write_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "corpus")
    tables.write_corpus(fx.cleaned(spark, sf_dir), path)
    stored = tables.read_corpus(spark, path)
    return stored.select("section_key", "article_key", "url", "n_blocks", "n_bytes")


@query
def write_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "manifest")
    manifest = compilation.archive_manifest(fx.compiled(spark, sf_dir), fx.sections(spark))
    tables.write_manifest(manifest, path)
    schema = (
        "section_key string, month string, level bigint, file_name string, n_articles bigint, "
        "n_bytes bigint, size_mib double, first_date timestamp_ntz, last_date timestamp_ntz"
    )
    return spark.read.schema(schema).option("header", True).csv(path)


@query
def read_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One progress document per page, in one of four shapes, made from the page's own links."""
    per_page = fx.listings(spark, sf_dir).select(
        F.col("page_no").alias("page_id"),
        "section_key",
        F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)"'), F.lit(1)).alias("urls"),
    )
    as_links = F.to_json(
        F.transform("urls", lambda u: F.struct(u.alias("url"), F.upper(u).alias("title")))
    )
    as_urls = F.to_json("urls")
    as_object = F.concat(
        F.lit("{"),
        F.array_join(
            F.transform(F.array_distinct("urls"), lambda u: F.concat(F.lit('"'), u, F.lit('": {"seen": 1}'))),
            ", ",
        ),
        F.lit("}"),
    )
    kind = F.col("page_id") % 4
    listed = F.when(kind == 0, as_links).when(kind == 1, as_urls).otherwise(as_object)
    nested = F.format_string('{"discovered_urls": {"%s": %s}}', F.col("section_key"), listed)
    top = F.format_string('{"%s": %s, "last_updated": "x"}', F.col("section_key"), listed)
    docs = per_page.select("page_id", F.when(kind == 3, top).otherwise(nested).alias("doc"))
    return progress.progress_links(docs, "doc", "page_id").drop("discovered_at")


@query
def progress_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of orders, some cut off, some lists, some blank."""
    whole = F.format_string('{"c%s_completed": true, "c%s_count": %s}', "o_custkey", "o_custkey", "o_orderkey")
    kind = F.col("o_orderkey") % 10
    doc = (
        F.when(kind == 1, F.left(whole, F.length(whole) - 9))
        .when(kind == 2, F.concat(F.lit("["), whole, F.lit("]")))
        .when(kind == 3, F.lit(" "))
        .when(kind != 4, whole)
    )
    docs = fx.orders(spark, sf_dir).select("o_orderkey", doc.alias("doc"))
    return progress.progress_rejects(docs, "doc", "o_orderkey").select("o_orderkey", "reason")


@query
def read_progress_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.format_string(
        '{"c%s_completed": %s, "c%s_count": %s, "last_updated": "%s"}',
        F.col("o_custkey"),
        F.when(F.col("o_orderstatus") == "F", "true").otherwise("false"),
        F.col("o_custkey"),
        F.col("o_orderkey"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
    )
    docs = fx.orders(spark, sf_dir).select("o_orderkey", doc.alias("doc"))
    return progress.progress_ledger(docs, "doc", "o_orderkey")


# Sections and crawl frontier


@query
def normalize_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("page_id") % 2 == 1
    df = fx.pages(spark, sf_dir).select(
        "page_id",
        F.when(odd, F.upper("section_key")).otherwise(F.col("section_key")).alias("section_key"),
    )
    return sections.normalize_section(df, fx.sections(spark))


@query
def select_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.pages(spark, sf_dir).select("page_id", "section_key")
    return sections.select_sections(df, ["EN", "de"])


@query
def resolve_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known sections and the pages' own, which the dimension does not know."""
    seen = fx.pages(spark, sf_dir).select(F.upper("section_key").alias("key")).distinct()
    names = [r[0] for r in seen.collect()]  # one per language of the pages
    return sections.resolve_sections(fx.sections(spark), [*names, "WORLD", "Factcheck"])


@query
def listing_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = fx.pages(spark, sf_dir).select("section_key").distinct()
    known = sections.normalize_section(seen, fx.sections(spark)).select(
        "section_key", F.col("section_path").alias("path")
    )
    return sections.listing_frontier(known, max_pages=5)


@query
def article_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.pages(spark, sf_dir).select("page_id", "url")
    return sections.with_article_key(df)


@query
def key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.key_collisions(fx.pages(spark, sf_dir))


@query
def key_collisions_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a key so short that collisions occur in small tables."""
    return sections.key_collisions(fx.pages(spark, sf_dir), width=3)


# Link discovery


@query
def strip_chrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.corpus(spark, sf_dir).select("page_id", "html")
    return discovery.strip_chrome(df, classes=["ad"])


@query
def scope_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.corpus(spark, sf_dir).select("page_id", "html")
    return discovery.scope_container(df, classes=["ad"])


@query
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.links(spark, sf_dir)


@query
def dedup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.dedup_links(fx.links(spark, sf_dir))


@query
def discovery_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.discovery_rank(discovery.dedup_links(fx.links(spark, sf_dir)))


@query
def listing_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = discovery.listing_stop(fx.fetch_log(spark, sf_dir), max_pages=60)
    return kept.select("section_key", "page_no", "event_id", "ok", "stop_page", "stop_reason")


@query
def listing_stop_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = discovery.listing_stop(fx.fetch_log(spark, sf_dir))
    return kept.select("section_key", "page_no", "event_id", "stop_page", "stop_reason")


@query
def listing_stop_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.listing_stops(fx.attempt_log(spark, sf_dir))


@query
def extract_links_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.decoyed(spark, sf_dir).withColumnRenamed("page_id", "page_no")
    return discovery.extract_links(discovery.strip_chrome(df), outer="li", raw=False)


@query
def discovery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.discovery_counts(discovery.dedup_links(fx.links(spark, sf_dir)))


@query
def stamp_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.pages(spark, sf_dir).select("page_id", F.upper("section_key").alias("section_key"))
    return discovery.stamp_run(df, fx.RUN_TS)


# Incremental ingest


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.pages(spark, sf_dir).where("page_id % 2 = 0").select("section_key", "article_key")


@query
def pending_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.pending_articles(
        fx.page_links(spark, sf_dir).drop("article_key"), cached(spark, sf_dir)
    )


@query
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.fetch_outcomes(fx.attempts(spark, sf_dir))


@query
def fetch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.fetch_summary(ingest.fetch_outcomes(fx.attempts(spark, sf_dir)))


@query
def attach_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.page_day(fx.pages(spark, sf_dir)).select("page_id", "url", "section_key", "day")
    with_source = cleaning.attach_provenance(df, "url", "section_key", "day")
    return with_source.select("page_id", "source.*")


@query
def parse_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.footered(spark, sf_dir).select("page_id", "html")
    return cleaning.parse_provenance(df).select("page_id", "source.*")


@query
def attach_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fx.pages(spark, sf_dir).select("page_id", "section_key", "article_key")
    return ingest.attach_url(files, fx.page_links(spark, sf_dir).drop("article_key"))


@query
def unchanged_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.unchanged_rerun(
        fx.page_links(spark, sf_dir).drop("article_key"), cached(spark, sf_dir)
    )


# Cleaning


@query
def needs_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other page stands for one that has been cleaned before."""
    df = cleaning.main_content(fx.corpus(spark, sf_dir)).select(
        "page_id",
        F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.col("content")).alias("html"),
    )
    return cleaning.needs_cleaning(df)


@query
def main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.main_content(fx.corpus(spark, sf_dir)).select("page_id", "content")


@query
def score_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, link text, sentence marks and worth of every block."""
    return cleaning.explode_blocks(extraction.score_blocks(fx.corpus(spark, sf_dir)), "page_id")


@query
def main_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The densest run of pages whose article, menu and footer are plain divs."""
    runs = extraction.main_run(fx.boxed(spark, sf_dir))
    return runs.select(
        "page_id",
        "run_score",
        F.size("blocks").cast("bigint").alias("n_blocks"),
        F.try_element_at("blocks", F.lit(1))["pos"].alias("first_pos"),
        F.md5(F.array_join(F.transform("blocks", lambda b: F.concat_ws(":", b["tag"], b["text"])), "\n").cast("binary")).alias("digest"),
    )


@query
def extraction_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per section, blocks of the article element against those that density finds without it."""
    runs = cleaning.explode_blocks(extraction.main_run(fx.boxed(spark, sf_dir)), "page_id", "section_key")
    marked = split(spark, sf_dir)
    marked = cleaning.explode_blocks(cleaning.drop_empty_blocks(marked), "page_id", "section_key")
    sides = runs.select("page_id", "section_key", "text", F.lit(1).alias("run"), F.lit(0).alias("tags")).unionAll(
        marked.select("page_id", "section_key", "text", F.lit(0), F.lit(1))
    )
    each = sides.groupBy("section_key", "page_id", "text").agg(F.max("run").alias("run"), F.max("tags").alias("tags"))
    return each.groupBy("section_key").agg(
        F.sum("run").cast("bigint").alias("n_run"),
        F.sum("tags").cast("bigint").alias("n_tags"),
        F.sum(F.col("run") * F.col("tags")).cast("bigint").alias("n_both"),
    )


@query
def decode_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.corpus(spark, sf_dir).select("page_id", "html")
    return cleaning.decode_entities(df, "html")


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.split_blocks(cleaning.main_content(fx.corpus(spark, sf_dir)))


@query
def explode_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.explode_blocks(split(spark, sf_dir), "page_id")


@query
def drop_empty_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.explode_blocks(cleaning.drop_empty_blocks(split(spark, sf_dir)), "page_id")


@query
def drop_blocklisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaning.drop_empty_blocks(split(spark, sf_dir))
    return cleaning.explode_blocks(cleaning.drop_blocklisted(df, fx.WORDS), "page_id")


@query
def drop_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that hold none of the long words that only one document has."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = documents.select("doc_id", F.explode_outer(F.split("text", r"[ \n]+")).alias("word"))
    ids = F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    rare = words.where(F.length("word") >= 10).groupBy("word").agg(*ids).where("least = most")
    pages = cleaning.drop_empty_blocks(split(spark, sf_dir)).select("page_id", "blocks")
    return cleaning.explode_blocks(wordlists.drop_listed(pages, rare), "page_id")


@query
def dedup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaning.drop_empty_blocks(split(spark, sf_dir))
    return cleaning.explode_blocks(cleaning.dedup_blocks(df), "page_id")


@query
def dedup_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaning.split_blocks(fx.document_pages(spark, sf_dir), "html")
    df = cleaning.dedup_blocks(cleaning.drop_empty_blocks(df))
    return cleaning.explode_blocks(df, "doc_id")


@query
def tag_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaning.tag_blocks(cleaning.drop_empty_blocks(split(spark, sf_dir)))
    return cleaning.explode_blocks(df, "page_id")


@query
def assemble_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaning.tag_blocks(cleaning.drop_empty_blocks(split(spark, sf_dir)))
    return cleaning.assemble_articles(df).select("page_id", "body", "n_blocks", "n_bytes")


@query
def cleaning_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages reduced to their heading are rejected when the word list takes it."""
    df = fx.corpus(spark, sf_dir).withColumn(
        "html",
        F.when(F.col("page_id") % 3 == 0, F.regexp_extract("html", "(?s)<h1>.*?</h1>", 0))
        .when(F.col("page_id") % 11 == 0, F.lit("<article> </article>"))
        .otherwise(F.col("html")),
    )
    _, rejects = cleaning.cleaning_rejects(cleaning.clean_corpus(df, words=["###", "e"]))
    return rejects.select("page_id", "n_raw", "n_unwanted", "reason")


@query
def clean_inline_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = cleaning.clean_corpus(fx.spanned(spark, sf_dir), words=fx.WORDS)
    return cleaned.select("page_id", "body", "n_raw", "n_unwanted", "n_repeated")


@query
def clean_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = cleaning.clean_corpus(fx.decoyed(spark, sf_dir), words=fx.WORDS)
    return cleaned.select("page_id", "body", "n_raw", "n_unwanted", "n_repeated")


@query
def article_title_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.article_title(fx.decoyed(spark, sf_dir)).select("page_id", "title")


@query
def article_date_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = articles.article_date(fx.stamped(spark, sf_dir))
    return dated.select("page_id", "date_text", "published_at")


@query
def article_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.corpus(spark, sf_dir).select(
        "page_id",
        F.when(F.col("page_id") % 5 == 0, F.replace("html", F.lit("h1>"), F.lit("h2>")))
        .otherwise(F.col("html"))
        .alias("html"),
    )
    return articles.article_title(df, default="untitled").select("page_id", "title")


@query
def article_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.bylined(spark, sf_dir).select("page_id", "html")
    return articles.article_author(df, default="staff").drop("html")


@query
def article_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.bylined(spark, sf_dir).select("page_id", "html")
    return articles.article_date(df).drop("html")


@query
def render_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.bylined(spark, sf_dir).select("page_id", "html")
    rendered = articles.render_articles(df).select("page_id", "n_blocks", "page")
    return rendered


@query
def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.cleaned(spark, sf_dir)


# Compilation


@query
def publication_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compilation.publication_month(fx.dates(spark, sf_dir)).select("page_id", "month")


@query
def canonical_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit(" ('"), "article_key", F.lit(".html', "))
    return fx.pages(spark, sf_dir).select("page_id", keys.canonical_stem(name).alias("stem"))


@query
def order_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = compilation.order_articles(fx.articles(spark, sf_dir), fx.page_links(spark, sf_dir))
    return ordered.select("page_id", "section_key", "rank", "position")


@query
def compile_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.compiled(spark, sf_dir).select(
        "page_id", "section_key", "month", "rank", "position", "start_block", "start_byte"
    )


@query
def compile_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of 20,000 bytes, so that small groups too are cut."""
    return compilation.compile_body(fx.compiled(spark, sf_dir), fx.cleaned(spark, sf_dir), 20000)


@query
def archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compilation.archive_manifest(fx.compiled(spark, sf_dir), fx.sections(spark))


@query
def cover_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compilation.cover_rows(fx.compiled(spark, sf_dir), fx.sections(spark), fx.RUN_TS)


@query
def output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = compilation.publication_month(fx.articles(spark, sf_dir)).select("page_id", "section_key", "month")
    named = sections.normalize_section(months, fx.sections(spark))
    name = keys.output_name(F.col("section_name"), F.col("month"), "Demo")
    return named.select("page_id", name.alias("output_name"))


@query
def skip_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth body is blank; positions close up over the gap."""
    df = fx.articles(spark, sf_dir).withColumn(
        "n_bytes", F.when(F.col("page_id") % 5 != 0, F.col("n_bytes"))
    )
    kept = compilation.skip_unreadable(df)
    compiled = compilation.compile_monthly(kept, fx.page_links(spark, sf_dir))
    return compiled.select("page_id", "section_key", "month", "position")


@query
def compile_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled = fx.compiled(spark, sf_dir).drop("start_block")
    return compilation.compile_offsets(compiled).select(
        "page_id", "section_key", "month", "position", "start_block"
    )


@query
def run_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over all pages; its manifest is the result."""
    result = archive.run_archive(
        spark,
        fx.listings(spark, sf_dir),
        fx.corpus(spark, sf_dir),
        fx.fetches(spark, sf_dir),
        fx.sections(spark),
        work_path(spark, "archive"),
        fx.RUN_TS,
        outer="li",
    )
    return result.manifest


@query
def run_archive_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members in order, of a run whose links reach pages."""
    compiled = fx.archived(spark, sf_dir, work_path(spark, "archive")).compiled
    return compiled.select("section_key", "article_key", "month", "rank", "position", "start_byte", "title", "date_text")


@query
def run_archive_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.archived(spark, sf_dir, work_path(spark, "archive")).parts


@query
def run_archive_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.archived(spark, sf_dir, work_path(spark, "archive")).covers


@query
def run_archive_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.archived(spark, sf_dir, work_path(spark, "archive")).ledger


# Ledger


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.orders(spark, sf_dir).select(
        F.col("o_custkey").cast("string").alias("section_key"),
        (F.col("o_orderstatus") == "F").alias("completed"),
        F.col("o_orderkey").alias("n_links"),
        F.col("o_orderdate").alias("updated_at"),
    )


def ledger_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger_rows(spark, sf_dir)
    before, after = rows.where("n_links % 2 = 0"), rows.where("n_links % 2 = 1")
    return ledger.update_ledger(before, after, tie_break="n_links")


@query
def update_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_now(spark, sf_dir)


@query
def resume_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fx.orders(spark, sf_dir).select(F.col("o_custkey").cast("string").alias("section_key")).distinct()
    return ledger.resume_sections(known, ledger_now(spark, sf_dir), forced=["5", "10", "40"])


# Streaming: a file stream over the given tables, run until nothing is left, then read back


PAGE_SCHEMA = "page_id bigint, url string, html string"


def streamed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a file stream, whether the table is one file or a folder of them."""
    table = f"{sf_dir}/pages.parquet"
    if spark.read.parquet(table).inputFiles()[0].endswith("/pages.parquet"):
        return jobs.page_stream(spark, sf_dir, PAGE_SCHEMA, glob="pages.parquet")
    return jobs.page_stream(spark, table, PAGE_SCHEMA)


@query
def stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_path(spark, "stream-clean")
    pages = streamed_pages(spark, sf_dir)
    jobs.stream_clean(pages, f"{out}/articles", f"{out}/checkpoint", fx.with_keys).awaitTermination()
    stored = spark.read.parquet(f"{out}/articles")
    return stored.select("page_id", "section_key", "article_key", "n_blocks", "n_bytes")


@query
def stream_section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_path(spark, "stream-counts")
    pages = streamed_pages(spark, sf_dir)
    dated = fx.with_keys(pages).select("page_id", "section_key").join(
        fx.dates(spark, sf_dir).select("page_id", F.col("fetched_at").alias("published_at")), "page_id"
    )
    jobs.stream_section_counts(dated, f"{out}/counts", f"{out}/checkpoint").awaitTermination()
    return jobs.latest_counts(spark, f"{out}/counts")


@query
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_path(spark, "stream-ledger")
    pages = streamed_pages(spark, sf_dir)
    query = jobs.stream_ledger(
        fx.with_keys(pages), f"{out}/ledger", f"{out}/checkpoint", fx.RUN_TS, completed=["en", "de"]
    )
    query.awaitTermination()
    return jobs.latest_ledger(spark, f"{out}/ledger")


# Quality


@query
def script_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.spread_small(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return quality.script_share(docs, "text", "Latin").drop("text")


@query
def repeat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repeat_tokens(fx.cleaned(spark, sf_dir)).select("page_id", "n_runs")


@query
def residual_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaning.clean_corpus(fx.corpus(spark, sf_dir))
    df = df.withColumn("text", markup.body_text(F.col("body")))
    return quality.residual_markup(df, "text", fx.WORDS).select("page_id", "n_tags", "has_listed")


def articles_in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.cleaned(spark, sf_dir).withColumn("run", F.col("page_id") % 7)


@query
def statistics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged from seven runs; whether the estimates are as near to the exact numbers as stated."""
    articles = articles_in_runs(spark, sf_dir)
    report = statistics.statistics_report(statistics.run_statistics(articles), (0.5,))
    kept = articles.where("n_blocks > 0").select("section_key", "body", "n_bytes")
    near = kept.join(report.select("section_key", F.col("size_quantiles")[0].alias("_median")), "section_key")
    exact = near.groupBy("section_key").agg(
        F.countDistinct("body").alias("_texts"),
        F.avg((F.col("n_bytes") < F.col("_median")).cast("int")).alias("_below"),
        F.avg((F.col("n_bytes") <= F.col("_median")).cast("int")).alias("_upto"),
        (statistics.RANK_ERROR + 1 / F.count("*")).alias("_error"),
    )
    return report.join(exact, "section_key").select(
        "section_key", "n_articles", "n_bytes", "n_blocks",
        (F.abs(F.col("n_texts") - F.col("_texts")) <= F.greatest(F.lit(1.0), F.col("_texts") * statistics.TEXTS_ERROR)).alias("texts_near"),
        ((F.col("_below") <= 0.5 + F.col("_error")) & (F.col("_upto") >= 0.5 - F.col("_error"))).alias("median_near"),
    )


@query
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that occur more than once in a section, counted run by run."""
    lines = statistics.repeated_lines(articles_in_runs(spark, sf_dir), keep=10_000_000)
    return statistics.merge_lines(lines).where("n_least > 1")


@query
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.corpus_report(fx.cleaned(spark, sf_dir))
