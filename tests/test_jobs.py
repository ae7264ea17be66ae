"""Streams and the whole archive run."""

from __future__ import annotations

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.queries import PAGE_SCHEMA
from newscorpus.operators import cleaning
from newscorpus.plans import archive
from newscorpus.sources import tables
from newscorpus.streaming import jobs

KEEP = ["page_id", "section_key", "article_key", "body", "n_blocks"]


@pytest.fixture
def drops(spark, tmp_path):
    """Two drops of page files; the second repeats ten pages under new ids."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")

    def drop(number):
        if number == 1:
            part = pages.where("page_id < 30")
        else:
            again = pages.where("page_id < 10").withColumn("page_id", F.col("page_id") + 1000)
            part = pages.where("page_id >= 30").unionByName(again).unionByName(
                again.withColumn("page_id", F.col("page_id") + 1000)
            )
        part.coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))

    return pages, drop, str(tmp_path)


def test_stream_equals_batch_over_two_drops_and_a_restart(spark, drops):
    pages, drop, base = drops

    def run():
        stream = jobs.page_stream(spark, f"{base}/in", PAGE_SCHEMA, files_per_batch=1)
        jobs.stream_clean(stream, f"{base}/out", f"{base}/ckpt", fx.with_keys).awaitTermination()
        return spark.read.parquet(f"{base}/out")

    drop(1)
    assert run().count() == 30
    drop(2)
    streamed = rows(run().select(*KEEP), "page_id")
    assert streamed == rows(cleaning.clean_corpus(fx.with_keys(pages)).select(*KEEP), "page_id")
    run()
    assert run().count() == 50


def test_a_batch_run_again_replaces_its_output(spark, drops):
    """The last commit mark is lost, as when a driver dies right after writing."""
    _, drop, base = drops
    drop(1)

    def run():
        stream = jobs.page_stream(spark, f"{base}/in", PAGE_SCHEMA)
        jobs.stream_clean(stream, f"{base}/out", f"{base}/ckpt", fx.with_keys).awaitTermination()
        ledger_in = fx.with_keys(jobs.page_stream(spark, f"{base}/in", PAGE_SCHEMA))
        jobs.stream_ledger(ledger_in, f"{base}/ledger", f"{base}/ckpt-l", fx.RUN_TS).awaitTermination()

    run()
    import pathlib

    for ckpt in ("ckpt", "ckpt-l"):
        commits = pathlib.Path(base, ckpt, "commits")
        newest = max(p for p in commits.iterdir() if p.name.isdigit())
        newest.unlink()
        (commits / f".{newest.name}.crc").unlink(missing_ok=True)
    run()
    assert spark.read.parquet(f"{base}/out").count() == 30
    total = jobs.latest_ledger(spark, f"{base}/ledger").agg(F.sum("n_links")).first()[0]
    assert total == 30


def test_running_counts_and_ledger(spark, drops):
    pages, drop, base = drops

    def run():
        dated = fx.with_keys(jobs.page_stream(spark, f"{base}/in", PAGE_SCHEMA, files_per_batch=1)).withColumn(
            "published_at", F.expr("timestamp_ntz'2024-01-15' + make_dt_interval(int(page_id % 40))")
        )
        jobs.stream_section_counts(dated, f"{base}/counts", f"{base}/ckpt-c").awaitTermination()
        jobs.stream_ledger(dated, f"{base}/ledger", f"{base}/ckpt-l", fx.RUN_TS).awaitTermination()

    drop(1)
    run()
    drop(2)
    run()
    seen = fx.with_keys(spark.read.parquet(f"{base}/in"))
    month = F.date_format(F.expr("timestamp_ntz'2024-01-15' + make_dt_interval(int(page_id % 40))"), "yyyy-MM")
    want = seen.groupBy("section_key", month.alias("month")).agg(F.count("*").alias("n"))
    assert rows(jobs.latest_counts(spark, f"{base}/counts"), "section_key", "month") == rows(want, "section_key", "month")
    state = jobs.latest_ledger(spark, f"{base}/ledger").select("section_key", "n_links")
    assert rows(state, "section_key") == rows(seen.groupBy("section_key").count(), "section_key")


def test_a_batch_reads_only_its_buckets(spark, drops):
    pages, drop, base = drops
    drop(1)
    drop(2)
    stream = jobs.page_stream(spark, f"{base}/in", PAGE_SCHEMA, files_per_batch=1)
    jobs.stream_clean(stream, f"{base}/out", f"{base}/ckpt", fx.with_keys, compact_every=2).awaitTermination()
    keys = fx.with_keys(pages).select("section_key", "article_key")
    assert spark.read.parquet(f"{base}/out").select("article_key").distinct().count() == 50
    bucket = keys.first()["article_key"][:2]
    found = jobs.stored_keys(spark, f"{base}/out", 99, [bucket])
    assert rows(found, "article_key") == rows(keys.where(F.substring("article_key", 1, 2) == bucket), "article_key")
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and f"bucket#" in plan
    assert {f.split("bucket=")[1][:2] for f in found.where("true").inputFiles() if "bucket=" in f} >= {bucket}
    assert spark.read.parquet(f"{base}/out-keys/whole").count() > 0


def listing_page(section, *urls):
    return "".join(f"<h3><a href='{u}'>{section} {u}</a></h3>" for u in urls)


def test_archive_run(spark, tmp_path):
    listings = spark.createDataFrame(
        [("World", 1, listing_page("w", "/2", "/1")), ("World", 2, listing_page("w", "/1", "/3")),
         ("crime", 1, listing_page("c", "/1"))],
        "section_key string, page_no bigint, html string",
    ).withColumn("section_key", F.lower("section_key"))
    bodies = [("world", "/1", "<p>one</p>"), ("world", "/2", "<p>two</p><p>two</p>"), ("world", "/9", "<p>extra</p>"),
              ("world", "/0", "<p>Photo: x</p>"), ("crime", "/1", "<h1>c</h1><p>crime</p>"),
              ("world", "/1", "<p>one again</p>"), ("sports", "/5", "<p>s</p>")]
    pages = spark.createDataFrame(
        [(i, s, u, h) for i, (s, u, h) in enumerate(bodies)], "page_id bigint, section_key string, url string, html string"
    ).withColumn("article_key", F.md5(F.col("url").cast("binary")))
    fetches = pages.select("section_key", "article_key").distinct().select(
        "*", F.expr("timestamp_ntz'2024-05-01'").alias("published_at"), F.expr("timestamp_ntz'2024-06-01'").alias("fetched_at")
    )
    run = archive.run_archive(
        spark, listings, pages, fetches, tables.read_sections(spark), str(tmp_path), "2026-01-01 00:00:00",
        names=["WORLD", "crime"],
    )
    placed = run.compiled.select("section_key", "article_key", "position")
    order = placed.join(run.articles, ["section_key", "article_key"])
    got = rows(order.select("section_key", "position", "url", "body"), "section_key", "position")
    assert got == [
        ("crime", 1, "/1", "<h2>c</h2>\n<p>crime</p>"),
        ("world", 1, "/2", "<p>two</p>"),
        ("world", 2, "/1", "<p>one</p>"),
        ("world", 3, "/9", "<p>extra</p>"),
    ]
    assert [r["url"] for r in run.pending.collect()] == ["/3"]
    assert [(r["url"], r["reason"]) for r in run.rejects.collect()] == [("/0", "only unwanted blocks")]
    files = rows(run.manifest.where("level = 0").select("file_name", "n_articles"), "file_name")
    assert files == [("Crime/News_Archive_Crime_2024-05", 1), ("World/News_Archive_World_2024-05", 3)]
    assert rows(run.ledger.select("section_key", "n_links"), "section_key") == [("crime", 1), ("world", 3)]
    assert run.covers.count() == 2

    # Resumed with an empty listing of the one section that is left: the others stay as they are.
    log = spark.createDataFrame([("sports", 1, True, 0)], "section_key string, page_no bigint, ok boolean, n_links bigint")
    three = tables.read_sections(spark).where("section_key in ('world', 'crime', 'sports')")
    before = rows(run.compiled, "section_key", "position")
    more = archive.run_archive(
        spark, listings, pages, fetches, three, str(tmp_path), "2026-01-02 00:00:00", previous=run.ledger, fetch_log=log,
    )
    assert rows(more.ledger.select("section_key", "n_links"), "section_key") == [("crime", 1), ("sports", 0), ("world", 3)]
    after = more.compiled.select(*run.compiled.columns)
    assert rows(after.where("section_key <> 'sports'"), "section_key", "position") == before
    assert [r["article_key"] for r in after.where("section_key = 'sports'").collect()] == [
        r["article_key"] for r in pages.where("section_key = 'sports'").collect()]
    assert more.manifest.where("level = 3").first()["n_articles"] == 5
    assert archive.sections_to_do(three, None, more.ledger).count() == 0
    kept = run.manifest.where("level = 3").first()["n_articles"]
    assert kept == run.articles.count()
    assert (tmp_path / "manifest").exists()
