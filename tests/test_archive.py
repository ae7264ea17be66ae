"""What a run must not lose: unknown, mixed-case and numeric sections, stale months, earlier pages."""

from __future__ import annotations

import hashlib

from conftest import rows
from pyspark.sql import functions as F

from newscorpus.operators import ingest
from newscorpus.plans.archive import run_archive
from newscorpus.sources import tables

TS = "2026-01-0{} 00:00:00"
LISTING = "section_key string, page_no bigint, html string"


def pages(spark, *found):
    df = spark.createDataFrame(
        [(i, s, u, h) for i, (s, u, h) in enumerate(found)], "page_id bigint, section_key string, url string, html string"
    )
    return df.withColumn("article_key", F.md5(F.col("url").cast("binary")))


def archive(spark, out, found, listing=(), run=1, **more):
    df = pages(spark, *found)
    fetches = df.select("section_key", "article_key").distinct().select(
        "*", F.expr("timestamp_ntz'2024-05-01'").alias("published_at"), F.expr("timestamp_ntz'2024-06-01'").alias("fetched_at")
    )
    return run_archive(
        spark, spark.createDataFrame(list(listing), LISTING), df, fetches, tables.read_sections(spark), str(out), TS.format(run), **more
    )


def members(result):
    return rows(result.compiled.select("section_key", "month", "position", "article_key"), "section_key", "month", "position")


def names(result):
    return {(s, m, n) for s, m, n in ((r["section_key"], r["month"], r["n_articles"]) for r in result.covers.collect())}


def test_unknown_and_numeric_sections(spark, tmp_path):
    found = [("2024", "/a", "<p>a</p>"), ("007", "/b", "<p>b</p>"), ("World", "/c", "<p>c</p>"), ("7", "/d", "<p>d</p>")]
    listing = [("World", 1, "<h3><a href='/c'>c</a></h3>"), ("world", 2, "<h3><a href='/c'>c</a></h3><h3><a href='/x'>x</a></h3>")]
    result = archive(spark, tmp_path, found, listing)
    assert names(result) == {("007", "2024-05", 1), ("2024", "2024-05", 1), ("7", "2024-05", 1), ("world", "2024-05", 1)}
    assert rows(result.links.select("url", "rank"), "rank") == [("/c", 0), ("/x", 1)]
    assert [r["url"] for r in result.pending.collect()] == ["/x"]
    assert dict(result.articles.dtypes)["section_key"] == "string"
    again = archive(spark, tmp_path / "named", found, listing, names=["2024", "WORLD", "none"])
    assert names(again) == {("2024", "2024-05", 1), ("world", "2024-05", 1)}
    ledger = rows(again.ledger.select("section_key", "n_links"), "section_key")
    assert ledger == [("2024", 0), ("none", 0), ("world", 2)]
    nothing = archive(spark, tmp_path / "none", found, listing, names=["none"])
    assert nothing.compiled.count() == nothing.articles.count() == 0


def test_a_section_whose_pages_are_all_rejected_disappears(spark, tmp_path):
    both = [("crime", "/1", "<p>a</p>"), ("world", "/2", "<p>b</p>")]
    archive(spark, tmp_path, both)
    result = archive(spark, tmp_path, [("crime", "/1", "<p>Advertisement</p>")], run=2, names=["crime"])
    assert names(result) == {("world", "2024-05", 1)}
    assert [r["section_key"] for r in result.compiled.collect()] == ["world"]
    assert result.manifest.where("level = 3").first()["n_articles"] == 1
    assert [(r["section_key"], r["reason"]) for r in result.rejects.collect()] == [("crime", "only unwanted blocks")]


def test_resume_skips_unlisted_sections_only_when_done(spark, tmp_path):
    first = archive(spark, tmp_path, [("odd", "/1", "<p>a</p>")], names=["odd"])
    found = [("odd", "/1", "<p>changed</p>"), ("Other", "/2", "<p>b</p>")]
    result = archive(spark, tmp_path, found, run=2, previous=first.ledger)
    bodies = rows(result.articles.select("section_key", "body"), "section_key")
    assert bodies == [("odd", "<p>a</p>"), ("other", "<p>b</p>")]
    assert {"odd", "other", "world"} <= {r["section_key"] for r in result.ledger.collect()}


def test_new_pages_are_added_and_equal_keys_replaced(spark, tmp_path):
    archive(spark, tmp_path, [("world", "/1", "<p>one</p>"), ("world", "/2", "<p>two</p>")])
    result = archive(spark, tmp_path, [("world", "/2", "<p>two, new</p>"), ("world", "/3", "<p>three</p>")], run=2)
    assert rows(result.articles.select("url", "body"), "url") == [
        ("/1", "<p>one</p>"), ("/2", "<p>two, new</p>"), ("/3", "<p>three</p>")]
    assert [p for *_, p, _ in members(result)] == [1, 2, 3]
    assert result.parts.agg(F.sum("n_articles")).first()[0] == 3


def test_the_page_has_the_first_say_on_the_month(spark, tmp_path):
    found = [("world", "/1", '<h1>T</h1><time datetime="2023-02-03">x</time><p>one</p>'), ("world", "/2", "<p>two</p>")]
    result = archive(spark, tmp_path, found)
    assert names(result) == {("world", "2023-02", 1), ("world", "2024-05", 1)}
    assert [(r["title"], r["date_text"]) for r in result.articles.where("url = '/1'").collect()] == [("T", "x")]
    parts = rows(result.parts.select("month", "body"), "month")
    assert [m for m, _ in parts] == ["2023-02", "2024-05"] and parts[1][1] == "<p>two</p>"


def test_what_a_dead_run_wrote_is_not_seen(spark, tmp_path):
    archive(spark, tmp_path, [("world", "/1", "<p>one</p>")])
    dead = tmp_path / "compiled" / "run=9" / "section_key=world"
    spark.read.parquet(str(tmp_path / "compiled")).drop("run", "section_key").write.parquet(str(dead))
    result = archive(spark, tmp_path, [("world", "/2", "<p>two</p>")], run=2)
    assert result.articles.count() == 2 and len(members(result)) == 2


def test_from_files_to_compilation(spark, tmp_path):
    def digest(url):
        return hashlib.md5(url.encode()).hexdigest()

    footer = '<p class="metadata_footer">Source: {"url": "/own", "category": "world", "scraped_date": "2024-01-01T00:00:00"}</p>'
    files = {("World", digest("/listed")[:8]): "<html><p>listed</p></html>", ("World", digest("/own")[:8]): f"<p>own</p>{footer}",
             ("World", "ffffffff"): "<p>nobody knows</p>", ("crime", digest("/c")[:1]): "<p>c</p>"}
    for (section, short), html in files.items():
        (tmp_path / "store" / section).mkdir(parents=True, exist_ok=True)
        (tmp_path / "store" / section / f"{short}.html").write_text(html)
    same = next(f"/x{i}" for i in range(200) if digest(f"/x{i}")[0] == digest("/c")[0])
    links = spark.createDataFrame([("world", "/listed"), ("world", "/other"), ("CRIME", "/c"), ("crime", same)], "section_key string, url string")
    found = ingest.identify_pages(tables.read_pages(spark, str(tmp_path / "store"), fmt="html"), links)
    got = rows(found.select("section_key", "url", "article_key", "n_urls"), "section_key", "url")
    assert got == [("World", None, None, 0), ("World", "/listed", digest("/listed"), 1), ("World", "/own", digest("/own"), 1), ("crime", None, None, 2)]
    whole = found.where("url is not null").withColumn("page_id", F.monotonically_increasing_id())
    times = whole.select("section_key", "article_key", F.expr("timestamp_ntz'2024-05-01'").alias("published_at"), F.expr("timestamp_ntz'2024-06-01'").alias("fetched_at"))
    listing = spark.createDataFrame([("world", 1, "<h3><a href='/own'>o</a></h3><h3><a href='/listed'>l</a></h3>")], LISTING)
    result = run_archive(spark, listing, whole, times, tables.read_sections(spark), str(tmp_path / "out"), TS.format(1))
    assert rows(result.parts.select("section_key", "month", "body")) == [("world", "2024-05", "<p>own</p>\n<p>listed</p>")]
