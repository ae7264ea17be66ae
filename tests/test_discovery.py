from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from newscorpus import values
from newscorpus.operators import discovery, keyed, sections
from newscorpus.plans.archive import discover
from newscorpus.sources.tables import read_sections

LISTING = """<html><body><div class="td-mobile-nav x"><div><h3><a href="/menu">m</a></h3></div>
<h3><a href="/menu2">m</a></h3></div><h3><a href="/side">side</a></h3>
<div id=g class='td-main-content-wrap'><div><h3 class="t"><a rel=x href="/a?p=1&amp;q=2">One <b>two</b></a>
<a href="/other">no</a></h3></div><h3>no anchor</h3><h3><a href="">empty</a><a href="/second">no</a></h3>
<h3><a title='href="/fake"' href='/b'>B &#39;q&#39;</a></h3><h3><a href=/c>C</a></div>
<h3><a href="/below">below</a></h3></body></html>"""


def listing(spark, *pages):
    return spark.createDataFrame(list(pages), "section_key string, page_no bigint, html string")


def test_links_of_the_main_grid(spark):
    df = discovery.scope_container(discovery.strip_chrome(listing(spark, ("s", 1, LISTING))))
    assert rows(discovery.extract_links(df), "pos") == [
        ("s", 1, 0, "/a?p=1&q=2", "One two"),
        ("s", 1, 3, "/b", "B 'q'"),
        ("s", 1, 4, "/c", "C"),
    ]


def test_chrome_is_matched_by_whole_class_name(spark):
    html = '<div class="td-mobile-nav-x">keep</div><nav class="a td-mobile-nav">go<nav>in</nav>go</nav>tail'
    out = discovery.strip_chrome(listing(spark, ("s", 1, html))).first()["html"]
    assert out == '<div class="td-mobile-nav-x">keep</div>tail'


def test_every_chrome_container_goes_even_when_unclosed(spark):
    html = '<p>a</p><ul class="td-mobile-nav"><li>x</li></ul>b<div class="td-header-menu-wrap">c<div>d</div>'
    assert discovery.strip_chrome(listing(spark, ("s", 1, html))).first()["html"] == "<p>a</p>b"


def test_scope_falls_back_to_the_page(spark):
    assert discovery.scope_container(listing(spark, ("s", 1, "<p>x</p>"))).first()["html"] == "<p>x</p>"


def test_first_sighting_by_section_and_rank(spark):
    page = "".join
    links = [f'<h3><a href="/{u}">{u}</a></h3>' for u in "abc"]
    df = listing(
        spark,
        ("s", 1, page(links[:2])),
        ("s", 2, page(links[1:] + links[:1])),
        ("t", 1, page(links[:1])),
    )
    found = discover(df, "2026-01-02 03:04:05")
    assert rows(found.select("section_key", "rank", "url", "page_no", "pos"), "section_key", "rank") == [
        ("s", 0, "/a", 1, 0),
        ("s", 1, "/b", 1, 1),
        ("s", 2, "/c", 2, 1),
        ("t", 0, "/a", 1, 0),
    ]
    assert discover(df, "2026-01-02 03:04:05", max_pages=1).count() == 3
    again = discovery.dedup_links(found.drop("rank"))
    assert again.exceptAll(found.drop("rank")).count() == 0 and again.count() == 4


def test_counts_per_page_section_and_all(spark):
    links = spark.createDataFrame(
        [("s", 1, "a"), ("s", 1, "b"), ("s", 2, "c"), ("t", 1, "a")], "section_key string, page_no bigint, url string"
    )
    got = rows(discovery.discovery_counts(links), "level", "section_key", "page_no")
    assert got == [
        ("s", 1, 2, 0), ("s", 2, 1, 0), ("t", 1, 1, 0), ("s", None, 3, 1), ("t", None, 1, 1), (None, None, 4, 3),
    ]


def log(spark, **by_section):
    """One letter per page: ``.`` fetched, ``x`` failed, ``0`` fetched without links."""
    data = [
        (s, i + 1, c != "x", 0 if c == "0" else 5)
        for s, letters in by_section.items()
        for i, c in enumerate(letters)
    ]
    return spark.createDataFrame(data, "section_key string, page_no bigint, ok boolean, n_links bigint")


def test_listing_stop(spark):
    df = log(spark, four="..xxxx..", three="..xxx...xxx.", empty="...0..", all="xxxxx", fine="...", late="xxx.xxxx.0")
    stops = {r[0]: r[1:] for r in rows(discovery.listing_stops(df))}
    assert stops == {"four": (6, "errors"), "empty": (4, "no links"), "all": (4, "errors"), "late": (8, "errors")}
    kept = {r[0]: r[1] for r in rows(discovery.listing_stop(df).groupBy("section_key").count())}
    assert kept == {"four": 5, "three": 12, "empty": 3, "all": 3, "fine": 3, "late": 7}
    capped = {r[0]: r[1] for r in rows(discovery.listing_stop(df, max_pages=4).groupBy("section_key").count())}
    assert capped == {"four": 4, "three": 4, "empty": 3, "all": 3, "fine": 3, "late": 4}


def test_sections(spark):
    known = read_sections(spark)
    assert known.count() == 14
    df = spark.createDataFrame([("FACTCHECK",), ("religion",), ("new DESK",)], "section_key string")
    named = sections.normalize_section(df, known)
    assert rows(named, "section_key") == [
        ("FACTCHECK", "FactCheck", "/category/fact-check/"),
        ("new DESK", "New desk", "/category/new desk/"),
        ("religion", "Religion", "/category/misc/religion-and-culture/"),
    ]
    assert "BroadcastHashJoin" in named._jdf.queryExecution().executedPlan().toString()
    assert rows(sections.select_sections(known, ["Politics", "MISC"]).select("section_key"), "section_key") == [
        ("misc",), ("politics",)]
    assert sections.demo_section(known).first()["name_english"] == "Gujarat"
    assert sections.select_sections(known).count() == 14


def test_frontier(spark):
    one = sections.select_sections(read_sections(spark), ["factcheck"])
    urls = rows(sections.listing_frontier(one, "https://x.org/", 3).select("url"), "page_no")
    assert [u for (u,) in urls] == [
        "https://x.org/category/fact-check/",
        "https://x.org/category/fact-check/page/2/",
        "https://x.org/category/fact-check/page/3/",
    ]
    assert sections.listing_frontier(read_sections(spark)).count() == 14 * values.DEMO_MAX_PAGES


def test_key_collisions_count_distinct_urls(spark):
    df = spark.range(2000).select(
        F.lit("s").alias("section_key"), F.concat(F.lit("/"), (F.col("id") % 1000).cast("string")).alias("url")
    )
    assert sections.key_collisions(df).count() == 0
    import hashlib
    from collections import Counter

    short = Counter(hashlib.md5(f"/{i}".encode()).hexdigest()[:3] for i in range(1000))
    assert sections.key_collisions(df, width=3).count() == sum(n for n in short.values() if n > 1)


def test_one_copy_of_wide_rows(spark, monkeypatch):
    df = spark.range(100).select("id", (F.col("id") % 40).alias("k"), F.lit("wide").alias("html"))
    want = list(range(40))
    assert sorted(r["id"] for r in keyed.one_copy(df, ["k"], "id").collect()) == want
    monkeypatch.setattr(keyed, "MAX_BROADCAST_KEYS", 3)
    assert sorted(r["id"] for r in keyed.one_copy(df, ["k"], "id").collect()) == want
