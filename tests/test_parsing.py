"""Markup as a parser sees it: spans, comments, scripts, quoted angle brackets, headings, dates."""

from __future__ import annotations

import datetime

import pytest

from newscorpus.operators import articles, cleaning, discovery


def body(spark, html, words=("Advertisement",)):
    df = spark.createDataFrame([(html,)], "html string")
    return cleaning.clean_corpus(df, words=list(words)).first()


@pytest.mark.parametrize(
    "html, want, repeated",
    [
        (
            "<p><span>Modi</span> said X.</p><p><span>Modi</span> said Y.</p>",
            "<p>Modi said X.</p>\n<p>Modi said Y.</p>",
            0,
        ),
        ("<p>Advertisement <span>tail</span> text</p><p>kept</p>", "<p>kept</p>", 0),
        ("<span>loose <b>text</b></span><p>a</p>", "<p>loose text</p>\n<p>a</p>", 0),
        ('<p data-x="a > b">text</p>', "<p>text</p>", 0),
        ("<p title='x > y' id=z>one</p><p class=it's>two</p><p>three 'q' > 1</p>", "<p>one</p>\n<p>two</p>\n<p>three 'q' > 1</p>", 0),
        ("<h2><div>Head</div></h2><p>x</p>", "<h2>Head</h2>\n<p>x</p>", 0),
        ("<h2>Open<p>x</p><h2>Next</h2>", "<h2>Open</h2>\n<p>x</p>\n<h2>Next</h2>", 0),
    ],
)
def test_blocks(spark, html, want, repeated):
    row = body(spark, html)
    assert (row["body"], row["n_repeated"]) == (want, repeated)


def test_long_attribute_does_not_recurse(spark):
    value = "a > b = c " * 50_000
    assert body(spark, f'<p data-x="{value}">text</p>')["body"] == "<p>text</p>"
    assert body(spark, "<h2>" + "x<b>y</b>" * 20_000 + "<div>z</div></h2>")["n_blocks"] == 1


DECOYS = """<!-- <h1>old</h1><h3><a href="/old">o</a></h3><time>2001-01-01</time><b class="author">Old</b> -->
<script>var s = "<h3><a href='/js'>j</a></h3><h1>js</h1>";</script><style>h1:after{content:"<time>x</time>"}</style>"""


def test_decoys_are_not_read(spark):
    page = DECOYS + """<h1 title="1 > 0">Title</h1><h3 data-q="a>b"><a title="x > y" href="/new">New</a></h3>
<i data-n="2 > 1" class="author">Name</i><time datetime="2024-05-01T10:00:00">૧ મે</time>"""
    df = spark.createDataFrame([("s", 1, page)], "section_key string, page_no int, html string")
    links = discovery.extract_links(discovery.scope_container(discovery.strip_chrome(df))).collect()
    assert [(r["url"], r["title"]) for r in links] == [("/new", "New")]
    row = articles.article_date(articles.article_author(articles.article_title(df))).first()
    assert (row["title"], row["author"], row["date_text"]) == ("Title", "Name", "૧ મે")
    assert row["published_at"] == datetime.datetime(2024, 5, 1, 10)


def test_unclosed_comment_hides_the_rest(spark):
    df = spark.createDataFrame([("<p>a</p><!-- <h1>no</h1>",)], "html string")
    assert articles.article_title(df, default="none").first()["title"] == "none"


def test_native_months(spark):
    df = spark.createDataFrame([("<time>૩ મે ૨૦૨૪</time>",), ("<time>May 3, 2024</time>",)], "html string")
    found = articles.article_date(df, months={"મે": 5}).select("published_at").collect()
    assert {r[0] for r in found} == {datetime.datetime(2024, 5, 3)}
    assert articles.article_date(df).where("published_at is null").count() == 1


def test_layout_keeps_heading_with_inner_block(spark):
    df = spark.createDataFrame([('<div class="entry-content"><h2><div>Head</div></h2><p>x</p></div>',)], "html string")
    assert articles.layout_body(df).first()["body"] == "<h2>Head</h2>\n<p>x</p>"


def test_repeated_attempts_are_one_failure(spark):
    rows = [("s", p, a, False, 0) for p in (1, 2) for a in (1, 2)] + [("s", 3, 1, True, 4), ("s", 4, 1, None, None)]
    rows += [("t", p, 1, None, 0) for p in (1, 2, 3, 4)]
    log = spark.createDataFrame(rows, "section_key string, page_no bigint, attempt int, ok boolean, n_links bigint")
    stops = {r["section_key"]: r["stop_page"] for r in discovery.listing_stops(log).collect()}
    assert stops == {"t": 4}
