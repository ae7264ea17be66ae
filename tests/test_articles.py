from __future__ import annotations

import pytest
from conftest import rows

from newscorpus.operators import articles


def page(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "id int, html string")


@pytest.mark.parametrize(
    ("html", "title"),
    [
        ("<h1 class='x'> A <i>b</i>&amp;c </h1><h1>second</h1>", "A b &c"),
        ("<h1> </h1>", ""),
        ("<h2>no</h2>", "default"),
        ("<H1>open", "open"),
    ],
)
def test_title(spark, html, title):
    assert articles.article_title(page(spark, html), default="default").first()["title"] == title


@pytest.mark.parametrize(
    ("html", "author"),
    [
        ('<span class="td-post-author-name">By <a>N</a></span>', "By N"),
        ('<a class="x co-Author">' + "n" * 49 + "</a>", "n" * 49),
        ('<a class="author">' + "n" * 50 + "</a>", "staff"),
        ('<a class="author">' + "n" * 50 + '</a><b class="author">Second</b>', "staff"),
        ('<i class="author"> </i><b class="author">Second</b>', "staff"),
        ("<div class='author'><div>In</div> out</div> rest", "In out"),
        ('<img class="author-photo" src="x"> text <p>more</p>', "staff"),
        ("<p>by author</p>", "staff"),
    ],
)
def test_author_is_the_first_match_or_nobody(spark, html, author):
    assert articles.article_author(page(spark, html), default="staff").first()["author"] == author


@pytest.mark.parametrize(
    ("html", "text", "typed"),
    [
        ("<i class='td-post-date'>no</i><time>May 5, 2024</time>", "May 5, 2024", "2024-05-05 00:00:00"),
        ('<div class="x ENTRY-DATE">2024-05-06</div>', "2024-05-06", "2024-05-06 00:00:00"),
        ("<time> </time>", "", None),
        ("<p>none</p>", "June 2026", None),
        ("<time>someday</time>", "someday", None),
    ],
)
def test_date(spark, html, text, typed):
    df = articles.article_date(page(spark, html))
    assert rows(df.selectExpr("date_text", "cast(published_at as string)")) == [(text, typed)]


def test_rendering_escapes_and_scopes(spark):
    html = (
        "<body><h1>T & \"q\"</h1><p>outside</p><div class='entry-content'><div><p>a &lt;b&gt; it's</p></div>"
        "<h4>Sub</h4><p>Source: x</p><p>- Advertisement -</p><p>a &lt;b&gt; it's</p></div><p>after</p></body>"
    )
    row = articles.render_articles(page(spark, html)).first()
    line = "<p>a &lt;b&gt; it&#x27;s</p>"
    assert row["body"] == f"{line}\n<h2>Sub</h2>\n{line}"
    assert "<h1>Article Title: T &amp; &quot;q&quot;</h1>" in row["page"]
    assert "<p><b>Date:</b> June 2026</p>" in row["page"]


def test_rendering_without_container_takes_the_whole_page(spark):
    row = articles.render_articles(page(spark, "<p>one</p><div><h2>two</h2></div>")).first()
    assert row["body"] == "<p>one</p>\n<h2>two</h2>"
