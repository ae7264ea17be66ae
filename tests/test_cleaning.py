"""Hand-made pages; expected rows are written by hand."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from newscorpus.operators import cleaning


def page(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "id int, html string")


def blocks(spark, html, **kwargs):
    df = cleaning.split_blocks(cleaning.main_content(page(spark, html)), **kwargs)
    found = cleaning.explode_blocks(cleaning.drop_empty_blocks(df))
    return [(tag, text) for _, tag, text in rows(found, "pos")]


def test_nested_blocks_do_not_repeat_text(spark):
    html = "<div>intro <div><p>one</p></div><p>two</p> tail</div>"
    assert blocks(spark, html) == [("div", "intro"), ("p", "one"), ("p", "two"), ("", "tail")]


def test_inline_tags_become_spaces(spark):
    assert blocks(spark, "<p>a<b>b</b> c<br/>d</p>") == [("p", "a b c d")]


def test_unclosed_paragraphs_end_at_the_next_block(spark):
    html = "<article><p>one<p><b>two<br><h2>head<p>three</article><footer>no</footer>"
    assert blocks(spark, html) == [("p", "one"), ("p", "two"), ("h2", "head"), ("p", "three")]


def test_close_tag_inside_a_script_is_not_a_boundary(spark):
    html = '<p>one <script type="x">var t="</p><p>junk";</script>two</p>'
    assert blocks(spark, html) == [("p", "one two")]


def test_furniture_and_comments_go_and_the_article_stays(spark):
    html = (
        "<html><head><title>t</title><style>p{}</style></head><body><NAV><p>menu</p></NAV>"
        "<!-- <p>old</p> --><p>outside</p><article class='x'><header>h</header><p>in</p></article>"
        "<footer><p>foot</p></footer></body></html>"
    )
    assert blocks(spark, html) == [("", "h"), ("p", "in")]


def test_a_page_without_article_keeps_everything(spark):
    assert blocks(spark, "<body><p>one</p><pre>two</pre></body>") == [("p", "one"), ("", "two")]


def test_layout_blocks_leave_loose_text_out(spark):
    html = "<ul><li>item</li></ul><p>one</p>loose<h4>head</h4><div>box</div>"
    found = blocks(spark, html, tags=["p", "h2", "h3", "h4"], loose_text=False)
    assert found == [("p", "one"), ("h4", "head")]


@pytest.mark.parametrize(
    ("raw", "text"),
    [
        ("a&amp;nbsp;b", "a b"),
        ("a&nbsp;&nbsp;&nbsp;b", "a b"),
        ("a  b", "a b"),
        ("&#2709;&#x0A95;", "કક"),
        ("&lt;b&gt;", "<b>"),
        ("&amp;lt;", "&lt;"),
        ("&amp;#39;", "&#39;"),
        ("&eacute;t&eacute; &amp; &copy;", "été & ©"),
        ("a &notanentity b", "a ¬anentity b"),
        ("R&D & x", "R&D & x"),
        ("plain", "plain"),
    ],
)
def test_entities_are_decoded_once(spark, raw, text):
    df = cleaning.decode_entities(page(spark, raw), "html")
    assert df.first()["html"] == text


def test_decoded_markup_stays_text(spark):
    assert blocks(spark, "<p>use &lt;p&gt; here</p>") == [("p", "use <p> here")]


def test_control_characters_cannot_forge_blocks(spark):
    assert blocks(spark, "<p>a\u0001h2\u0002b</p>") == [("p", "ah2b")]


def test_blocklist_modes(spark):
    df = cleaning.split_blocks(page(spark, "<p>ગુજરાત</p><p>ગુજરાત સમાચાર</p><p>text</p>"), "html")

    def kept(words, mode):
        return [r[2] for r in rows(cleaning.explode_blocks(
            cleaning.drop_empty_blocks(cleaning.drop_blocklisted(df, words, mode))), "pos")]

    assert kept(None, "contains") == ["text"]
    assert kept([f"w{i}" for i in range(200)] + ["સમાચાર"], "contains") == ["ગુજરાત", "text"]
    assert kept(["ગુજરાત"], "equals") == ["ગુજરાત સમાચાર", "text"]
    with pytest.raises(ValueError):
        cleaning.drop_blocklisted(df, ["x"], "regex")


def test_first_copy_of_a_text_is_kept_in_order(spark):
    html = "<h1>same</h1><p>b</p><p>same</p><p>a</p><p>b</p>"
    once = cleaning.dedup_blocks(cleaning.drop_empty_blocks(cleaning.split_blocks(page(spark, html), "html")))
    found = [r[1:] for r in rows(cleaning.explode_blocks(once), "pos")]
    assert found == [("h1", "same"), ("p", "b"), ("p", "a")]
    twice = cleaning.dedup_blocks(once)
    assert rows(cleaning.explode_blocks(twice), "pos") == rows(cleaning.explode_blocks(once), "pos")


def test_clean_corpus(spark):
    html = (
        "<html><body><article><h1>ટાઇટલ</h1><h3>Sub &amp; more</h3><p>Advertisement here</p>"
        "<p>body</p><p>body</p><p> </p></article></body></html>"
    )
    row = cleaning.clean_corpus(page(spark, html)).first().asDict()
    assert row == {
        "id": 0,
        "n_raw": 5,
        "n_blocks": 3,
        "body": "<h2>ટાઇટલ</h2>\n<h2>Sub & more</h2>\n<p>body</p>",
        "n_bytes": len("<h2>ટાઇટલ</h2>\n<h2>Sub & more</h2>\n<p>body</p>".encode()),
        "n_unwanted": 1,
        "n_repeated": 1,
    }


def test_rejects_have_a_reason(spark):
    df = page(spark, "<p>ok</p>", "<p> </p>", "<p>Photo: x</p>", None)
    kept, rejects = cleaning.cleaning_rejects(cleaning.clean_corpus(df))
    assert [r["id"] for r in kept.collect()] == [0]
    assert rows(rejects.select("id", "reason"), "id") == [
        (1, "no text"),
        (2, "only unwanted blocks"),
        (3, "no content"),
    ]


def test_needs_cleaning_and_its_inverse(spark):
    df = page(spark, "<HTML><p>x</p>", "<p>x</p>")
    assert [r["id"] for r in cleaning.needs_cleaning(df).collect()] == [1]
    assert [r["id"] for r in cleaning.needs_cleaning(df, done=True).collect()] == [0]


def test_provenance_round_trip_with_an_apostrophe(spark):
    source = {"url": "https://x.org/it's/1", "category": "world", "scraped_date": "2026-06-19T08:30:00.123456"}
    html = f'<p>text</p>\n<p class="metadata_footer">Source: {source!r}</p>'
    df = page(spark, html, "<p>none</p>")
    found = rows(cleaning.parse_provenance(df).select("id", "source.url", "source.category",
                 F.col("source.scraped_date").cast("string")), "id")
    assert found == [
        (0, "https://x.org/it's/1", "world", "2026-06-19 08:30:00.123456"),
        (1, None, None, None),
    ]
    assert cleaning.clean_corpus(df).where("id = 0").first()["body"] == "<p>text</p>"


def test_long_pages_are_processed_whole(spark):
    """Twenty thousand blocks, with repeats: the last ones count like the first."""
    html = "".join(f"<p>line {i % 15000}</p>" for i in range(20000)) + "<p>the end</p>"
    row = cleaning.clean_corpus(page(spark, html)).first()
    assert (row["n_raw"], row["n_repeated"], row["n_blocks"]) == (20001, 5000, 15001)
    assert row["body"].endswith("<p>the end</p>")


def test_cleaning_does_not_shuffle_and_runs_once(spark):
    df = cleaning.clean_corpus(page(spark, "<p>x</p>")).where("n_blocks > 0")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") == 1
    exploded = cleaning.explode_blocks(cleaning.split_blocks(page(spark, "<p>x</p>"), "html"))
    assert exploded._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
