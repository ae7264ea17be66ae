"""Title, author and date of an article page, and its rendering as a page of its own."""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newscorpus import values
from newscorpus.functions import markup
from newscorpus.operators import cleaning
from newscorpus.operators.discovery import scope_container

# Date formats tried in turn on the text of a date element.
DATE_FORMATS = ["MMMM d, yyyy", "d MMMM yyyy", "d MMMM, yyyy", "yyyy/MM/dd", "dd/MM/yyyy"]

# Digits of scripts whose months a caller may name: Gujarati, Devanagari.
NATIVE_DIGITS = "".join(chr(zero + n) for zero in (0x0AE6, 0x0966) for n in range(10))


def _readable(df: DataFrame, column: str) -> DataFrame:
    """Markup fragment to text."""
    df = df.withColumn(column, markup.strip_tags(F.col(column)))
    return cleaning.decode_entities(df, column).withColumn(column, markup.tidy(F.col(column)))


def _seen(html: str, raw: bool) -> Column:
    """``raw`` pages lose comments, scripts and styles first; others have lost them."""
    return markup.visible(F.col(html)) if raw else F.col(html)


def article_title(
    df: DataFrame, html: str = "html", default: str = values.DEFAULT_TITLE, raw: bool = True
) -> DataFrame:
    """Text of the first ``h1``, even when blank; the default only when there is none."""
    seen = _seen(html, raw)
    found = F.when(markup.has_element(seen, "h1"), markup.element_text(seen, "h1"))
    return _readable(df.withColumn("title", found), "title").withColumn(
        "title", F.coalesce("title", F.lit(default))
    )


def _first_of_class(
    df: DataFrame, html: str, classes: list[str], out: str, raw: bool
) -> DataFrame:
    df = df.withColumn(out, _seen(html, raw))
    return scope_container(df, out, classes, exact=False, fallback=False, raw=False)


def article_author(
    df: DataFrame,
    html: str = "html",
    default: str = values.DEFAULT_AUTHOR,
    limit: int = values.AUTHOR_LIMIT,
    raw: bool = True,
) -> DataFrame:
    """Text of the first element with an author class, if it is short enough to be a name."""
    df = _readable(_first_of_class(df, html, values.AUTHOR_CLASSES, "author", raw), "author")
    fits = F.length("author").between(1, limit - 1)
    return df.withColumn("author", F.when(fits, F.col("author")).otherwise(F.lit(default)))


def article_date(
    df: DataFrame,
    html: str = "html",
    default: str = values.DEFAULT_DATE,
    months: dict[str, int] | None = None,
    raw: bool = True,
) -> DataFrame:
    """Text of the first ``time`` element, else of a date class, else the default; and typed.

    The typed date is that of the element's ``datetime`` attribute, else of the text; ``months``
    maps further month names to their numbers.
    """
    seen = _seen(html, raw)
    df = _first_of_class(df, html, values.DATE_CLASSES, "_dated", raw)
    timed = markup.has_element(seen, "time")
    found = F.when(timed, markup.element_text(seen, "time")).otherwise(F.col("_dated"))
    stamp = F.when(
        timed,
        markup.attribute(F.regexp_extract(seen, rf"(?is)<time(\s{markup.ATTRS})?>", 1), "datetime"),
    )
    df = df.withColumn("_stamp", stamp).withColumn("date_text", found).drop("_dated")
    df = _readable(df, "date_text")
    return (
        df.withColumn("date_text", F.coalesce("date_text", F.lit(default)))
        .withColumn(
            "published_at",
            F.coalesce(parse_date(F.trim("_stamp")), parse_date(F.col("date_text"), months)),
        )
        .drop("_stamp")
    )


def parse_date(text: Column, months: dict[str, int] | None = None) -> Column:
    """A date in one of DATE_FORMATS, with English month names, or further ones by number."""
    for name, number in (months or {}).items():
        text = F.replace(text, F.lit(name), F.lit(calendar.month_name[number]))
    if months:
        text = F.translate(text, NATIVE_DIGITS, "0123456789" * (len(NATIVE_DIGITS) // 10))
    tries = [F.try_to_timestamp(text)]
    tries += [F.try_to_timestamp(text, F.lit(fmt)) for fmt in DATE_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def article_records(
    df: DataFrame,
    html: str = "html",
    words: list[str] | None = None,
    mode: str = "contains",
    months: dict[str, int] | None = None,
) -> DataFrame:
    """Cleaned articles with title, author, date_text and published_at, in one map-only pass."""
    df = df.withColumn("_seen", markup.visible(F.col(html)))
    df = article_author(article_title(df, "_seen", raw=False), "_seen", raw=False)
    df = article_date(df, "_seen", months=months, raw=False).drop("_seen")
    return cleaning.clean_corpus(df, html, words, mode)


def layout_body(
    df: DataFrame, html: str = "html", words: list[str] | None = None
) -> DataFrame:
    """Escaped body lines of the content container, headings as ``h2``; repeats are kept."""
    words = values.LAYOUT_BLOCKLIST if words is None else words
    df = df.withColumn("_scope", markup.drop_elements(F.col(html), ["script", "style"]))
    df = scope_container(df, "_scope", values.CONTENT_CLASSES, exact=False, raw=False)
    df = cleaning.split_blocks(df, "_scope", values.LAYOUT_TAGS, loose_text=False).drop("_scope")
    df = cleaning.drop_blocklisted(cleaning.drop_empty_blocks(df), words)
    return cleaning.assemble_articles(
        cleaning.tag_blocks(df, values.LAYOUT_HEADINGS), escape=True
    ).drop(cleaning.BLOCKS)


def render_articles(df: DataFrame, html: str = "html") -> DataFrame:
    """Add ``page``: a page with title, author and date above the body. The source goes."""
    # The footer stays for now: it is the layout's to drop.
    df = df.withColumn(html, markup.visible(F.col(html)))
    df = article_date(
        article_author(article_title(df, html, raw=False), html, raw=False), html, raw=False
    )
    df = layout_body(df, html)

    def row(label: str, value: str) -> Column:
        return F.concat(F.lit(f"<p><b>{label}:</b> "), markup.escape(F.col(value)), F.lit("</p>\n"))

    return df.withColumn(
        "page",
        F.concat(
            F.lit('<!DOCTYPE html>\n<html lang="gu">\n<head><meta charset="UTF-8"></head>\n<body>\n'),
            F.lit(f"<header>\n<h1>{values.HEADER_TITLE}"),
            markup.escape(F.col("title")),
            F.lit("</h1>\n"),
            row(values.HEADER_AUTHOR, "author"),
            row(values.HEADER_DATE, "date_text"),
            F.lit("</header>\n"),
            F.col("body"),
            F.lit("\n</body>\n</html>"),
        ),
    ).drop(html)
