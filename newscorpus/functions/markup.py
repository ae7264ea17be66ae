"""Column expressions over HTML text, all in the JVM.

There is no tree parser. Text is cut at block boundaries instead of matching open and close
pairs, so unclosed paragraphs do no harm; containers that must match their own closing tag are
found by counting depth over the tags of the page.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newscorpus import values

# Control characters that cannot occur in decoded text: block start, end of its tag name.
BLOCK = "\u0001"
NAME_END = "\u0002"
# Whitespace other than a lone space, which may stay as it is.
WHITESPACE = r"[ \t\n\r\f\x0B\x{A0}]{2,}|[\t\n\r\f\x0B\x{A0}]"
# What stands between a tag's name and its end. Quoted values may hold ">"; quotes elsewhere are
# plain characters. Possessive throughout, so long attributes neither recurse nor backtrack.
ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
ONE_ATTR = r"""(?:\s*+[^\s=>]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)"""
ANY_TAG = rf"</?[a-zA-Z!?]{ATTRS}>"

# Names decoded in place; anything else goes through the standard library's table.
# The ampersand comes last, so that text is decoded once.
COMMON_ENTITIES = {
    "&nbsp;": "\u00a0",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&#039;": "'",
    "&#x27;": "'",
    "&apos;": "'",
    "&copy;": "©",
    "&middot;": "·",
    "&hellip;": "…",
    "&ndash;": "–",
    "&mdash;": "—",
    "&lsquo;": "‘",
    "&rsquo;": "’",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&amp;": "&",
}
# Looked for one by one; the other common ones only where a first look finds any.
EVERYDAY_ENTITIES = ["&nbsp;", "&lt;", "&gt;", "&quot;", "&#39;", "&amp;"]
UNCOMMON_ENTITY = (
    "&(?!(?:" + "|".join(name[1:-1] for name in COMMON_ENTITIES) + ");)[#A-Za-z]"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it.

    A column of its own would do the same, but is written out and read back in between.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def alternatives(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def drop_elements(html: Column, tags: list[str] | None = None) -> Column:
    """Comments, the provenance footer and whole elements go, in one pass over the page."""
    tags = values.DROP_TAGS if tags is None else tags
    # Every alternative starts at "<": the regex engine skips ahead to it.
    pattern = (
        r"(?is)<(?:!--.*?--"
        rf'|p class="{values.FOOTER_CLASS}">Source:.*?</p'
        rf"|({alternatives(tags)})(?:\s{ATTRS})?>.*?</\1\s*)>"
    )
    return F.regexp_replace(html, pattern, " ")


def visible(html: Column) -> Column:
    """The page without what a parser never shows as elements: comments, scripts and styles."""
    pattern = rf"(?is)<(?:!--.*?(?:--|\z)|(script|style)(?:\s{ATTRS})?>.*?</\1\s*)(?:>|\z)"
    return F.regexp_replace(html, pattern, " ")


def article_or_all(html: Column, tag: str = "article") -> Column:
    """Inside of the article element (first open tag to last close tag), else the text as it is."""
    return F.regexp_replace(
        html, rf"(?is)^.*?<{tag}(?:\s{ATTRS})?>(.*)</{tag}\s*>.*$", "$1"
    )


def mark_blocks(content: Column, tags: list[str]) -> Column:
    """Block-level tags become marks, inline tags a space; both in one pass."""
    names = alternatives(sorted({*tags, *values.BLOCK_LEVEL}))
    boundary = rf"(?i)<(/?(?:{names}))(?:[\s/]{ATTRS})?>|{ANY_TAG}"
    content = _whole_headings(content)
    taken = F.contains(content, F.lit(BLOCK)) | F.contains(content, F.lit(NAME_END))
    free = F.when(taken, F.translate(content, BLOCK + NAME_END, "")).otherwise(content)
    marked = F.regexp_replace(free, boundary, f"{BLOCK}$1{NAME_END}")
    return F.concat(
        F.lit(NAME_END), F.replace(marked, F.lit(BLOCK + NAME_END), F.lit(" "))
    )


def _whole_headings(content: Column) -> Column:
    """Block-level tags inside an open heading become a space: a heading is one block.

    A heading that is never closed holds nothing. Only pages with such tags are rewritten.
    """
    inner = alternatives([t for t in values.BLOCK_LEVEL if not re.fullmatch("h[1-6]", t)])
    heading = r"/?h[1-6][\s/>]"
    nested = rf"(?i)<h[1-6](?=[\s/>]){ATTRS}>(?:[^<]++|<(?!{heading}|/?(?:{inner})[\s/>]))*+</?(?:{inner})[\s/>]"
    tag = rf"(?i)</?(?:{inner})(?:[\s/]{ATTRS})?>(?=(?:[^<]++|<(?!{heading}))*+</h[1-6])"
    return F.when(F.rlike(content, F.lit(nested)), F.regexp_replace(content, tag, " ")).otherwise(content)


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, WHITESPACE, " ")


def strip_tags(fragment: Column) -> Column:
    return F.regexp_replace(fragment, ANY_TAG, " ")


def tidy(text: Column) -> Column:
    """Whitespace collapsed and trimmed."""
    return F.trim(collapse(text))


def decode_common(text: Column) -> Column:
    """Decode the common entities; a run of no-break spaces becomes one space."""
    rare = [e for e in COMMON_ENTITIES if e not in EVERYDAY_ENTITIES]
    # The ampersand stands outside the alternatives, so that the search skips from one to the next.
    any_rare = "&(?:" + "|".join(e[1:] for e in rare) + ")"
    decoded = F.when(F.rlike(text, F.lit(any_rare)), _replaced(text, rare)).otherwise(text)
    decoded = _replaced(decoded, EVERYDAY_ENTITIES)
    return (
        F.when(F.contains(text, F.lit("&")), join_nbsp(decoded))
        .when(F.contains(text, F.lit("\u00a0")), join_nbsp(text))
        .otherwise(text)
    )


def _replaced(text: Column, entities: list[str]) -> Column:
    for entity in entities:
        text = F.replace(text, F.lit(entity), F.lit(COMMON_ENTITIES[entity]))
    return text


def join_nbsp(text: Column) -> Column:
    return F.regexp_replace(text, r"(?:\x{A0}|&nbsp;)+", " ")


@F.pandas_udf(StringType())
def decode_any(text: pd.Series) -> pd.Series:
    """Every entity the HTML standard names. Callers pass null for rows that need none of it."""
    return text.map(_html.unescape, na_action="ignore")


def escape(text: Column) -> Column:
    """Escape for markup, quotes included; the ampersand goes first."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def element_text(html: Column, tag: str) -> Column:
    """Inside of the first element of that name, '' when there is none; unclosed runs to the end."""
    return F.regexp_extract(html, rf"(?is)<{tag}(?:\s{ATTRS})?>(.*?)(?:</{tag}|\z)", 1)


def has_element(html: Column, tag: str) -> Column:
    return F.rlike(html, F.lit(rf"(?i)<{tag}[\s/>]"))


def body_text(body: Column) -> Column:
    """Plain text of an assembled body: the tag pair around each line goes."""
    return F.regexp_replace(body, r"(?md)^<(?:h2|p)>|</(?:h2|p)>$", "")


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute from the inside of an open tag, '' when absent."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.concat(*[F.regexp_extract(attrs, pattern, i) for i in (1, 2, 3)])


def class_pattern(classes: list[str], exact: bool) -> str:
    """Regex for a ``class`` attribute naming one of ``classes``, as a whole word or anywhere."""
    names = alternatives(classes)
    if exact:
        double = rf'"(?:[^"]*\s)?(?:{names})(?:\s[^"]*)?"'
        single = rf"'(?:[^']*\s)?(?:{names})(?:\s[^']*)?'"
        bare = rf"(?:{names})(?=[\s>/])"
    else:
        double = rf'"[^"]*(?:{names})[^"]*"'
        single = rf"'[^']*(?:{names})[^']*'"
        bare = rf"""[^\s>"']*(?:{names})"""
    return rf"\sclass\s*=\s*(?:{double}|{single}|{bare})"


def split_at_tags(html: Column) -> Column:
    """Pieces of a page with every tag a piece of its own, always at an odd index."""
    return F.split(
        F.regexp_replace(html, rf"(</?[a-zA-Z]{ATTRS}>)", f"{BLOCK}$1{BLOCK}"), BLOCK
    )


VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
             "track", "wbr"]


def container_ranges(pieces: Column, classes: list[str], exact: bool) -> Column:
    """Index ranges (open tag, close tag) of the outermost elements with one of the classes.

    One pass with a depth counter for the element's own name. An element never closed runs to
    the end of the page.
    """
    wanted = "(?i)" + class_pattern(classes, exact)
    spans = "array<struct<s:int,e:int>>"
    zero = F.struct(
        F.lit(0).alias("i"),
        F.lit("").alias("name"),
        F.lit(0).alias("depth"),
        F.lit(0).alias("start"),
        F.array().cast(spans).alias("found"),
    )

    def span(start: Column, end: Column) -> Column:
        return F.array(F.struct(start.alias("s"), end.alias("e")))

    def step(acc: Column, piece: Column) -> Column:
        i, name, depth = acc["i"], acc["name"], acc["depth"]
        is_tag = i % 2 == 1
        closes = F.startswith(piece, F.lit("</"))
        tag = F.lower(F.regexp_extract(piece, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
        outside = name == ""
        enters = is_tag & outside & ~closes & F.rlike(piece, F.lit(wanted))
        void = enters & tag.isin(VOID_TAGS)
        counts = is_tag & ~outside & (tag == name)
        leaves = counts & closes & (depth == 1)
        return F.struct(
            (i + 1).alias("i"),
            F.when(leaves | void, F.lit("")).when(enters, tag).otherwise(name).alias("name"),
            F.when(enters, F.lit(1))
            .when(counts, depth + F.when(closes, F.lit(-1)).otherwise(F.lit(1)))
            .otherwise(depth)
            .alias("depth"),
            F.when(enters, i).otherwise(acc["start"]).alias("start"),
            F.when(leaves, F.concat(acc["found"], span(acc["start"], i)))
            .when(void, F.concat(acc["found"], span(i, i)))
            .otherwise(acc["found"])
            .cast(spans)
            .alias("found"),
        )

    def close_last(acc: Column) -> Column:
        return (
            F.when(acc["name"] == "", acc["found"])
            .otherwise(F.concat(acc["found"], span(acc["start"], acc["i"])))
            .cast(spans)
        )

    return F.aggregate(pieces, zero, step, close_last)


def outside_ranges(pieces: Column, ranges: Column) -> Column:
    """The page without the given ranges."""
    return F.array_join(
        F.filter(
            pieces, lambda _, i: ~F.exists(ranges, lambda r: (i >= r["s"]) & (i <= r["e"]))
        ),
        "",
    )


def first_of_class(html: Column, classes: list[str], exact: bool) -> tuple[Column, Column]:
    """Name of the first element with one of the classes, '' without one, and all that follows
    its open tag."""
    opening = rf"(?is)<([a-z][a-z0-9]*)(?=\s){ONE_ATTR}*?{class_pattern(classes, exact)}{ATTRS}>(.*)"
    return F.regexp_extract(html, opening, 1), F.regexp_extract(html, opening, 2)


def until_closed(name: Column, rest: Column) -> Column:
    """What an element encloses, given its name and the text after its open tag.

    The text is split before every tag of that name only, and the pieces are taken for as long
    as the element is open: to the end of the page if it is never closed.
    """

    def step(acc: Column, piece: Column) -> Column:
        change = (
            F.when(acc["n"] == 0, 0).when(F.startswith(piece, F.lit("</")), -1).otherwise(1)
        )
        depth = F.when(acc["depth"] > 0, acc["depth"] + change).otherwise(0)
        return F.struct(
            (acc["n"] + F.when(depth > 0, 1).otherwise(0)).alias("n"), depth.alias("depth")
        )

    zero = F.struct(F.lit(0).alias("n"), F.lit(1).alias("depth"))

    def take(pieces: Column) -> Column:
        taken = F.aggregate(pieces, zero, step, lambda acc: acc["n"])
        return F.substring(F.array_join(F.slice(pieces, F.lit(1), taken), ""), 2, 2147483647)

    # The blank in front keeps the first piece from being a tag.
    same_name = F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"[\s>/])"))
    inner = let(F.split(F.concat(F.lit(" "), rest), same_name), take)
    return F.when(name.isin(VOID_TAGS), F.lit("")).when(name != "", inner)
