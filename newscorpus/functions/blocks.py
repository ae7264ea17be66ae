"""Column expressions over the block array of one page: array<struct<pos, tag, text>>.

All steps are array functions inside the page's own row, and nest into one expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newscorpus.functions import markup

# Longer word lists are one array in the plan instead of an expression per word.
MAX_UNROLLED_WORDS = 50


def cut(marked: Column, tags: list[str]) -> Column:
    """Blocks of marked text, blank ones included.

    ``tag`` is the element that opened the block if it is one of ``tags``; text that follows a
    closing tag, any other block-level tag, or nothing at all, has the tag ``''``.
    """

    def block(piece: Column, pos: Column) -> Column:
        name = F.lower(F.substring_index(piece, markup.NAME_END, 1))
        return F.struct(
            pos.cast("bigint").alias("pos"),
            F.when(name.isin(tags), name).otherwise(F.lit("")).alias("tag"),
            F.trim(F.substring_index(piece, markup.NAME_END, -1)).alias("text"),
        )

    return F.transform(F.split(marked, markup.BLOCK), block)


def nonempty(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["text"] != "")


def tagged_only(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["tag"] != "")


def unlisted(blocks: Column, words: list[str], mode: str = "contains") -> Column:
    return F.filter(blocks, lambda b: ~listed(b["text"], words, mode))


def listed(text: Column, words: list[str], mode: str = "contains") -> Column:
    """Whether a text holds (``contains``) or is (``equals``) one of the words."""
    if mode == "equals":
        return text.isin(words)
    if mode != "contains":
        raise ValueError(f"unknown mode {mode!r}")
    if len(words) > MAX_UNROLLED_WORDS:
        return F.exists(F.array(*map(F.lit, words)), lambda word: F.contains(text, word))
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def first_copies(blocks: Column) -> Column:
    """The first block of each text.

    Sorting by (text, pos) puts repeats side by side, so a page costs n log n, not n squared.
    """

    def keep_first(by_text: Column) -> Column:
        first = F.filter(
            by_text, lambda b, i: ~F.get(by_text, i - 1)["text"].eqNullSafe(b["text"])
        )
        return F.sort_array(F.transform(first, lambda b: F.struct(b["pos"], b["tag"], b["text"])))

    return markup.let(
        F.sort_array(F.transform(blocks, lambda b: F.struct(b["text"], b["pos"], b["tag"]))),
        keep_first,
    )


def simplified(blocks: Column, headings: list[str]) -> Column:
    """Headings become ``h2``, everything else ``p``."""
    return F.transform(
        blocks,
        lambda b: F.struct(
            b["pos"],
            F.when(b["tag"].isin(headings), F.lit("h2")).otherwise(F.lit("p")).alias("tag"),
            b["text"],
        ),
    )


def joined(blocks: Column, escape: bool) -> Column:
    """One tagged line per block."""

    def line(b: Column) -> Column:
        text = markup.escape(b["text"]) if escape else b["text"]
        return F.concat(F.lit("<"), b["tag"], F.lit(">"), text, F.lit("</"), b["tag"], F.lit(">"))

    return F.array_join(F.transform(blocks, line), "\n")
