"""Which blocks of a page are its article: scores from text density, and the best run of blocks.

Each block is worth its text outside of links and its sentence marks, less its link text and a fixed
cost. Blocks in other containers cost a toll to go on to. The article is the run of blocks with the
greatest sum, found in one pass over the page's own array of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from newscorpus import values
from newscorpus.functions import markup

# Control characters around link text, next to the two that bound blocks.
LINK_OPEN, LINK_CLOSE = "\u0003", "\u0004"


@dataclass(frozen=True)
class Weights:
    """What a block is worth: characters, sentence marks, link characters, being a block at all, and
    each level of containers between it and the block before."""

    char: int = 1
    mark: int = 10
    link: int = 3
    block: int = 40
    level: int = 15


def mark_links(html: Column) -> Column:
    """Anchor tags become control characters; those in the text already go."""
    free = F.translate(html, LINK_OPEN + LINK_CLOSE, "")
    opened = F.regexp_replace(free, rf"(?i)<a(?:\s{markup.ATTRS})?>", LINK_OPEN)
    return F.regexp_replace(opened, r"(?i)</a\s*>", LINK_CLOSE)


def balance_links(marked: Column) -> Column:
    """Link marks in pairs within each block of marked text.

    A link that goes on over blocks is one in each of them; one that is never closed ends with its
    block, at the next link at the latest.
    """

    def piece(p: Column, i: Column) -> Column:
        closed = F.contains(p, F.lit(LINK_CLOSE))
        inside = F.when(closed, F.substring_index(p, LINK_CLOSE, 1)).otherwise(F.substring_index(p, markup.BLOCK, 1))
        rest = F.replace(F.substr(p, F.length(inside) + 1), F.lit(LINK_CLOSE), F.lit(""))
        again = F.regexp_replace(inside, f"({markup.BLOCK}[^{markup.NAME_END}]*{markup.NAME_END})", f"{LINK_CLOSE}$1{LINK_OPEN}")
        return F.when(i == 0, F.replace(p, F.lit(LINK_CLOSE), F.lit(""))).otherwise(
            F.concat(F.lit(LINK_OPEN), again, F.lit(LINK_CLOSE), rest)
        )

    return F.array_join(F.transform(F.split(marked, LINK_OPEN), piece), "")


def scored(marked: Column, tags: list[str], weights: Weights = Weights()) -> Column:
    """Blocks of balanced text: array of (pos, tag, text, n_chars, link_chars, n_marks, step, score).

    ``step`` is 1 where a container opens, -1 where one closes. Blank blocks are worth nothing.
    """

    def block(piece: Column, pos: Column) -> Column:
        raw = F.substring_index(piece, markup.NAME_END, -1)
        marks = F.contains(raw, F.lit(LINK_OPEN)) | F.contains(raw, F.lit(LINK_CLOSE))
        text = F.trim(markup.collapse(F.when(marks, F.translate(raw, LINK_OPEN + LINK_CLOSE, "")).otherwise(raw)))
        plain = F.trim(markup.collapse(F.regexp_replace(raw, f"{LINK_OPEN}[^{LINK_CLOSE}]*{LINK_CLOSE}", " ")))
        # Each of these is used several times below.
        parts = F.struct(
            F.lower(F.substring_index(piece, markup.NAME_END, 1)).alias("name"),
            text.alias("text"),
            F.when(marks, F.length(plain)).alias("n_plain"),
        )

        def features(parts: Column) -> Column:
            name, text = parts["name"], parts["text"]
            container = F.regexp_replace(name, "^/", "").isin(values.CONTAINERS)
            step = F.when(~container, 0).when(F.startswith(name, F.lit("/")), -1).otherwise(1)
            n_chars = F.length(text)
            link_chars = F.greatest(n_chars - F.coalesce(parts["n_plain"], n_chars), F.lit(0))
            n_marks = n_chars - F.length(F.translate(text, values.SENTENCE_MARKS, ""))
            worth = weights.char * (n_chars - link_chars) + weights.mark * n_marks - weights.link * link_chars - weights.block
            return F.struct(
                pos.cast("bigint").alias("pos"),
                F.when(name.isin(tags), name).otherwise(F.lit("")).alias("tag"),
                text.alias("text"),
                n_chars.cast("bigint").alias("n_chars"),
                link_chars.cast("bigint").alias("link_chars"),
                n_marks.cast("bigint").alias("n_marks"),
                step.cast("bigint").alias("step"),
                F.when(text == "", 0).otherwise(worth).cast("bigint").alias("score"),
            )

        return markup.let(parts, features)

    return F.transform(F.split(marked, markup.BLOCK), block)


def best_run(blocks: Column, weights: Weights = Weights()) -> Column:
    """(score, first, last) of the run of blocks with the greatest sum above 0; first is null without one.

    The sum has the scores of the run's blocks with text, less the toll for the levels between each
    and the next. Of equal sums the run that ends first counts, then the one that begins last.
    """
    zero = F.struct(
        *[F.lit(0).cast("bigint").alias(n) for n in ("sum", "start", "best", "jump")],
        *[F.lit(None).cast("bigint").alias(n) for n in ("first", "last")],
    )

    def step(acc: Column, b: Column) -> Column:
        jump = acc["jump"] + b["step"]
        kept = acc["sum"] - weights.level * F.abs(jump)
        goes_on = kept > 0
        total = F.greatest(kept, F.lit(0)) + b["score"]
        start = F.when(goes_on, acc["start"]).otherwise(b["pos"])
        better = total > acc["best"]
        found = F.struct(
            total.alias("sum"),
            start.alias("start"),
            F.greatest(total, acc["best"]).alias("best"),
            F.lit(0).cast("bigint").alias("jump"),
            F.when(better, start).otherwise(acc["first"]).alias("first"),
            F.when(better, b["pos"]).otherwise(acc["last"]).alias("last"),
        )
        blank = F.struct(acc["sum"].alias("sum"), acc["start"].alias("start"), acc["best"].alias("best"), jump.alias("jump"),
                         acc["first"].alias("first"), acc["last"].alias("last"))
        return F.when(b["text"] == "", blank).otherwise(found)

    return F.aggregate(blocks, zero, step, lambda acc: F.struct(acc["best"].alias("score"), acc["first"].alias("first"), acc["last"].alias("last")))


def densest(blocks: Column, headings: list[str], weights: Weights = Weights()) -> Column:
    """Scored blocks of the best run, as (pos, tag, text)."""

    def chosen(found: Column) -> Column:
        kept = run_blocks(found, best_run(found, weights), headings)
        return F.transform(kept, lambda b: F.struct(b["pos"], b["tag"], b["text"]))

    return markup.let(blocks, chosen)


def run_blocks(blocks: Column, run: Column, headings: list[str]) -> Column:
    """The blocks with text of a run, and the headings right before it that are no links."""

    def title(b: Column) -> Column:
        return b["tag"].isin(headings) & (b["link_chars"] * 2 <= b["n_chars"])

    def take(inside: Column) -> Column:
        before = F.filter(inside, lambda b: b["pos"] < run["first"])
        other = F.array_max(F.transform(F.filter(before, lambda b: ~title(b)), lambda b: b["pos"]))
        since = F.coalesce(other, F.lit(-1).cast("bigint"))
        return F.filter(inside, lambda b: (b["pos"] > since) & (b["pos"] <= run["last"]))

    with_text = F.filter(blocks, lambda b: b["text"] != "")
    return F.when(run["first"].isNull(), F.slice(blocks, 1, 0)).otherwise(markup.let(with_text, take))
