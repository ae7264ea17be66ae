"""Main content by text density, for pages whose markup does not say where the article is.

Map-only, like all cleaning: a page's blocks stay an array in its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newscorpus import values
from newscorpus.functions import density, markup
from newscorpus.operators.cleaning import BLOCKS, mark_blocks


def mark_dense(df: DataFrame, html: str, tags: list[str] | None = None) -> DataFrame:
    """Replace ``html`` by ``_marked``: text with block and link boundaries, decoded."""
    content = markup.article_or_all(markup.drop_elements(F.col(html)))
    df = df.withColumn("_content", density.mark_links(content)).drop(html)
    return mark_blocks(df, "_content", values.CLEAN_TAGS if tags is None else tags).drop("_content")


def _scored(weights: density.Weights) -> Column:
    return density.scored(density.balance_links(markup.collapse(F.col("_marked"))), values.CLEAN_TAGS, weights)


def score_blocks(df: DataFrame, html: str = "html", weights: density.Weights = density.Weights()) -> DataFrame:
    """Add ``blocks``: array of (pos, tag, text, n_chars, link_chars, n_marks, step, score)."""
    return mark_dense(df, html).withColumn(BLOCKS, _scored(weights)).drop("_marked")


def main_run(df: DataFrame, html: str = "html", weights: density.Weights = density.Weights()) -> DataFrame:
    """Replace the page by ``blocks`` (pos, tag, text), those of its densest run, and ``run_score``.

    Headings right before the run belong to it. A page without any block worth its cost, an empty
    or a null one, has no blocks and a score of 0 (null: null).
    """

    def record(blocks: Column) -> Column:
        def chosen(run: Column) -> Column:
            kept = density.run_blocks(blocks, run, values.CLEAN_HEADINGS)
            plain = F.transform(kept, lambda b: F.struct(b["pos"], b["tag"], b["text"]))
            return F.struct(plain.alias(BLOCKS), run["score"].alias("run_score"))

        return markup.let(density.best_run(blocks, weights), chosen)

    df = mark_dense(df, html)
    # An outer generator, which neither later filters nor the optimizer's own pass: computed once.
    return df.select(*[c for c in df.columns if c != "_marked"], F.inline_outer(F.array(markup.let(_scored(weights), record))))
