"""Documents to packed training sequences, in five stages over the whole table.

Each stage takes (spark, docs, sf_dir) and returns documents for the next; the last one returns
pieces of sequences. ``run`` stores every stage's result in the shared folder and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import language, packing, pii, repeats, sigtree
from llm.common import free_prefix, small_batches, stored, table

#: A document whose words are less certain to be of any language has no language.
LEAST_CERTAINTY = 0.4
#: Passages of so many words are repeats; words of fewer than 4 letters with their blank on average are not seen.
REPEATED_WORDS, REPEATED_BYTES = 50, 200


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, and those whose words fit no language with LEAST_CERTAINTY.

    Code-switched texts stay, however many languages they have, and all with letters if no document
    has a label to learn from.
    """
    small_batches(spark)
    model = language.fit(docs.where(~language.held_out()))
    prefix = free_prefix(docs.columns)
    found = language.predict(docs, model, certainty=True, prefix=prefix)
    return found.where(F.col(f"{prefix}certainty") >= LEAST_CERTAINTY).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest doc_id of each group of near duplicates."""
    small_batches(spark)
    return sigtree.first_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out passages of REPEATED_WORDS words or more that occur more than once. No row is dropped."""
    small_batches(spark)
    return repeats.without_repeats(docs, REPEATED_BYTES, REPEATED_WORDS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in brackets in place of each span of personal data."""
    small_batches(spark)
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, mixed by source."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: No SQL can express the learned stage and the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
