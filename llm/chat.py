"""Perspective rotation: each speaker of a dialogue in turn becomes the assistant.

DataFrame functions only. A dialogue is not gathered in one row: messages get their place and
their character offsets from distributed running sums, and the text comes out in parts of
bounded size, so a conversation that holds a third of all rows meets in no task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import stored, table
from newscorpus.operators.ordering import with_positions

#: Characters of rendered dialogue per part; a message belongs to the part it begins in.
PART_CHARS = 32_768

OWN_HEAD, HEAD, NAMED, END = "<|assistant|>\n", "<|user|>\n", ": ", "<|end|>\n"


def rotate(messages: DataFrame) -> DataFrame:
    """One row per (conversation, perspective, message): conv_id, perspective, position, speaker,
    chat_role, rendered, start, mask_start.

    Every distinct speaker (``role``) of a conversation is a perspective. Its own messages are
    rendered as ``<|assistant|>`` and trained on from ``mask_start`` (text and end mark), others as
    ``<|user|>`` with the speaker's name and a null ``mask_start``. Offsets count characters within
    the perspective. Messages are ordered by turn (null first), speaker, then the text's digest;
    equal rows stay, in any order, since they read alike. A null role is the speaker ``unknown``; a
    null text is empty; rows with a null conv_id are one conversation. Other columns are ignored.
    """
    kept = stored(
        messages.select(
            "conv_id",
            "turn",
            F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.monotonically_increasing_id().alias("_id"),
        ),
        "messages",
    )
    narrow = kept.select("conv_id", "turn", "speaker", "_id", F.md5("text").alias("_digest"), F.char_length("text").alias("_chars"))
    speakers = narrow.select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    turned = narrow.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "_digest",
        "_id",
        (F.col("_chars") + F.when(own, len(OWN_HEAD)).otherwise(F.char_length("speaker") + len(HEAD) + len(NAMED)) + len(END))
        .cast("bigint")
        .alias("_size"),
    )
    placed = with_positions(
        turned,
        ["conv_id", "perspective"],
        [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("_digest"), F.col("_id")],
        first=0,
        running={"_size": "start"},
    ).drop("turn", "_digest", "_size")
    return placed.join(kept.select("_id", "text"), "_id").select(
        "conv_id",
        "perspective",
        "position",
        "speaker",
        F.when(own, "assistant").otherwise("user").alias("chat_role"),
        F.when(own, F.concat(F.lit(OWN_HEAD), "text", F.lit(END)))
        .otherwise(F.concat(F.lit(HEAD), "speaker", F.lit(NAMED), "text", F.lit(END)))
        .alias("rendered"),
        "start",
        F.when(own, F.col("start") + len(OWN_HEAD)).alias("mask_start"),
    )


def render(messages: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Rotated dialogues as text: conv_id, perspective, part, n_messages, text, mask.

    Parts in order make the whole dialogue; one ends with the first message that begins beyond
    its ``part_chars``. ``mask`` is an array of (start, end) in characters of the part's text.
    """
    at = F.floor(F.col("start") / part_chars).cast("bigint")
    piece = F.struct("position", "rendered", "start", "mask_start")
    parts = (
        rotate(messages)
        .groupBy("conv_id", "perspective", at.alias("part"))
        .agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
    )
    first = F.col("_pieces")[0]["start"]
    own = F.filter("_pieces", lambda p: p["mask_start"].isNotNull())
    return parts.select(
        "conv_id",
        "perspective",
        "part",
        F.size("_pieces").cast("bigint").alias("n_messages"),
        F.array_join(F.transform("_pieces", lambda p: p["rendered"]), "").alias("text"),
        F.transform(
            own,
            lambda p: F.struct(
                (p["mask_start"] - first).alias("start"),
                (p["start"] + F.char_length(p["rendered"]) - first).alias("end"),
            ),
        ).alias("mask"),
    )


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every speaker's perspective, with loss masks as start:end lists."""
    parts = render(table(spark, sf_dir, "conversations"))
    return parts.withColumn(
        "mask",
        F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ","),
    )


OP2_SQL = f"""
WITH named AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
turned AS (
  SELECT n.*, s.perspective, n.speaker = s.perspective AS own,
    CASE WHEN n.speaker = s.perspective THEN '{OWN_HEAD}' || text || '{END}'
      ELSE '{HEAD}' || n.speaker || '{NAMED}' || text || '{END}' END AS rendered
  FROM named n JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM named) s
    ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, row_number() OVER w AS position, sum(length(rendered)) OVER w - length(rendered) AS start FROM turned
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(text)
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
parts AS (
  SELECT *, start // {PART_CHARS} AS part,
    min(start) OVER (PARTITION BY conv_id, perspective, start // {PART_CHARS}) AS first FROM placed)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_messages,
  string_agg(rendered, '' ORDER BY position) AS text,
  coalesce(string_agg((start - first + {len(OWN_HEAD)})::BIGINT || ':' || (start - first + length(rendered))::BIGINT,
    ',' ORDER BY position) FILTER (own), '') AS mask
FROM parts GROUP BY ALL
"""
