"""Shards by jump consistent hashing; DataFrame functions only.

A key's shard follows from the key and the number of shards by a short arithmetic loop, without a
ring table: when one shard is appended, a row either stays or moves into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import table
from newscorpus.operators.ordering import with_positions

#: Multiplier of the published algorithm's generator, as its upper and lower 32 bits.
STEP = 2862933555777941757
_HIGH, _LOW, _MASK = STEP >> 32, STEP & 0xFFFFFFFF, 0xFFFFFFFF


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 .. ``shards`` - 1 of a bigint key, read as an unsigned number; a null key counts as 0.

    The generator works modulo 2**64 on two halves of 32 bits, so no product leaves the range of a
    long (overflow is an error in ANSI mode).
    """
    k = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(
        F.lit(-1).cast("bigint").alias("b"),
        F.lit(0).cast("bigint").alias("j"),
        F.shiftrightunsigned(k, 32).alias("high"),
        k.bitwiseAND(F.lit(_MASK)).alias("low"),
    )

    def times_low(half: Column) -> tuple[Column, Column]:
        """Upper and lower 16 bits of a half, times the lower half of the multiplier."""
        return F.shiftright(half, 16) * F.lit(_LOW), half.bitwiseAND(F.lit(0xFFFF)) * F.lit(_LOW)

    def step(state: Column, _: Column) -> Column:
        upper, lower = times_low(state["low"])
        first = lower + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
        h_upper, h_lower = times_low(state["high"])
        high = (
            F.shiftright(first, 32)
            + F.shiftright(upper, 16)
            + (state["low"] * F.lit(_HIGH)).bitwiseAND(F.lit(_MASK))
            + F.shiftleft(h_upper.bitwiseAND(F.lit(0xFFFF)), 16)
            + h_lower
        ).bitwiseAND(F.lit(_MASK))
        jump = F.floor((state["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        new = F.struct(
            state["j"].alias("b"), jump.cast("bigint").alias("j"), high.alias("high"), first.bitwiseAND(F.lit(_MASK)).alias("low")
        )
        return F.when(state["j"] < shards, new).otherwise(state)

    # The candidate grows with each step, so as many steps as shards always suffice.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def shard(rows: DataFrame, key: str, shards: int, order: list[str]) -> DataFrame:
    """Add ``shard``, ``slot`` (from 0 without gaps in each shard, by ``order``) and ``grown_shard``.

    Slots come from a distributed sort of the rows given, so pass narrow ones. Rows equal in every
    ordering column are told apart by their place in the input; a key that many rows share lands in
    one shard, as its law wants, but is numbered by many tasks.
    """
    placed = rows.withColumns(
        {"shard": jump_hash(F.col(key), shards), "grown_shard": jump_hash(F.col(key), shards + 1), "_id": F.monotonically_increasing_id()}
    )
    by = [F.col(c).asc_nulls_first() for c in order]
    return with_positions(placed, ["shard"], [*by, F.col("_id")], position="slot", first=0).drop("_id")


def op6_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, by the law of keys. A null text has size 1 and checksum 0."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law")
    )
    return shard(docs, "doc_id", 16, ["doc_id", "text_crc32", "size"])


#: Remainders of the sixteen half bytes under the checksum's polynomial.
def _half_bytes() -> list[int]:
    out = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def _jump_sql(n: int) -> str:
    key = f"(s['k'] * {STEP}::HUGEINT + 1) % 18446744073709551616::HUGEINT"
    return f"""list_reduce(range({n}), lambda s, i: CASE WHEN s['j'] >= {n} THEN s ELSE {{'b': s['j'], 'k': {key},
      'j': floor((s['j'] + 1)::DOUBLE * (2147483648::DOUBLE / ((({key}) >> 33) + 1)::DOUBLE))::BIGINT}} END,
      {{'b': -1::BIGINT, 'k': CASE WHEN k < 0 THEN k + 18446744073709551616::HUGEINT ELSE k END, 'j': 0::BIGINT}})['b']::INTEGER"""


OP6_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(doc_id, 0)::HUGEINT AS k, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, k, (length(h) // 2 + 1)::BIGINT AS size,
    xor(list_reduce(list_transform(range(length(h)), lambda i: instr('0123456789ABCDEF', h[xor(i, 1) + 1]) - 1),
      lambda c, x: xor(c >> 4, {_half_bytes()}[(xor(c, x) & 15) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32
  FROM t),
s AS (SELECT *, {_jump_sql(16)} AS shard, {_jump_sql(17)} AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot FROM s
"""
