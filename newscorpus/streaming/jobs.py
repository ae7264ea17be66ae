"""Incremental ingest: new page files in, articles, counts and ledger out.

Every sink writes the output of micro-batch N to ``batch_id=N`` by overwrite. A batch that is
run again after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newscorpus import schemas
from newscorpus.operators.cleaning import clean_corpus
from newscorpus.operators.keyed import broadcast_if_few
from newscorpus.operators.ledger import completed_rows, update_ledger
from newscorpus.session import shared_dir
from newscorpus.sources.tables import read_if_exists

KEY = ["section_key", "article_key"]
INDEX_SCHEMA = "section_key string, article_key string, batch_id bigint, bucket string"
BUCKET_DIGITS = 2
COUNT_SCHEMA = "section_key string, month string, n_articles bigint, batch_id bigint"

Prepare = Callable[[DataFrame], DataFrame]


def page_stream(
    spark: SparkSession,
    in_dir: str,
    schema: str,
    glob: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """New parquet files of a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(in_dir)


def _run(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bucket(key: str = "article_key") -> Column:
    """Part of the key index that holds an article: the first digits of its digest."""
    return F.substring(key, 1, BUCKET_DIGITS)


def index_path(out_dir: str) -> str:
    return f"{out_dir.rstrip('/')}-keys"


def stored_keys(spark: SparkSession, out_dir: str, before: int, buckets: list[str]) -> DataFrame:
    """Keys of the articles that batches below ``before`` stored, of some buckets only.

    The index below ``out_dir``-keys has what each batch added, by bucket, and now and then all of
    it in one place. Only the last of these, and what came later, is read.
    """
    index = index_path(out_dir)
    whole = read_if_exists(spark, f"{index}/whole", INDEX_SCHEMA).where(F.col("batch_id") < before)
    last = whole.agg(F.max("batch_id")).first()[0]
    last = -1 if last is None else last
    added = read_if_exists(spark, f"{index}/added", INDEX_SCHEMA).where(
        (F.col("batch_id") < before) & (F.col("batch_id") > last)
    )
    rows = whole.where(F.col("batch_id") == last).unionByName(added)
    return rows.where(F.col("bucket").isin(buckets)).select(*KEY)


def _write_index(keys: DataFrame, path: str) -> None:
    (
        keys.select(*KEY, _bucket().alias("bucket"))
        .hint("rebalance", F.col("bucket"))
        .write.partitionBy("bucket")
        .option("partitionOverwriteMode", "static")
        .mode("overwrite")
        .parquet(path)
    )


def stream_clean(
    pages: DataFrame,
    out_dir: str,
    checkpoint: str,
    prepare: Prepare,
    row_id: str = "page_id",
    compact_every: int = 50,
) -> StreamingQuery:
    """Clean pages whose article is not stored yet, and append them.

    ``prepare`` adds section_key and article_key. Articles of earlier batches are left out by an
    anti-join on the stored keys, which is exact over all time and needs no stream state. The keys
    lie in an index of buckets; a batch reads only the buckets it touches, and every
    ``compact_every`` batches the index is gathered, so what a batch costs follows its own size.
    Pages are cleaned before anything is joined: HTML is never shuffled.
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        shared_dir(spark)
        keyed = prepare(batch)
        wanted = keyed.select(*KEY, row_id).checkpoint()
        if batch_id and batch_id % compact_every == 0:
            every = [f"{n:0{BUCKET_DIGITS}x}" for n in range(16**BUCKET_DIGITS)]
            _write_index(stored_keys(spark, out_dir, batch_id, every), f"{index_path(out_dir)}/whole/batch_id={batch_id - 1}")
        first = wanted.groupBy(*KEY).agg(F.min(row_id).alias("_keep"), F.count("*").alias("_n"))
        if batch_id:
            buckets = [r[0] for r in wanted.select(_bucket()).distinct().collect()]  # 16**BUCKET_DIGITS at most
            stored = stored_keys(spark, out_dir, batch_id, buckets).withColumn("_seen", F.lit(True))
            first = first.join(stored, KEY, "left")
        else:
            first = first.withColumn("_seen", F.lit(None).cast("boolean"))
        # Keys that repeat in the batch or are stored; of the others every page is written as it comes.
        odd = first.where("_n > 1 or _seen").drop("_n").checkpoint()
        cleaned = clean_corpus(keyed)
        fresh = (
            cleaned.join(broadcast_if_few(odd), KEY, "left")
            .where(F.col("_seen").isNull() & (F.col("_keep").isNull() | (F.col(row_id) == F.col("_keep"))))
            .select(*cleaned.columns)
        )
        fresh.hint("rebalance").write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
        new = wanted.select(*KEY).distinct().join(odd.where("_seen"), KEY, "left_anti")
        _write_index(new, f"{index_path(out_dir)}/added/batch_id={batch_id}")

    return _run(pages.writeStream.foreachBatch(ingest), checkpoint)


def stream_section_counts(
    articles: DataFrame, out_dir: str, checkpoint: str, published: str = "published_at"
) -> StreamingQuery:
    """Running articles per section and month; each batch writes the counts it changed.

    State is one counter per (section, month). Windows take no month interval, hence the
    formatted month as the key.
    """
    counts = (
        articles.withColumn("month", F.date_format(published, "yyyy-MM"))
        .groupBy("section_key", "month")
        .agg(F.count("*").alias("n_articles"))
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    return _run(counts.writeStream.outputMode("update").foreachBatch(save), checkpoint)


def latest_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """Current counts: the last write of each (section, month)."""
    return (
        read_if_exists(spark, out_dir, COUNT_SCHEMA)
        .groupBy("section_key", "month")
        .agg(F.max_by("n_articles", "batch_id").alias("n_articles"))
    )


def stream_ledger(
    articles: DataFrame,
    out_dir: str,
    checkpoint: str,
    run_ts: str,
    completed: bool | list[str] = False,
) -> StreamingQuery:
    """Ledger kept current: each batch writes the next version from the one before it.

    ``articles`` are articles as they are stored (what ``stream_clean`` wrote), so that none counts
    twice. A stream does not know when a section ends: sections stay open, to be resumed, unless
    ``completed`` names them or is True.
    """
    done = F.lit(completed) if isinstance(completed, bool) else F.col("section_key").isin(completed)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        before = ledger_version(batch.sparkSession, out_dir, batch_id - 1)
        counts = batch.groupBy("section_key").agg(F.count("*").alias("n"))
        so_far = before.select("section_key", F.col("n_links").alias("_so_far"))
        grown = counts.join(so_far, "section_key", "left").select(
            "section_key", (F.col("n") + F.coalesce("_so_far", F.lit(0))).alias("n_links")
        )
        # The greater count wins among rows of one run, so the order of equal times is settled.
        rows = completed_rows(grown, run_ts).withColumn("completed", done)
        update_ledger(before, rows, tie_break="n_links").write.mode(
            "overwrite"
        ).parquet(f"{out_dir}/batch_id={batch_id}")

    return _run(articles.writeStream.foreachBatch(refresh), checkpoint)


def ledger_version(spark: SparkSession, out_dir: str, batch_id: int) -> DataFrame:
    return read_if_exists(spark, f"{out_dir}/batch_id={batch_id}", schemas.LEDGER)


def latest_ledger(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest version of the ledger."""
    versions = read_if_exists(spark, out_dir, f"{schemas.LEDGER}, batch_id bigint")
    newest = versions.agg(F.max("batch_id").alias("n")).first()["n"]
    return ledger_version(spark, out_dir, -1 if newest is None else newest)
