"""Reading page corpora and sections, writing article corpora and manifests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newscorpus import values


def read_if_exists(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Parquet table, or no rows when nothing has been written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


# A split with more text than this is too much for one task of text work, and what each task gets instead.
MAX_SPLIT_BYTES, TASK_BYTES = 64 << 20, 16 << 20


def spread_small(scan: DataFrame) -> DataFrame:
    """Use all cores on a table that comes in fewer splits than there are cores, or in too large ones.

    Text work is bound by CPU, and a small file is one split. A large file is one task for each of its
    row groups, however many splits it has; what counts is therefore the text that lies in a split.
    A table in splits enough and of at most ``MAX_SPLIT_BYTES`` of text is left alone: its pages are not
    shuffled. Takes a plain scan.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("bigint") for f in scan.schema if isinstance(f.dataType, StringType)]
    held = scan.groupBy(F.spark_partition_id()).agg(F.sum(sum(texts, F.lit(0))).alias("n"))
    total, most = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if scan.rdd.getNumPartitions() >= cores and most <= MAX_SPLIT_BYTES:
        return scan
    return scan.repartition(max(cores, -(-total // TASK_BYTES)))


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page corpus: a parquet table, or a tree of ``<section>/<short key>.html`` files.

    From a tree come section_key, short_key and html; one file is one page.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt != "html":
        raise ValueError(f"unknown format {fmt!r}")
    files = spark.read.text(
        path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html"
    )
    place = F.col("_metadata.file_path")
    return files.select(
        F.try_url_decode(F.regexp_extract(place, r"([^/]+)/[^/]+$", 1)).alias("section_key"),
        F.regexp_extract("_metadata.file_name", r"^(.*)\.html$", 1).alias("short_key"),
        F.col("value").alias("html"),
    )


def read_sections(
    spark: SparkSession, rows: list[tuple[str, str, str, str]] | None = None
) -> DataFrame:
    """Section dimension as a local relation, whose size the optimizer knows."""
    rows = values.SECTIONS if rows is None else rows
    names = ["section_key", "name_native", "name_english", "path"]
    columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
    return spark.createDataFrame(pa.table(columns, names=names))


def write_corpus(df: DataFrame, path: str) -> None:
    """Store articles by section, replacing the sections that occur in ``df``.

    Rebalancing gathers small pieces of a section into files of a useful size, and splits a
    section too large for one task over several.
    """
    (
        df.hint("rebalance", F.col("section_key"))
        .write.partitionBy("section_key")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A stored corpus, with section keys as the strings they are: a plain read makes 7 of 007."""
    found = spark.read.parquet(path)
    fields = [StructField("section_key", StringType()) if f.name == "section_key" else f for f in found.schema]
    return spark.read.schema(StructType(fields)).parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """Archive statistics as CSV with a header."""
    df.write.option("header", True).mode("overwrite").csv(path)
