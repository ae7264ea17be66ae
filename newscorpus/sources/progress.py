"""Progress documents of earlier runs: JSON in any of the shapes that were ever written."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

MAP = "map<string,string>"
LINK = "struct<url:string,title:string,scraped_date:string>"
#: Why a document is rejected.
EMPTY, NO_OBJECT, NO_JSON = "empty", "not an object", "not JSON"
FAULT = StructType().add("position", LongType()).add("reason", StringType()).add("detail", StringType())


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Progress files as (path, value), one row each; none when there is no file."""
    try:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "path string, value string")


def read_progress(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(links, ledger) of progress files; both empty when there is none.

    Files that are no progress documents give neither; ``read_rejects`` tells which and why.
    """
    docs = read_documents(spark, path)
    return progress_links(docs, "value"), progress_ledger(docs, "value")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """path, position, reason, detail of each progress file that cannot be read."""
    return progress_rejects(read_documents(spark, path), "value", "path")


@F.pandas_udf(FAULT)
def _fault(text: pd.Series) -> pd.DataFrame:
    """What is wrong with a document; nulls for null and for what is an object after all."""
    found = []
    for doc in text:
        fault = (None, None, None)
        if doc is not None and not doc.strip():
            fault = (0, EMPTY, "no text")
        elif doc is not None:
            try:
                if not isinstance(json.loads(doc), dict):
                    fault = (0, NO_OBJECT, doc.lstrip()[:20])
            except json.JSONDecodeError as error:
                fault = (error.pos, NO_JSON, error.msg)
            except RecursionError:
                fault = (0, NO_JSON, "nested too deeply")
        found.append(fault)
    return pd.DataFrame(found, columns=["position", "reason", "detail"]).astype({"position": "Int64"})


def _checked(docs: DataFrame, doc: str) -> DataFrame:
    """Add ``_fault``: null for good documents and for null ones.

    Documents are parsed by the engine; only those it cannot read as an object, or that name a key
    twice, are looked at once more to find the place.
    """
    value = F.try_parse_json(doc)
    good = F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))
    fault = _fault(F.when(~good, F.col(doc)))
    return docs.withColumn("_fault", fault).withColumn("_fault", F.when(F.col("_fault.reason").isNotNull(), F.col("_fault")))


def progress_rejects(docs: DataFrame, doc: str, *keep: str) -> DataFrame:
    """Documents that are no JSON object: where reading stopped (in characters), the reason and the
    parser's own words. The other documents' links and ledger rows are read all the same."""
    return _checked(docs, doc).where("_fault is not null").select(*keep, "_fault.*")


def _good(docs: DataFrame, doc: str) -> DataFrame:
    return _checked(docs, doc).where("_fault is null").drop("_fault")


def progress_links(docs: DataFrame, doc: str, *keep: str) -> DataFrame:
    """Links in list order from documents of any shape.

    Values are parsed one level at a time as JSON text, which keeps the order of object keys.
    A section is taken from ``discovered_urls``, or from the top level where that has none.
    """
    return (
        _good(docs, doc).withColumn("_root", F.from_json(doc, MAP))
        .withColumn(
            "_found",
            F.coalesce(
                F.from_json(F.col("_root")["discovered_urls"], MAP), F.create_map().cast(MAP)
            ),
        )
        .select(*keep, F.explode(_lists(F.col("_root"), F.col("_found"))).alias("_list"))
        .select(
            *keep,
            F.lower("_list.key").alias("section_key"),
            F.posexplode(_items(F.col("_list.value"))).alias("pos", "_item"),
        )
        .select(
            *keep,
            "section_key",
            F.col("pos").cast("bigint").alias("pos"),
            F.col("_item.url").alias("url"),
            F.col("_item.title").alias("title"),
            F.try_to_timestamp("_item.scraped_date").cast("timestamp_ntz").alias("discovered_at"),
        )
    )


def _lists(root: Column, found: Column) -> Column:
    listed = F.filter(F.map_entries(found), lambda e: ~e["value"].isin("[]", "{}"))
    older = F.filter(
        F.map_entries(root),
        lambda e: (e["key"] != "discovered_urls")
        & F.rlike(e["value"], F.lit(r"^[\[{]"))
        & ~F.exists(listed, lambda kept: kept["key"] == e["key"]),
    )
    return F.concat(listed, older)


def _items(text: Column) -> Column:
    """Items of one section as links: array of links, array of URLs, or object keyed by URL."""

    def link(item: Column) -> Column:
        url = F.struct(
            item.alias("url"),
            F.lit(None).cast("string").alias("title"),
            F.lit(None).cast("string").alias("scraped_date"),
        )
        return F.when(F.startswith(item, F.lit("{")), F.from_json(item, LINK)).otherwise(url)

    items = F.when(
        F.startswith(text, F.lit("{")), F.map_keys(F.from_json(text, MAP))
    ).otherwise(F.from_json(text, "array<string>"))
    return F.filter(F.transform(items, link), lambda i: F.coalesce(i["url"], F.lit("")) != "")


def progress_ledger(docs: DataFrame, doc: str, *keep: str) -> DataFrame:
    """Ledger rows from the ``<section>_completed`` and ``<section>_count`` entries."""
    mark = "_completed"
    return (
        _good(docs, doc).withColumn("_root", F.from_json(doc, MAP))
        .select(
            *keep,
            "_root",
            F.explode(
                F.filter(F.map_entries("_root"), lambda e: F.endswith(e["key"], F.lit(mark)))
            ).alias("_entry"),
        )
        .withColumn(
            "section_key", F.regexp_extract("_entry.key", f"^(.*){mark}$", 1)
        )
        .select(
            *keep,
            "section_key",
            (F.col("_entry.value") == "true").alias("completed"),
            F.col("_root")[F.concat("section_key", F.lit("_count"))]
            .try_cast("bigint")
            .alias("n_links"),
            F.try_to_timestamp(F.col("_root")["last_updated"])
            .cast("timestamp_ntz")
            .alias("updated_at"),
        )
    )
