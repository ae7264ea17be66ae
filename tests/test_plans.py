"""Plans: what is shuffled, and how often, with and without broadcasts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newscorpus.operators import articles, keyed
from newscorpus.operators.ordering import with_positions
from newscorpus.sources import tables


@pytest.fixture
def static(spark):
    """No broadcasts and no changes at run time, so that the plan shows every exchange."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_shuffle_their_rows_once(static):
    df = static.createDataFrame([(g, i, 2) for g in ("a", None) for i in range(40)], "g string, i int, n bigint")
    placed = with_positions(df, ["g"], [F.col("i")], running={"n": "before"})
    # Rows by key; totals by key, by group and by key again. The join adds none on the side of the rows.
    assert plan(placed).count("Exchange hashpartitioning") == 4
    got = {(r["g"], r["i"]): (r["position"], r["before"]) for r in placed.collect()}
    assert got == {(g, i): (i + 1, 2 * i) for g in ("a", None) for i in range(40)}


@pytest.mark.parametrize("limit", [100_000, 1])
def test_html_is_not_shuffled(static, monkeypatch, limit):
    monkeypatch.setattr(keyed, "MAX_BROADCAST_KEYS", limit)
    rows = [(i, "s", f"k{i % 5}", f"<p>text {i}</p>") for i in range(20)]
    pages = static.createDataFrame(rows, "page_id bigint, section_key string, article_key string, html string")
    kept = keyed.one_copy(articles.article_records(pages), ["section_key", "article_key"], "page_id", ids=pages)
    for line in plan(kept).splitlines():
        assert "Exchange" not in line or "html" not in line
    assert sorted(r["page_id"] for r in kept.collect()) == [0, 1, 2, 3, 4]
    text = plan(kept)
    moved = text[text.index("Exchange") :] if "Exchange" in text else ""
    assert limit > 1 or "SortMergeJoin" in text and moved


def test_no_task_has_more_than_its_share_of_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MAX_SPLIT_BYTES", 200_000, raising=False)
    monkeypatch.setattr(tables, "TASK_BYTES", 50_000, raising=False)
    path, columns = str(tmp_path / "t"), "id int, html string, url string"
    # Splits enough, one of them with most of the text in a single row group.
    spark.createDataFrame([(i, "x" * 1000, None) for i in range(1000)], columns).coalesce(1).write.parquet(path)
    spark.createDataFrame([(1000 + i, None, "y") for i in range(31)], columns).repartition(31).write.mode("append").parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    spread = tables.spread_small(scan)
    held = spread.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("html")).alias("n"))
    assert held.agg(F.max("n")).first()[0] <= 100_000
    assert sorted(r["id"] for r in spread.collect()) == list(range(1031))
    monkeypatch.setattr(tables, "MAX_SPLIT_BYTES", 10_000_000)
    assert tables.spread_small(scan) is scan
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
