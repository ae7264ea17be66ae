from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from newscorpus.functions import keys
from newscorpus.operators import compilation
from newscorpus.operators.ordering import with_positions
from newscorpus.sources.tables import read_sections


@pytest.fixture
def many_partitions(spark):
    """Keep small sorts in several partitions, as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_positions_against_brute_force_with_a_hot_group(spark, many_partitions):
    """One group holds most rows; it spreads over several sort partitions."""
    rng = random.Random(7)
    data = [
        (None if i % 50 == 0 else rng.choice(["hot"] * 8 + ["a", "b"]), rng.randrange(500), i, rng.randrange(9))
        for i in range(6000)
    ]
    df = spark.createDataFrame(data, "g string, x int, id int, w int").repartition(8)
    order = [F.col("x").desc(), F.col("id")]
    got = with_positions(df, ["g"], order, first=0, running={"w": "before"})
    want, seen = {}, {}
    for g, x, i, w in sorted(data, key=lambda r: (-r[1], r[2])):
        n, total = seen.get(g, (0, 0))
        want[i] = (n, total)
        seen[g] = (n + 1, total + w)
    assert {r["id"]: (r["position"], r["before"]) for r in got.collect()} == want
    hot = df.orderBy("g", *order).withColumn("part", F.spark_partition_id()).where("g = 'hot'")
    assert hot.select("part").distinct().count() > 1


def test_positions_run_no_window_over_a_whole_group(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), "id")
    plan = with_positions(df, ["g"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 1 and "_rows" in windows[0]


def table(spark, data):
    schema = (
        "section_key string, article_key string, published_at timestamp_ntz, fetched_at timestamp_ntz, "
        "n_blocks bigint, n_bytes bigint, body string"
    )
    return spark.createDataFrame(
        [(s, k, _ts(p), _ts(f), n, len(b) if b is not None else None, b) for s, k, p, f, n, b in data], schema
    )


def _ts(text):
    from datetime import datetime

    return datetime.fromisoformat(text) if text else None


def link_table(spark, data):
    return spark.createDataFrame(data, "section_key string, article_key string, rank bigint")


ARTICLES = [
    ("s", "late", "2024-01-05", "2024-02-01", 2, "late!"),
    ("s", "first", "2024-01-09", "2024-02-02", 3, "first"),
    ("s", "edge", "2024-01-10", "2024-02-03", 1, "edge"),
    ("s", "loose2", None, "2024-01-31", 1, "loose2"),
    ("s", "loose1", None, "2024-01-30", 1, "loose1"),
    ("s", "blank", "2024-01-11", "2024-02-03", 0, ""),
    ("t", "first", "2024-01-09", "2024-02-02", 4, "other"),
    ("t", "next", None, "2024-03-01", 1, "n"),
]
LINKS = [("s", "first", 0), ("s", "edge", 998), ("s", "late", 1000), ("s", "first", 2000), ("t", "next", 5)]


@pytest.fixture(scope="module")
def compiled(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    articles = compilation.skip_unreadable(table(spark, ARTICLES))
    return compilation.compile_monthly(articles.drop("body"), link_table(spark, LINKS)).cache()


def test_members_in_order_with_offsets(compiled):
    got = rows(
        compiled.select("section_key", "month", "position", "article_key", "rank", "start_block", "start_byte"),
        "section_key", "month", "position",
    )
    assert got == [
        ("s", "2024-01", 1, "first", 0, 0, 0),
        ("s", "2024-01", 2, "edge", 998, 3, 5),
        ("s", "2024-01", 3, "late", 1000, 4, 9),
        ("s", "2024-01", 4, "loose1", None, 6, 14),
        ("s", "2024-01", 5, "loose2", None, 7, 20),
        ("t", "2024-01", 1, "first", None, 0, 0),
        ("t", "2024-03", 1, "next", 5, 0, 0),
    ]
    again = compilation.compile_offsets(compiled.drop("start_block"))
    assert rows(again.select(*compiled.columns), "section_key", "month", "position") == rows(
        compiled, "section_key", "month", "position"
    )


def test_order_in_a_whole_section(spark):
    ordered = compilation.order_articles(table(spark, ARTICLES).drop("body"), link_table(spark, LINKS))
    got = [k for (k,) in rows(ordered.where("section_key = 's'").select("article_key"), "position")]
    assert got == ["first", "edge", "late", "loose1", "loose2", "blank"]


@pytest.mark.parametrize("part_bytes", [1, 6, 10, 1000])
def test_parts_in_order_make_the_compilation(spark, compiled, part_bytes):
    parts = compilation.compile_body(compiled, table(spark, ARTICLES), part_bytes)
    mine = rows(parts.where("section_key = 's'").select("part_no", "n_articles", "body"), "part_no")
    assert "\n".join(body for _, _, body in mine) == "first\nedge\nlate!\nloose1\nloose2"
    assert sum(n for _, n, _ in mine) == 5
    assert {1: 5, 6: 4, 10: 3, 1000: 1}[part_bytes] == len(mine)


def test_manifest_and_covers(spark, compiled):
    manifest = compilation.archive_manifest(compiled, read_sections(spark), "Pre")
    got = rows(manifest.select("section_key", "month", "file_name", "n_articles", "n_bytes", "level"),
               "level", "section_key", "month")
    assert got == [
        ("s", "2024-01", "S/Pre_S_2024-01", 5, 26, 0),
        ("t", "2024-01", "T/Pre_T_2024-01", 1, 5, 0),
        ("t", "2024-03", "T/Pre_T_2024-03", 1, 1, 0),
        ("s", None, None, 5, 26, 1),
        ("t", None, None, 2, 6, 1),
        (None, None, None, 7, 32, 3),
    ]
    cover = compilation.cover_rows(compiled, read_sections(spark), "2026-01-02 03:04:05", "Title")
    assert cover.where("section_key = 's'").first()["cover"] == (
        "Title\nCategory: S\nMonth: 2024-01\nTotal Articles: 5\nArchived on: 2026-01-02 03:04:05"
    )


def test_a_group_without_readable_members_yields_nothing(spark):
    none = compilation.skip_unreadable(table(spark, [("s", "k", "2024-01-01", "2024-01-01", 0, None)]))
    assert compilation.compile_monthly(none.drop("body"), link_table(spark, LINKS)).count() == 0


@pytest.mark.parametrize(
    ("name", "stem"),
    [("('abc.html',", "abc"), ("abc", "abc"), (" abc.html.html\n", "abc"), ("a.htmlb", "ab"), ("(abc)", "(abc)")],
)
def test_canonical_stem(spark, name, stem):
    df = spark.createDataFrame([(name,)], "name string").select(keys.canonical_stem(F.col("name")).alias("stem"))
    assert df.first()["stem"] == stem
