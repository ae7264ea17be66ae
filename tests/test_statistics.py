"""Merged statistics against those of all rows, and reading and choosing sections by odd keys."""

from __future__ import annotations

import collections
import random

from conftest import rows

from newscorpus.operators import sections, statistics
from newscorpus.sources import tables

SCHEMA = "run int, section_key string, body string, n_bytes bigint, n_blocks bigint"


def corpus(spark, n=6000):
    draw = random.Random(5)
    made = []
    for i in range(n):
        text = f"text {draw.randrange(2500)}"
        body = "\n".join([text, "menu", "", f"line {draw.randrange(40)}", "menu"])
        made.append((i % 5, "hot" if i % 3 else f"s{i % 4}", body, draw.randrange(10_000), 3 if i % 10 else 0))
    return made, spark.createDataFrame(made, SCHEMA)


def test_merged_rows_estimate_all_rows(spark):
    made, df = corpus(spark)
    stats = statistics.run_statistics(df).checkpoint()
    assert stats.count() == len({m[:2] for m in made if m[4]})  # a row per run and section
    for r in statistics.statistics_report(stats).collect():
        of = [m for m in made if m[1] == r["section_key"] and m[4]]
        assert (r["n_articles"], r["n_bytes"], r["n_blocks"]) == (len(of), sum(m[3] for m in of), 3 * len(of))
        texts = len({m[2] for m in of})
        assert abs(r["n_texts"] - texts) <= statistics.TEXTS_ERROR * texts
        sizes = sorted(m[3] for m in of)
        for q, v in zip((0.1, 0.5, 0.9), r["size_quantiles"]):
            rank = sum(s <= v for s in sizes) / len(sizes)
            assert abs(rank - q) <= statistics.RANK_ERROR + 1 / len(sizes)
    whole = statistics.merge_statistics(stats, "run")
    assert {r["run"]: r["n_articles"] for r in whole.collect()} == collections.Counter(m[0] for m in made if m[4])
    # Merging in two steps gives the same counts.
    again = statistics.merge_statistics(statistics.merge_statistics(stats, "run", "section_key"))
    assert rows(again.select("section_key", "n_bytes"), "section_key") == rows(statistics.merge_statistics(stats).select("section_key", "n_bytes"), "section_key")


def test_bounds_on_repeated_lines(spark):
    made, df = corpus(spark, 900)
    true = collections.Counter((m[1], line) for m in made for line in m[2].split("\n") if line)
    exact = statistics.merge_lines(statistics.repeated_lines(df, keep=100_000))
    assert {(r[0], r[1]): (r[2], r[3]) for r in exact.collect()} == {k: (n, n) for k, n in true.items()}
    few = statistics.repeated_lines(df, keep=6)
    assert few.groupBy("run", "section_key").count().agg({"count": "max"}).first()[0] == 6
    bounds = {(r[0], r[1]): (r[2], r[3]) for r in statistics.merge_lines(few).collect()}
    assert all(a <= true[k] <= b for k, (a, b) in bounds.items()) and any(a < b for a, b in bounds.values())
    assert bounds["hot", "menu"] == (true["hot", "menu"],) * 2


def test_no_articles(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert statistics.statistics_report(statistics.run_statistics(none)).count() == 0
    assert statistics.merge_lines(statistics.repeated_lines(none)).count() == 0


def test_a_stored_corpus_keeps_its_keys(spark, tmp_path):
    df = spark.createDataFrame([("007", 1), ("7", 2), ("2024", 3), (None, 4)], "section_key string, n int")
    tables.write_corpus(df, str(tmp_path / "c"))
    assert rows(tables.read_corpus(spark, str(tmp_path / "c")).select("section_key", "n"), "n") == [("007", 1), ("7", 2), ("2024", 3), (None, 4)]
    assert tables.read_corpus(spark, str(tmp_path / "c")).where("section_key = '007'").count() == 1


def test_unknown_sections_are_derived(spark):
    got = sections.resolve_sections(tables.read_sections(spark), ["FACTCHECK", "cricket", "CRICKET", "world"])
    assert rows(got, "section_key") == [
        ("cricket", "Cricket", "/category/cricket/"), ("factcheck", "FactCheck", "/category/fact-check/"), ("world", "World", "/category/world/")]
    assert sections.resolve_sections(tables.read_sections(spark), []).count() == 0
