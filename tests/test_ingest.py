from __future__ import annotations

import json
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from newscorpus.functions import keys
from newscorpus.operators import cleaning, ingest, ledger, quality
from newscorpus.sources import progress, tables


def links(spark, *data):
    return spark.createDataFrame(list(data), "section_key string, page_no bigint, pos bigint, url string")


def stored(spark, *data):
    df = spark.createDataFrame(list(data), "section_key string, url string")
    return df.select("section_key", keys.article_key(F.col("url")).alias("article_key"))


def test_the_same_url_in_two_sections_is_two_articles(spark):
    known = links(spark, ("s", 1, 0, "/a"), ("t", 1, 0, "/a"), ("s", 1, 1, "/b"), ("s", 2, 0, "/b"), ("s", 1, 2, ""))
    cached = stored(spark, ("s", "/a"), ("s", "/a"))
    todo = ingest.pending_articles(known, cached)
    assert rows(todo.select("section_key", "url", "page_no"), "section_key", "url") == [("s", "/b", 1), ("t", "/a", 1)]
    assert rows(ingest.unchanged_rerun(known, cached), "section_key") == [("s", 1, 2), ("t", 0, 1)]
    done = todo.select("section_key", "article_key").unionByName(cached)
    assert ingest.pending_articles(known, done).count() == 0


def test_attach_url_by_key_with_a_default(spark):
    files = stored(spark, ("s", "/a"), ("s", "/zzz"))
    known = links(spark, ("s", 1, 0, "/a"), ("s", 3, 0, "/a"), ("t", 1, 0, "/zzz"))
    found = ingest.attach_url(files, known, "https://default")
    assert sorted(r["url"] for r in found.collect()) == ["/a", "https://default"]


def test_fetch_outcomes_and_summary(spark):
    log = {"/ok": "+", "/third": "--+", "/last": "---+", "/late": "----+", "/never": "------", "/cut": "--"}
    data = [("s", u, i + 1, c == "+") for u, marks in log.items() for i, c in enumerate(marks)]
    data += [("t", "", None, None), ("t", "/x", 1, True)]
    attempts = spark.createDataFrame(data, "section_key string, url string, attempt bigint, ok boolean")
    out = ingest.fetch_outcomes(attempts)
    assert {r[1]: tuple(r[2:]) for r in out.collect()} == {
        "/ok": (True, 0, 0.0),
        "/third": (True, 2, 5.0),
        "/last": (True, 3, 9.5),
        "/late": (False, 3, 9.5),
        "/never": (False, 3, 9.5),
        "/cut": (False, 1, 5.0),
        "": (False, 0, 0.0),
        "/x": (True, 0, 0.0),
    }
    assert rows(ingest.fetch_summary(out), "level", "section_key") == [("s", 3, 6, 0), ("t", 1, 2, 0), (None, 4, 8, 1)]


def test_ledger_upsert_and_resume(spark):
    old = ledger.completed_rows(spark.createDataFrame([("s", 3), ("t", 4)], "section_key string, n_links int"), "2026-01-01")
    new = ledger.completed_rows(spark.createDataFrame([("t", 9), ("u", 1)], "section_key string, n_links int"), "2026-02-01")
    now = ledger.update_ledger(old, new)
    assert rows(now.select("section_key", "n_links"), "section_key") == [("s", 3), ("t", 9), ("u", 1)]
    assert rows(ledger.update_ledger(now, new), "section_key") == rows(now, "section_key")
    known = spark.createDataFrame([("S",), ("T",), ("v",)], "section_key string")
    assert rows(ledger.resume_sections(known, now), "section_key") == [("v",)]
    assert rows(ledger.resume_sections(known, now, forced=["s"]), "section_key") == [("S",), ("v",)]
    failed = now.withColumn("completed", F.lit(False))
    assert ledger.resume_sections(known, failed).count() == 3


PROGRESS = {
    "discovered_urls": {
        "links": [{"url": "/z", "title": "Z", "category": "links", "scraped_date": "2026-06-19T08:30:00.5"},
                  {"url": "", "title": "none"}, {"url": "/a", "title": "A"}],
        "urls": ["/z", "", "/a", "/m"],
        "Object": {"/z": {"x": [1, {"y": 2}]}, "/a": {}, "/m": None},
        "moved": [],
    },
    "moved": ["/old"],
    "older": {"/q": 1},
    "links_completed": True,
    "links_count": 2,
    "urls_completed": False,
    "last_updated": "2026-06-19T09:00:00",
}


def test_progress_in_every_shape(spark, tmp_path):
    path = tmp_path / "progress.json"
    path.write_text(json.dumps(PROGRESS, ensure_ascii=False, indent=2), encoding="utf-8")
    found, state = progress.read_progress(spark, str(path))
    assert rows(found.select("section_key", "pos", "url", "title"), "section_key", "pos") == [
        ("links", 0, "/z", "Z"), ("links", 1, "/a", "A"),
        ("moved", 0, "/old", None),
        ("object", 0, "/z", None), ("object", 1, "/a", None), ("object", 2, "/m", None),
        ("older", 0, "/q", None),
        ("urls", 0, "/z", None), ("urls", 1, "/a", None), ("urls", 2, "/m", None),
    ]
    at = datetime(2026, 6, 19, 9)
    assert rows(state, "section_key") == [("links", True, 2, at), ("urls", False, None, at)]
    first = found.where("section_key = 'links'").orderBy("pos").first()
    assert first["discovered_at"] == datetime(2026, 6, 19, 8, 30, 0, 500000)


def test_missing_progress_is_empty(spark, tmp_path):
    found, state = progress.read_progress(spark, str(tmp_path / "none.json"))
    assert found.count() == 0 and state.count() == 0


def test_html_tree(spark, tmp_path):
    for section, key, text in [("world", "0a1b2c3d", "<p>એક\ntwo</p>"), ("new desk", "ffffffff", "x")]:
        (tmp_path / section).mkdir()
        (tmp_path / section / f"{key}.html").write_text(text, encoding="utf-8")
    (tmp_path / "world" / "notes.txt").write_text("no")
    got = rows(tables.read_pages(spark, str(tmp_path), "html"), "section_key")
    assert got == [("new desk", "ffffffff", "x"), ("world", "0a1b2c3d", "<p>એક\ntwo</p>")]
    with pytest.raises(ValueError):
        tables.read_pages(spark, str(tmp_path), "pdf")


def test_corpus_is_stored_by_section_and_pruned(spark, tmp_path):
    path = str(tmp_path / "corpus")
    df = spark.createDataFrame([("s", 1), ("t", 2), ("s", 3)], "section_key string, id int")
    tables.write_corpus(df, path)
    tables.write_corpus(spark.createDataFrame([("t", 9)], "section_key string, id int"), path)
    back = spark.read.parquet(path)
    assert rows(back.select("section_key", "id"), "id") == [("s", 1), ("s", 3), ("t", 9)]
    plan = back.where("section_key = 's'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(section_key" in plan
    assert tables.read_if_exists(spark, str(tmp_path / "none"), "id int").count() == 0


def test_manifest_is_csv_with_header(spark, tmp_path):
    path = tmp_path / "manifest"
    tables.write_manifest(spark.createDataFrame([("s", 1)], "section_key string, n int").coalesce(1), str(path))
    (part,) = path.glob("part-*.csv")
    assert part.read_text() == "section_key,n\ns,1\n"


def test_quality_measures(spark):
    df = spark.createDataFrame(
        [(1, "ગુજ ab�"), (2, "x & & & & y && z & w"), (3, "a <b>c</b> d < e > f"), (4, ""), (5, "Photo: x")],
        "id int, body string",
    )
    share = {r["id"]: (r["n_chars"], r["n_script"], r["n_replacement"], r["share"]) for r in quality.script_share(df).collect()}
    assert share[1] == (7, 3, 1, 3 / 7) and share[4] == (0, 0, 0, None)
    assert [r["n_runs"] for r in quality.repeat_tokens(df).orderBy("id").collect()] == [0, 2, 0, 0, 0]
    left = [(r["n_tags"], r["has_listed"]) for r in quality.residual_markup(df).orderBy("id").collect()]
    assert left == [(0, False), (0, False), (2, False), (0, False), (0, True)]


def test_report_adds_up(spark):
    pages = spark.createDataFrame(
        [("s", "<p>a</p><p>a</p><p>Photo: x</p>"), ("s", "<p>Photo: x</p>"), ("t", "<p>b</p>")],
        "section_key string, html string",
    )
    report = quality.corpus_report(cleaning.clean_corpus(pages))
    assert rows(report, "section_key") == [("s", 1, 1, 4, 1, 2, 1), ("t", 1, 0, 1, 1, 0, 0)]


def test_progress_files_that_cannot_be_read(spark, tmp_path):
    good = '{"discovered_urls": {"World": [{"url": "/1"}, "/2"]}, "World_completed": true, "World_count": 2}'
    twice = '{"crime": {"/3": 1, "/3": 2}}'
    for name, text in {"a": good, "b": good[:50], "c": "[1]", "d": " \n", "e": twice, "f": '{"x": }', "g": '"text"'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    links, ledger = progress.read_progress(spark, str(tmp_path))
    assert rows(links.select("section_key", "url"), "section_key", "url")[-2:] == [("world", "/1"), ("world", "/2")]
    assert {r["section_key"] for r in links.collect()} <= {"world", "crime"} and ledger.count() == 1
    found = progress.read_rejects(spark, str(tmp_path))
    got = rows(found.select(F.regexp_extract("path", "([^/]+).json$", 1).alias("f"), "position", "reason", "detail"), "f")
    assert got == [
        ("b", 50, "not JSON", "Expecting ',' delimiter"),
        ("c", 0, "not an object", "[1]"),
        ("d", 0, "empty", "no text"),
        ("f", 6, "not JSON", "Expecting value"),
        ("g", 0, "not an object", '"text"'),
    ]
    assert progress.read_rejects(spark, str(tmp_path / "none")).count() == 0
