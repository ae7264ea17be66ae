"""Commits, merges and incremental work of archive runs: two writers, dead runs, fifty versions, one new page."""

from __future__ import annotations

import threading

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from test_archive import archive, members

from newscorpus.plans import archive as plan
from newscorpus.sources import files, runlog, versions


def test_one_of_many_creates_a_file(spark, tmp_path):
    won, runs = [], []
    log = runlog.RunLog(spark, str(tmp_path / "a"))

    def work(i):
        if files.create_new(spark, str(tmp_path / "x" / "f.json"), f"writer {i} " * 50):
            won.append(i)
        runs.append(log.claim())

    threads = [threading.Thread(target=work, args=(i,)) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and files.read_text(spark, str(tmp_path / "x" / "f.json")) == f"writer {won[0]} " * 50
    assert sorted(runs) == list(range(1, 13))
    assert list(files.listed(spark, str(tmp_path / "x"))) == ["f.json"]


def test_rename_that_does_not_replace(spark, tmp_path):
    """What other file systems are asked for, on the local one."""
    system, place = files._at(spark, str(tmp_path / "f"))
    for n, expected in ((1, True), (2, False)):
        draft = tmp_path / f"draft{n}"
        draft.write_text(str(n))
        assert files._put(spark, system, files._at(spark, str(draft))[1], place) is expected
    assert (tmp_path / "f").read_text() == "1"


SCHEMA = StructType([StructField(n, StringType()) for n in ("section_key", "article_key", "month", "text")])


def fill(spark, path, runs):
    """So many runs, written at once: run r changes key r % 5 and adds one of its own, in one of three sections."""
    made = [
        (r, f"0{k % 3}", f"k{k}", f"m{k % 2}", f"{k} of run {r}") for r in range(1, runs + 1) for k in (r % 5, 100 + r)
    ]
    df = spark.createDataFrame(made, "run bigint, section_key string, article_key string, month string, text string")
    for name, unit in (("articles", ["section_key"]), ("compiled", ["section_key", "month"])):
        df.repartition(1).write.partitionBy("run", "section_key").parquet(f"{path}/{name}")
        df.select("run", *unit).distinct().repartition(1).write.partitionBy("run").parquet(versions._units(path, unit))
    log = runlog.RunLog(spark, path)
    for _ in range(runs):
        run = log.claim()
        assert log.commit_run(log.state(), run, {n: SCHEMA.json() for n in ("articles", "compiled")})
    return made


def current(spark, path, size=None):
    return {n: rows(plan.read_archive(spark, path, n, size).select("section_key", "article_key", "text"), "section_key", "article_key")
            for n in ("articles", "compiled")}


def test_fifty_runs_merge_to_a_few(spark, tmp_path):
    path = str(tmp_path / "a")
    made = fill(spark, path, 50)
    log = runlog.RunLog(spark, path)
    newest = {k: (s, k, t) for _, s, k, _, t in made}
    unit = {(s, m): r for r, s, _, m, _ in made}
    want = {"articles": sorted(newest.values()), "compiled": sorted((s, k, t) for r, s, k, m, t in made if unit[s, m] == r)}
    assert current(spark, path) == want and len(log.state().versions) == 50
    reader = plan.read_archive(spark, path, "articles")  # begun before the merges
    before = log.state()
    merges = plan.compact_archive(spark, path, 10)
    state = log.state()
    assert len(state.versions) == 5 and len(merges) == 5 and state.last == 50
    assert current(spark, path) == want == current(spark, path, 30 + 20)  # and as of an earlier commit
    assert reader.count() == len(newest)
    # Superseded rows were not written again: what counts holds each key once per version at most.
    counted = sum(spark.read.parquet(f"{path}/articles/run={v.run}").count() for v in state.versions)
    assert len(newest) <= counted < len(made) and len(newest) == 55
    # A run that began before the merges commits after them; one that never does goes.
    late, dead = log.claim(), log.claim()
    one = spark.createDataFrame([("00", "k0", "m0", "late")], SCHEMA)
    for run in (late, dead):
        for name, unit in (("articles", ["section_key"]), ("compiled", ["section_key", "month"])):
            versions.write_run(one, path, name, run)
            versions.write_worked(one, path, run, unit)
    assert not log.commit_run(before, late, {}) and log.commit_run(log.state(), late, {})
    assert ("00", "k0", "late") in current(spark, path)["articles"]
    far = max(files.listed(spark, f"{path}/_log/claims").values())
    assert versions.drop_old(spark, path, now_ms=far, keep_ms=10**9) == []
    gone = versions.drop_old(spark, path, now_ms=far + 10, keep_ms=10)
    assert set(gone) == set(range(1, dead + 1)) - {v.run for v in log.state().versions} and dead in gone
    left = {int(n.removeprefix("run=")) for n in files.listed(spark, f"{path}/articles") if n.startswith("run=")}
    assert left == {v.run for v in log.state().versions}
    assert ("00", "k0", "late") in current(spark, path)["articles"]


def test_merges_at_the_same_time(spark, tmp_path):
    path = str(tmp_path / "a")
    fill(spark, path, 6)
    log = runlog.RunLog(spark, path)
    want = current(spark, path)
    covers = versions._mergeable(log.state(), 3)
    assert plan.compact_archive(spark, path, 3)
    run = log.claim()
    assert not log.commit_merge(covers, run)  # merged by another meanwhile
    assert current(spark, path) == want


PAGES = [("world", f"/{i}", f'<time datetime="2024-0{m}-03">x</time><p>text {i}</p>') for i, m in enumerate((1, 1, 2, 2, 3))]


def test_a_run_that_dies_before_its_commit(spark, tmp_path, monkeypatch):
    first = archive(spark, tmp_path, PAGES[:2])
    kept = rows(plan.read_manifest(spark, str(tmp_path)).select("section_key", "month", "level", "n_articles"), "level", "section_key", "month")
    assert ("world", "2024-01", 0, 2) in kept

    def dies(*_):
        raise RuntimeError("power cut")

    with monkeypatch.context() as m:
        m.setattr(runlog.RunLog, "commit_run", dies)
        with pytest.raises(RuntimeError):
            archive(spark, tmp_path, PAGES[2:], run=2)
    after = plan.read_manifest(spark, str(tmp_path)).select("section_key", "month", "level", "n_articles")
    assert rows(after, "level", "section_key", "month") == kept
    assert plan.read_archive(spark, str(tmp_path), "articles").count() == 2 and members(first) == members(first)
    third = archive(spark, tmp_path, PAGES[4:], run=3)
    assert third.articles.count() == 3 and {r[1] for r in members(third)} == {"2024-01", "2024-03"}


def test_two_runs_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    archive(spark, tmp_path / "both", PAGES[:1])
    write, done = plan.write_manifest, []

    def interrupted(df, path):
        write(df, path)
        if not done:  # all of another run happens before this one can commit
            done.append(1)
            done.append(archive(spark, tmp_path / "both", [PAGES[1], ("crime", "/c", "<p>c</p>")], run=3))

    monkeypatch.setattr(plan, "write_manifest", interrupted)
    late = archive(spark, tmp_path / "both", PAGES[2:], run=2)
    assert late.run == 2 and done[1].run == 3
    monkeypatch.undo()
    whole = archive(spark, tmp_path / "one", [*PAGES, ("crime", "/c", "<p>c</p>")])
    assert members(late) == members(whole) and late.articles.count() == 6
    for name in ("compiled", "parts"):
        columns = [c for c in ("section_key", "month", "position", "part_no", "article_key", "body") if c in plan.read_archive(spark, str(tmp_path / "one"), name).columns]
        got, want = (rows(plan.read_archive(spark, str(tmp_path / d), name).select(*columns), *columns) for d in ("both", "one"))
        assert got == want
    manifest = lambda d: rows(plan.read_manifest(spark, str(tmp_path / d)).select("level", "section_key", "month", "n_articles", "n_bytes"), "level", "section_key", "month")
    assert manifest("both") == manifest("one")


def test_one_new_page_sorts_one_month(spark, tmp_path):
    archive(spark, tmp_path / "a", PAGES)
    new = ("world", "/new", '<time datetime="2024-02-01">x</time><p>new</p>')
    result = archive(spark, tmp_path / "a", [new], run=2)
    full = archive(spark, tmp_path / "b", [*PAGES, new])
    assert members(result) == members(full)
    anew = spark.read.parquet(f"{tmp_path}/a/compiled/run=2")
    assert rows(anew.select("section_key", "month").distinct()) == [("world", "2024-02")] and anew.count() == 3
    assert rows(result.parts.select("month", "body"), "month") == rows(full.parts.select("month", "body"), "month")
    # A changed text of equal size is a change too; a month that loses its only article goes.
    again = archive(spark, tmp_path / "a", [("world", "/4", '<time datetime="2024-01-09">x</time><p>text 9</p>')], run=3)
    assert {r[1] for r in members(again)} == {"2024-01", "2024-02"} and len(members(again)) == 6
    assert rows(spark.read.parquet(f"{tmp_path}/a/compiled/run=3").select("month").distinct()) == [("2024-01",)]
    same = archive(spark, tmp_path / "a", [new], run=4)
    assert members(same) == members(again) and set(files.listed(spark, f"{tmp_path}/a/compiled/run=4")) <= {"_SUCCESS"}


def test_months_that_nothing_tells(spark, tmp_path):
    df = spark.createDataFrame([("s", None, 1, "x"), ("s", "2024-01", 2, "y"), (None, None, 1, "z")], "section_key string, month string, n bigint, digest string")
    changed, gone = plan.compilation.changed_groups(df, df.where("n = 2 or section_key is null").withColumn("digest", F.lit("y")))
    assert rows(changed.select("section_key", "month"), "section_key") == [(None, None), ("s", None)] and gone.count() == 0
