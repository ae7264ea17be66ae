"""HTML trees as a data source: pruning, partitions, odd names, streams."""

from __future__ import annotations

import os

from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from newscorpus.sources import tree

PAGES = [("world", "a1", "<p>a</p>"), ("world", "a2", None), ("World/x", "b:1", "é😀"), ("crime", "c", "c" * 500), ("crime", "c", "b"), (None, "d", "x"), ("e", "", "x")]


def stored(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    df = spark.createDataFrame([(*r, 1) for r in PAGES], "section_key string, short_key string, html string, n int")
    told = tree.write_tree(df, str(tmp_path / "t"))
    assert rows(told, "section_key") == [("World/x", 1, 6), ("crime", 1, 500), ("world", 2, 8)]
    return str(tmp_path / "t")


def test_what_is_written_is_read(spark, tmp_path):
    path = stored(spark, tmp_path)
    (tmp_path / "t" / "world" / "note.txt").write_text("no page")
    (tmp_path / "t" / "empty").mkdir()
    want = [("World/x", "b:1", "é😀"), ("crime", "c", "c" * 500), ("world", "a1", "<p>a</p>"), ("world", "a2", "")]
    assert rows(tree.read_tree(spark, path), "section_key", "short_key") == want
    assert rows(tree.read_tree(spark, "file://" + path).select("section_key").distinct(), "section_key") == [("World/x",), ("crime",), ("world",)]
    assert tree.read_tree(spark, str(tmp_path / "nowhere")).count() == 0


def test_a_filter_lists_only_its_folder(spark, tmp_path):
    path = stored(spark, tmp_path)
    df = tree.read_tree(spark, path)
    assert rows(df.where("section_key = 'world'").select("short_key"), "short_key") == [("a1",), ("a2",)]
    assert rows(df.where(F.col("section_key").isin("World/x", "none", "crime")).select("short_key"), "short_key") == [("b:1",), ("c",)]
    assert df.where("section_key = 'world' and section_key = 'crime'").count() == 0 == df.where("section_key = '..'").count()
    assert df.where("section_key = 'world' and length(html) > 3").count() == 1
    reader = tree.TreeReader(path, 1)
    rest = list(reader.pushFilters([EqualTo(("section_key",), "world"), GreaterThan(("html",), "x"), In(("section_key",), ("world", "crime"))]))
    assert rest == [GreaterThan(("html",), "x")] and reader.sections == ["world"]
    assert [(p.section, p.names) for p in reader.partitions()] == [("world", ("a1.html",)), ("world", ("a2.html",))]


def test_only_asked_for_folders_are_listed(monkeypatch, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.html").write_text(name)
    asked = []

    class Watched:
        def __init__(self):
            self.inner = tree.fs.LocalFileSystem()

        def get_file_info(self, what):
            asked.append(os.path.basename(what.base_dir))
            return self.inner.get_file_info(what)

    monkeypatch.setattr(tree, "_open", lambda path: (Watched(), path))
    assert [f for f, _ in tree._list(str(tmp_path), ["b"])] == ["b"] and asked == ["b"]


def test_as_a_stream(spark, tmp_path):
    path = stored(spark, tmp_path)
    os.utime(f"{path}/crime/c.html", (1, 1))

    def run():
        found = []
        tree.register(spark)
        stream = spark.readStream.format("page_tree").option("settledMs", "0").load(path)
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        query.foreachBatch(lambda df, _: found.extend(r["short_key"] for r in df.collect())).start().awaitTermination()
        return sorted(found)

    assert run() == ["a1", "a2", "b:1", "c"]
    (tmp_path / "t" / "world" / "new.html").write_text("n")
    assert run() == ["new"] and run() == []
