"""Trees of ``<section>/<name>.html`` files as a Spark data source, for batches and streams.

    spark.read.format("page_tree").load("/store").where("section_key = 'world'")

Sections are folders, so a filter on ``section_key`` (equality, ``in`` or null) lists only the folders
it names. Files of a section are dealt out to partitions by size. Paths are those of a file system
that pyarrow opens; the driver lists, executors read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, In, InputPartition,
)
from pyspark.sql.types import StructType

SCHEMA = "section_key string, short_key string, html string"
SUFFIX = ".html"
#: Bytes of files of a partition, and of a batch of rows, one file more at most.
PART_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: Nanoseconds a file has to be old before a stream takes it, so that none of its time comes later.
SETTLED = 1_000_000_000


@dataclass
class FilePart(InputPartition):
    root: str
    section: str
    names: tuple[str, ...]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is local."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _list(root: str, sections: list[str] | None) -> Iterator[tuple[str, fs.FileInfo]]:
    """(section, file) of the wanted sections, by name; sections are asked for by folder."""
    system, base = _open(root)
    if sections is None:
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        folders = sorted(i.base_name for i in found if i.type == fs.FileType.Directory and not i.base_name.startswith(("_", ".")))
    else:
        folders = sorted({quote(s, safe=" ") for s in sections} | set(sections) - {""})
    for folder in folders:
        if "/" in folder or folder in (".", ".."):
            continue
        files = system.get_file_info(fs.FileSelector(f"{base}/{folder}", allow_not_found=True))
        for info in sorted(files, key=lambda i: i.base_name):
            if info.type == fs.FileType.File and info.base_name.endswith(SUFFIX) and not info.base_name.startswith("."):
                yield folder, info


def _parts(root: str, found: Iterator[tuple[str, fs.FileInfo]], part_bytes: int = PART_BYTES) -> list[FilePart]:
    parts: list[FilePart] = []
    held: list[str] = []
    section, size = None, 0
    for folder, info in found:
        if held and (folder != section or size >= part_bytes):
            parts.append(FilePart(root, section, tuple(held)))
            held, size = [], 0
        section = folder
        held.append(info.base_name)
        size += info.size or 0
    if held:
        parts.append(FilePart(root, section, tuple(held)))
    return parts


def _read(part: FilePart) -> Iterator[pa.RecordBatch]:
    """Rows of the files of a part; a file that has gone meanwhile is passed over."""
    system, base = _open(part.root)
    names = ["section_key", "short_key", "html"]
    rows: list[tuple[str, str, str]] = []
    size = 0
    for name in part.names:
        try:
            with system.open_input_stream(f"{base}/{part.section}/{name}", compression=None) as file:
                data = file.read()
        except FileNotFoundError:
            continue
        rows.append((unquote(part.section), unquote(name.removesuffix(SUFFIX)), data.decode(errors="replace")))
        size += len(data)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)


class TreeReader(DataSourceReader):
    def __init__(self, root: str, part_bytes: int):
        self.root, self.part_bytes, self.sections = root, part_bytes, None

    def pushFilters(self, filters):
        for f in filters:
            wanted = None
            if isinstance(f, (EqualTo, EqualNullSafe)) and f.attribute == ("section_key",):
                wanted = {f.value} - {None}
            elif isinstance(f, In) and f.attribute == ("section_key",):
                wanted = set(f.value) - {None}
            if wanted is None:
                yield f
            else:
                self.sections = sorted(wanted if self.sections is None else wanted & set(self.sections))

    def partitions(self) -> list[FilePart]:
        return _parts(self.root, _list(self.root, self.sections), self.part_bytes) or [FilePart(self.root, "", ())]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        return _read(partition)


class TreeStream(DataSourceStreamReader):
    """Files by the time they were last changed; a file changed again comes again."""

    def __init__(self, root: str, part_bytes: int, settled: int):
        self.root, self.part_bytes, self.settled = root, part_bytes, settled

    def initialOffset(self) -> dict:
        return {"changed_ns": 0}

    def latestOffset(self) -> dict:
        import time

        limit = time.time_ns() - self.settled
        return {"changed_ns": max((i.mtime_ns for _, i in _list(self.root, None) if i.mtime_ns <= limit), default=0)}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        new = (x for x in _list(self.root, None) if start["changed_ns"] < x[1].mtime_ns <= end["changed_ns"])
        return _parts(self.root, new, self.part_bytes)

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        pass


class PageTree(DataSource):
    """Options: ``path``, ``partBytes`` (64 MiB), ``settledMs`` (1000; streams only)."""

    @classmethod
    def name(cls) -> str:
        return "page_tree"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        if "path" not in self.options:
            raise ValueError("page_tree needs a path")
        return self.options["path"].rstrip("/"), int(self.options.get("partBytes", PART_BYTES))

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(*self._options())

    def streamReader(self, schema: StructType) -> TreeStream:
        return TreeStream(*self._options(), int(self.options.get("settledMs", SETTLED // 1_000_000)) * 1_000_000)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageTree)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("page_tree").load(path)


def stream_tree(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("page_tree").load(path)


def write_tree(pages: DataFrame, path: str) -> DataFrame:
    """Store pages (section_key, short_key, html) as files; returns the files and bytes of each section.

    A file appears whole, under its own name, so a task that runs again writes the same files. Of
    pages with equal section and key one stays, the one of the greatest html; a null html is an empty
    file, and pages without section or key have no place and are left out. The work is done when
    this returns.
    """
    named = pages.where("section_key <> '' and short_key <> ''").groupBy("section_key", "short_key")
    one = named.agg(F.coalesce(F.max("html"), F.lit("")).alias("html"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, base = _open(path)
        for batch in batches:
            done: dict[str, list[int]] = {}
            for section, key, html in zip(*(c.to_pylist() for c in batch.columns)):
                folder, data = f"{base}/{quote(section, safe=' ')}", html.encode()
                system.create_dir(folder, recursive=True)
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft, compression=None) as file:
                    file.write(data)
                system.move(draft, f"{folder}/{quote(key, safe=' ')}{SUFFIX}")
                total = done.setdefault(section, [0, 0])
                total[0] += 1
                total[1] += len(data)
            columns = [list(done), [n for n, _ in done.values()], [b for _, b in done.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["section_key", "n", "b"])

    stored = one.select("section_key", "short_key", "html").mapInArrow(store, "section_key string, n long, b long").checkpoint()
    return stored.groupBy("section_key").agg(F.sum("n").alias("n_files"), F.sum("b").alias("n_bytes"))
