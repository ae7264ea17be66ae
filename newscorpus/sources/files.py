"""Small files and folders on whatever file system a path names, from the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def listed(spark: SparkSession, path: str) -> dict[str, int]:
    """Names of what lies in a folder, with the times (ms) they were last changed; none if it is missing."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in system.listStatus(place)}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all in it; nothing happens if it is missing."""
    system, place = _at(spark, path)
    system.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str:
    system, place = _at(spark, path)
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a file with its whole content, unless it exists already: False then.

    Of several that try at once one succeeds, and no reader sees part of it. A local file appears by
    a hard link, others by a rename that does not replace; the file system must do that in one step,
    as HDFS does and plain object stores do not.
    """
    system, place = _at(spark, path)
    system.mkdirs(place.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        return _put_local(spark, draft, place) if system.getScheme() == "file" else _put(spark, system, draft, place)
    finally:
        system.delete(draft, False)


def _raised(error: Exception, name: str) -> bool:
    found = getattr(error, "java_exception", None)
    return name in (str(found) if found is not None else str(error))


def _put_local(spark: SparkSession, draft, place) -> bool:
    paths = spark._jvm.java.nio.file.Paths
    none = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0)
    to, of = (paths.get(p.toUri().getPath(), none) for p in (place, draft))
    try:
        spark._jvm.java.nio.file.Files.createLink(to, of)
    except Exception as error:
        if _raised(error, "FileAlreadyExists"):
            return False
        raise
    return True


def _put(spark: SparkSession, system, draft, place) -> bool:
    fs = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, place, options)
    except Exception as error:
        if _raised(error, "FileAlreadyExists"):
            return False
        raise
    return True
