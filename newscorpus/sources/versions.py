"""Tables that grow by runs: each run writes a version of its own, readers see the current rows.

Below the archive's path, ``T/run=N/section_key=S`` has what run N wrote to table T, and
``_worked/U/run=N`` the units U (sections, or section and month) it worked on: a unit of which a later
run found nothing shows nothing. Which versions count is for the log to say (``runlog``). Keys are
read as strings, whatever they look like.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from newscorpus.operators.keyed import broadcast_if_few, null_safe, one_copy
from newscorpus.sources import files
from newscorpus.sources.runlog import RunLog, State, Version

SECTION = ["section_key"]


def write_run(df: DataFrame, path: str, name: str, run: int) -> None:
    """Store the rows of a run, in place of what it stored in this table before.

    Rebalancing gathers small pieces of a section and splits one too large for a task.
    """
    spark = df.sparkSession
    files.remove(spark, f"{path}/{name}/run={run}")
    rows = df.hint("rebalance", F.col("section_key"))
    rows.write.partitionBy("section_key").parquet(f"{path}/{name}/run={run}")


def _units(path: str, unit: list[str]) -> str:
    return f"{path}/_worked/{'-'.join(unit)}"


def write_worked(units: DataFrame, path: str, run: int, unit: list[str] = SECTION) -> None:
    """Store the units that a run worked on."""
    units.select(*unit).distinct().coalesce(1).write.mode("overwrite").parquet(f"{_units(path, unit)}/run={run}")


def _read(spark: SparkSession, path: str, fields: list[StructField], versions: Iterable[Version]) -> DataFrame:
    """Rows of these versions with ``run``."""
    schema = StructType([f for f in fields if f.name != "run"] + [StructField("run", LongType())])
    paths = [p for v in versions if files.exists(spark, p := f"{path}/run={v.run}")]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*paths)


def _order(versions: Iterable[Version]) -> Column:
    """The order of a row's version; a literal per version that counts, which merging keeps few."""
    pairs = [F.lit(x).cast("long") for v in versions for x in (v.run, v.order)]
    return F.element_at(F.create_map(*pairs), F.col("run")) if pairs else F.lit(0).cast("long")


def worked_units(spark: SparkSession, path: str, versions: Iterable[Version], unit: list[str] = SECTION) -> DataFrame:
    """For each unit the last version that worked on it: unit, run."""
    versions = list(versions)
    found = _read(spark, _units(path, unit), [StructField(c, StringType()) for c in unit], versions)
    last = F.max(F.struct(_order(versions).alias("order"), "run"))
    return found.groupBy(*unit).agg(last.alias("_last")).select(*unit, F.col("_last.run").alias("run"))


def read_latest(
    spark: SparkSession, path: str, name: str, schema: StructType, versions: Iterable[Version], unit: list[str] = SECTION
) -> DataFrame:
    """Of each unit the rows of the last version that worked on it."""
    versions = list(versions)
    rows = _read(spark, f"{path}/{name}", schema.fields, versions)
    if len(versions) < 2:
        return rows.select(*schema.names)
    worked = worked_units(spark, path, versions, unit)
    return null_safe(rows, broadcast_if_few(worked), [*unit, "run"], "left_semi").select(*schema.names)


def read_merged(
    spark: SparkSession, path: str, name: str, schema: StructType, keys: list[str], versions: Iterable[Version],
    within: DataFrame | None = None,
) -> DataFrame:
    """Rows of all versions, of rows with equal keys that of the last; ``within`` names the sections.

    A version has each key once.
    """
    versions = list(versions)
    rows = _read(spark, f"{path}/{name}", schema.fields, versions)
    if within is not None:
        rows = rows.join(within, "section_key", "left_semi")
    if len(versions) < 2:
        return rows.select(*schema.names)
    return one_copy(rows.withColumn("_age", -_order(versions)), keys, "_age").select(*schema.names)


def merge_versions(
    spark: SparkSession, path: str, merged: dict[str, list[str]], latest: dict[str, list[str]], fan: int = 4
) -> list[int]:
    """Merge versions level by level until fewer than ``fan`` neighbours of a level are left.

    ``merged`` names the tables whose rows add up, with their keys; ``latest`` those of which a unit's
    last version counts, with their units. Superseded rows are not written again; rows are written
    once per level, so the cost of a run is a logarithm of the number of runs. Runs and readers go on
    meanwhile: old versions stay until ``drop_old``. Returns the numbers of the merges.
    """
    log = RunLog(spark, path)
    done: list[int] = []
    while (covers := _mergeable(log.state(), fan)) is not None:
        state, run = log.state(), log.claim()
        for name, text in state.schemas.items():
            schema = StructType.fromJson(json.loads(text))
            if name in merged:
                rows = read_merged(spark, path, name, schema, merged[name], covers)
            else:
                rows = read_latest(spark, path, name, schema, covers, latest[name])
            write_run(rows, path, name, run)
        for unit in ([*u] for u in {tuple(u) for u in latest.values()}):
            write_worked(worked_units(spark, path, covers, unit), path, run, unit)
        if not log.commit_merge(covers, run):
            break  # another merge was faster; what this one wrote goes with ``drop_old``
        done.append(run)
    return done


def _mergeable(state: State, fan: int) -> tuple[Version, ...] | None:
    """The first neighbours of one level that are ``fan`` or more."""
    held: list[Version] = []
    for version in [*sorted(state.versions), None]:
        if version is not None and (not held or version.level == held[0].level):
            held.append(version)
            continue
        if len(held) >= fan:
            return tuple(held[:fan])
        held = [version] if version else []
    return None


def drop_old(spark: SparkSession, path: str, now_ms: int, keep_ms: int = 24 * 3600 * 1000) -> list[int]:
    """Delete what does not count any more: versions merged, and runs begun and never committed, both
    at least ``keep_ms`` before ``now_ms`` (by the claim of the merge, or of the run).

    Readers and runs that began after that keep their files. Returns the runs deleted.
    """
    log = RunLog(spark, path)
    state = log.state()
    claims = {int(n): at for n, at in files.listed(spark, f"{log.path}/claims").items() if n.isdigit()}
    merged_at: dict[int, int] = {}
    for name in files.listed(spark, log.path):
        if name.endswith(".json") and '"merge"' in (text := files.read_text(spark, f"{log.path}/{name}")):
            entry = json.loads(text)
            merged_at |= {r: claims.get(entry["run"], 0) for r in entry["covers"]}
    old = [run for run, at in sorted(claims.items()) if run not in state.runs() and now_ms - merged_at.get(run, at) >= keep_ms]
    for run in old:
        kept = () if run != state.last else ("manifest", "ledger")
        units = [f"_worked/{n}" for n in files.listed(spark, f"{path}/_worked")]
        for name in (*state.schemas, *units, *{"manifest", "ledger"}.difference(kept)):
            files.remove(spark, f"{path}/{name}/run={run}")
    return old
