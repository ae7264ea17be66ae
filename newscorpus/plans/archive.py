"""The whole archive run, from listing pages and stored pages to compilations and statistics."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newscorpus import values
from newscorpus.functions import keys
from newscorpus.operators import articles as records
from newscorpus.operators import cleaning, compilation, discovery, ingest, ledger
from newscorpus.operators.compilation import GROUP, KEY
from newscorpus.operators.keyed import broadcast_if_few, first_per_key, null_safe, one_copy
from newscorpus.schemas import MANIFEST
from newscorpus.session import shared_dir
from newscorpus.sources.runlog import RunLog, Version
from newscorpus.sources.tables import write_manifest
from newscorpus.sources.versions import SECTION, merge_versions, read_latest, read_merged, write_run, write_worked


#: Tables whose runs add up, by key, and those of which a unit's last run counts.
MERGED = {"articles": KEY, "times": KEY}
LATEST = {
    "links": SECTION, "pending": SECTION, "rejects": SECTION,
    "groups": GROUP, "compiled": GROUP, "parts": GROUP, "covers": GROUP,
}
DIGEST = "_digest"


@dataclass
class Archive:
    """What a run leaves behind, each a table below ``out_dir``: of all runs ``articles`` (rejects
    left out), ``compiled``, ``manifest``, ``covers``, ``parts`` and ``ledger``; of the sections of
    this run ``links``, ``pending`` and ``rejects``. ``articles`` of all runs are put together when
    they are asked for. ``run`` is the run's number."""

    run: int
    links: DataFrame
    pending: DataFrame
    read_articles: Callable[[], DataFrame]
    rejects: DataFrame
    compiled: DataFrame
    parts: DataFrame
    manifest: DataFrame
    covers: DataFrame
    ledger: DataFrame

    @cached_property
    def articles(self) -> DataFrame:
        return self.read_articles()


def lowered(df: DataFrame) -> DataFrame:
    return df.withColumn("section_key", F.lower("section_key"))


def discover(
    listings: DataFrame, run_ts: str, max_pages: int | None = None, outer: str = "h3"
) -> DataFrame:
    """Ranked links of listing pages (section_key, page_no, html); sections in any case are one."""
    if max_pages is not None:
        listings = listings.where(F.col("page_no") <= max_pages)
    seen = discovery.visible_markup(lowered(listings))
    scoped = discovery.scope_container(discovery.strip_chrome(seen, raw=False), raw=False)
    links = discovery.dedup_links(discovery.extract_links(scoped, outer=outer, raw=False))
    return discovery.stamp_run(discovery.discovery_rank(links), run_ts)


def sections_to_do(
    sections: DataFrame,
    names: list[str] | None,
    previous: DataFrame | None,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Keys of the sections a run works on: the named ones, known or not; else those of the
    dimension and those ``seen`` in the input that the ledger has not completed; else all of them."""
    if names is not None:
        rows = [(n.lower(),) for n in names]
        return sections.sparkSession.createDataFrame(rows, "section_key string").distinct()
    every = lowered(sections).select("section_key")
    every = (every if seen is None else every.unionAll(seen.select("section_key"))).distinct()
    return every if previous is None else ledger.resume_sections(every, previous)


def run_archive(
    spark: SparkSession,
    listings: DataFrame,
    pages: DataFrame,
    fetches: DataFrame,
    sections: DataFrame,
    out_dir: str,
    run_ts: str,
    names: list[str] | None = None,
    previous: DataFrame | None = None,
    fetch_log: DataFrame | None = None,
    max_pages: int | None = None,
    outer: str = "h3",
    row_id: str = "page_id",
    part_bytes: int = compilation.PART_BYTES,
    months: dict[str, int] | None = None,
) -> Archive:
    """Discover, clean, compile, account.

    ``pages`` has section_key, article_key, url, html; ``fetches`` says when each article was
    published and fetched; ``previous`` is the ledger to resume from, and ``fetch_log`` tells
    which listing pages a crawl got to use. Section keys count in any case.

    Pages are added to what earlier runs stored, and replace articles of the same key. An article's
    month follows its own date, else that of ``fetches``, else the time of fetching. Sections that
    this run does not work on stay as they are. Of those it works on, the months whose members,
    their order or their texts have changed are compiled anew; a compilation of which nothing is left
    goes, and the others stay as they were stored, with the covers they have.

    Nothing counts before the run's commit. Where another run committed first, all that depends on
    what is stored is made again on top of it, so runs at the same time lose nothing.

    HTML is never shuffled: which copy of a page counts is decided on keys, cleaning is map-only,
    and only cleaned rows are joined and written. Bodies are left out of ranking.
    """
    shared_dir(spark)
    listings, pages, fetches = lowered(listings), lowered(pages), lowered(fetches)
    seen = pages.select("section_key").distinct().unionAll(listings.select("section_key").distinct())
    chosen = sections_to_do(sections, names, previous, seen).checkpoint()
    # Without a choice every section is worked on; joining would only cost.
    few = broadcast_if_few(chosen) if names is not None or previous is not None else None

    def restricted(df: DataFrame) -> DataFrame:
        return df if few is None else df.join(few, "section_key", "left_semi")

    if fetch_log is not None:
        used = discovery.listing_stop(lowered(fetch_log), max_pages=max_pages)
        used = used.select("section_key", "page_no").distinct().checkpoint()
        listings = listings.join(broadcast_if_few(used), ["section_key", "page_no"], "left_semi")
    pages = restricted(pages)
    log = RunLog(spark, out_dir)
    started, run = log.state(), log.claim()
    schemas: dict[str, str] = {}

    def write(df: DataFrame, name: str) -> StructType:
        write_run(df, out_dir, name, run)
        schemas[name] = df.schema.json()
        return df.schema

    write_worked(chosen, out_dir, run)
    # What the run brings, whatever other runs do meanwhile.
    links_schema = write(discover(restricted(listings), run_ts, max_pages, outer), "links")
    links = read_latest(spark, out_dir, "links", links_schema, [Version(0, run)])
    ranked = links.withColumn("article_key", keys.article_key(F.col("url")))
    cleaned = one_copy(records.article_records(pages, months=months), KEY, row_id, ids=pages)
    article_schema = write(cleaned.withColumn(DIGEST, F.xxhash64(*cleaned.columns)), "articles")
    # Times are kept as well: those of pages that earlier runs brought are still needed.
    time_schema = write(restricted(first_per_key(fetches, KEY, ["fetched_at"])), "times")

    # What follows from it and from all that is committed; made again if another run was faster.
    while True:
        state = log.state()
        versions = [*state.versions, Version(state.size + 1, run)]

        def latest(name: str, schema: StructType, of: list[Version] = versions) -> DataFrame:
            return read_latest(spark, out_dir, name, schema, of, LATEST[name])

        every = read_merged(spark, out_dir, "articles", article_schema, KEY, versions, few)
        stored, failed = cleaning.cleaning_rejects(every)
        pending_schema = write(ingest.pending_articles(links, every), "pending")
        reject_schema = write(failed.drop("body", DIGEST), "rejects")
        times = read_merged(spark, out_dir, "times", time_schema, KEY, versions, few)
        dated = (
            compilation.skip_unreadable(stored)
            .drop("body")
            .join(times.withColumnRenamed("published_at", "_published"), KEY, "left")
            .withColumn("published_at", F.coalesce("published_at", F.col("_published").cast("timestamp_ntz")))
            .drop("_published")
        )
        members = compilation.publication_month(compilation.with_rank(dated, ranked)).checkpoint()
        groups = compilation.group_sums(members, DIGEST)
        before = restricted(latest("groups", groups.schema, list(state.versions)))
        changed, gone = compilation.changed_groups(groups, before)
        changed = changed.checkpoint()
        write_worked(changed.select(*GROUP).unionAll(gone), out_dir, run, GROUP)
        anew = broadcast_if_few(changed.select(*GROUP))
        group_schema = write(changed, "groups")
        placed = compilation.place_members(null_safe(members.drop(DIGEST), anew, GROUP, "left_semi"))
        compiled_schema = write(placed, "compiled")
        own = read_latest(spark, out_dir, "compiled", compiled_schema, versions[-1:], GROUP)
        part_schema = write(compilation.compile_body(own, stored, part_bytes), "parts")
        cover_schema = write(compilation.cover_rows(own, sections, run_ts, values.ARCHIVE_TITLE), "covers")

        manifest = compilation.manifest_of(latest("groups", group_schema), sections)
        write_manifest(manifest, f"{out_dir}/manifest/run={run}")
        ledger_rows = next_ledger(links, chosen, previous, run_ts)
        if state.size > started.size:  # what runs that committed meanwhile have completed
            theirs = spark.read.schema(ledger_rows.schema).parquet(f"{out_dir}/ledger/run={state.last}")
            ledger_rows = ledger.update_ledger(theirs, ledger_rows)
        ledger_rows.write.mode("overwrite").parquet(f"{out_dir}/ledger/run={run}")
        if log.commit_run(state, run, schemas):
            break

    def articles() -> DataFrame:
        merged = read_merged(spark, out_dir, "articles", article_schema, KEY, versions)
        return cleaning.cleaning_rejects(merged)[0].drop(DIGEST)

    return Archive(
        run=run,
        links=links,
        pending=restricted(latest("pending", pending_schema)),
        read_articles=articles,
        rejects=restricted(latest("rejects", reject_schema)),
        compiled=latest("compiled", compiled_schema),
        parts=latest("parts", part_schema),
        manifest=manifest,
        covers=latest("covers", cover_schema),
        ledger=spark.read.schema(ledger_rows.schema).parquet(f"{out_dir}/ledger/run={run}"),
    )


def compact_archive(spark: SparkSession, out_dir: str, fan: int = 4) -> list[int]:
    """Merge the versions that runs have left, see ``merge_versions``; runs and readers may go on."""
    return merge_versions(spark, out_dir, MERGED, LATEST, fan)


def read_archive(spark: SparkSession, out_dir: str, name: str, size: int | None = None) -> DataFrame:
    """A table of the committed archive, now or as it was after its first ``size`` commits.

    ``name`` is one of MERGED or LATEST. Keys are strings.
    """
    state = RunLog(spark, out_dir).state(size)
    if name not in state.schemas:
        raise ValueError(f"no table {name!r} in {out_dir}")
    schema = StructType.fromJson(json.loads(state.schemas[name]))
    if name in MERGED:
        return read_merged(spark, out_dir, name, schema, MERGED[name], state.versions).drop(DIGEST)
    return read_latest(spark, out_dir, name, schema, state.versions, LATEST[name])


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """The manifest of the last committed run."""
    run = RunLog(spark, out_dir).state().last
    return spark.read.schema(MANIFEST).option("header", True).csv(f"{out_dir}/manifest/run={run}")


def next_ledger(
    links: DataFrame, sections: DataFrame, previous: DataFrame | None, run_ts: str
) -> DataFrame:
    """Every section worked on is completed, also one that turned out to have no links."""
    found = links.groupBy("section_key").agg(F.count("*").alias("n"))
    worked = lowered(sections).select("section_key", F.lit(0).cast("bigint").alias("n"))
    counts = (
        found.unionByName(worked).groupBy("section_key").agg(F.sum("n").alias("n_links"))
    )
    rows = ledger.completed_rows(counts, run_ts)
    return rows if previous is None else ledger.update_ledger(previous, rows)
