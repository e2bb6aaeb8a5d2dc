"""Layer discovery: pages and a source catalog to ranked links; fetch log and cache to a status."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira import fixed
from ribeira.functions.urls import file_suffix
from ribeira.operators.filters import eligible_sources
from ribeira.operators.joins import require_unique
from ribeira.operators.landing import (
    accepted,
    cache_errors,
    error_log,
    fetch_errors,
    inspect_files,
    judge_files,
    landing_accept,
    overall_status,
    page_errors,
    settle_attempts,
    source_status,
    unfetched_errors,
    unread_files,
)
from ribeira.operators.ledger import COUNTED_ENTRY, merge_entries, merged_status, run_entries
from ribeira.operators.links import allowlist_semi, extract_links, link_score, links_union, registered_links, topk_links
from ribeira.operators.url_parts import split_url, with_file_name
from ribeira.session import materialize
from ribeira.sources.files import content_digest
from ribeira.sources.publication import Run, committed_runs


def rank_links(
    pages: DataFrame,
    catalog: DataFrame,
    keywords: Mapping[str, Sequence[str]] = fixed.SOURCE_KEYWORDS,
    k: int = fixed.MAX_CANDIDATES,
) -> DataFrame:
    """(source_id, url, score, rank): the best links of each eligible source.

    ``pages`` has (source_id, url, html); registered links are those listed in the catalog.
    """
    sources = eligible_sources(catalog, fixed.BOUNDARY_SOURCE)
    found = extract_links(pages)
    links = links_union(found.select("source_id", F.col("link").alias("url")), registered_links(sources), sources)
    return topk_links(link_score(split_url(links), keywords), k)


def inspect_cache(cached: DataFrame, catalog: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Cached files that count, with digest, archive members and verdict.

    ``listing`` (source_id, path, length) names every file of the cache, those too that Spark's
    readers pass over. ``cached`` has (source_id, path, length, content). Files are looked into where they are read, and
    only the findings are joined to the catalog, so that contents are never shuffled.
    """
    data_files = cached.filter(file_suffix(F.col("path")).isin(fixed.DATA_EXTENSIONS))
    digested = data_files.withColumn("sha256", content_digest(F.col("content")))
    inspected = inspect_files(digested, keep=["source_id", "sha256"])
    sources = eligible_sources(catalog, fixed.BOUNDARY_SOURCE)
    judged = judge_files(allowlist_semi(inspected, sources))
    if listing is None:
        return judged
    judged = materialize(judged, "cache")
    return judged.unionByName(unread_files(allowlist_semi(listing, sources), judged), allowMissingColumns=True)


def kept_files(judged: DataFrame) -> DataFrame:
    return judged.filter("ok").select("source_id", "path", F.col("length").alias("bytes"), "sha256", "members")


@dataclass(frozen=True)
class LayerResult:
    """The tables of one discovery run."""

    links: DataFrame
    downloads: DataFrame
    preserved: DataFrame
    errors: DataFrame
    status: DataFrame
    overall: DataFrame

    def write(self, out: str) -> None:
        """Each table as Parquet below ``out``; they stay flat, as a source may have any number of files."""
        for name in ("links", "downloads", "preserved", "errors", "status", "overall"):
            getattr(self, name).write.parquet(f"{out}/{name}")

    def publish(
        self, spark: SparkSession, out: str, run_id: str, run_at: datetime | None = None, root: str = "", page_log: DataFrame | None = None
    ) -> bool:
        """The tables, and the run's entries for the status over all runs, as one unit; false if this run id is committed already.

        ``root`` is the cache's folder, below which each source has its own.
        """
        run = Run(spark, out, run_id)
        if run.manifest() is not None:
            return False
        at = F.lit(run_at or datetime.now(timezone.utc))
        entries = run_entries(self.links, self.downloads, self.preserved, self.errors, run_id, at, root, page_log)
        tables = {name: getattr(self, name) for name in ("links", "downloads", "preserved", "errors", "status", "overall")}
        for name, df in {**tables, "entries": entries}.items():
            run.stage(name, df, lambda table, path: table.write.parquet(path))
        run.commit()
        return True


def status_over_runs(spark: SparkSession, out: str, sources: DataFrame) -> DataFrame:
    """Status per source over all committed runs below ``out``; what one run has downloaded and a later one finds in the cache counts once.

    Only the paths of the runs' tables reach the driver.
    """
    tables = committed_runs(spark, out).select(F.explode("tables").alias("t")).filter("t.name = 'entries'")
    paths = [row["path"] for row in tables.select("t.path").collect()]
    entries = spark.read.schema(COUNTED_ENTRY).parquet(*paths) if paths else spark.createDataFrame([], COUNTED_ENTRY)
    return merged_status(sources, merge_entries(entries))


def discover_layers(
    pages: DataFrame,
    catalog: DataFrame,
    fetch_log: DataFrame,
    cached: DataFrame,
    keywords: Mapping[str, Sequence[str]] = fixed.SOURCE_KEYWORDS,
    k: int = fixed.MAX_CANDIDATES,
    max_bytes: int = fixed.MAX_BYTES,
    page_log: DataFrame | None = None,
    listing: DataFrame | None = None,
) -> LayerResult:
    """Everything but the transfer itself, which the logs, ``cached`` and ``listing`` record (runs jobs).

    Every ranked link ends as a download or as an error: one without an attempt on record is an error
    too. A download has the ``path`` that it takes in its source's folder. Repeated source ids raise.

    Ranked links, settled fetches and inspected files are each used by several results, so they are
    written to the work folder once; page texts and file contents are read a single time. The cache
    is read before downloads are counted, so on a rerun one file can count on both sides of ``status``, that of this run alone; over several
    runs, ``publish`` and ``status_over_runs`` count it once.
    """
    require_unique(catalog, "source_id", "catalog")
    sources = eligible_sources(catalog, fixed.BOUNDARY_SOURCE)
    links = materialize(rank_links(pages, catalog, keywords, k), "links")
    attempts = fetch_log.join(links.select("source_id", "url", "rank"), ["source_id", "url"])
    fetched = materialize(settle_attempts(landing_accept(attempts, sources, max_bytes)), "fetched")
    judged = inspect_cache(cached, catalog, listing)
    if listing is None:
        judged = materialize(judged, "cache")
    errors = [fetch_errors(fetched), unfetched_errors(links, fetched), cache_errors(judged)]
    if page_log is not None:
        # the pages of sources that are limited to their registered links are not asked for
        asked = sources.filter(~F.coalesce(F.col("direct_urls_only"), F.lit(False))).select("source_id")
        errors.append(page_errors(page_log.join(asked, "source_id", "left_semi")))
    named = with_file_name(accepted(fetched), "__file", F.concat(F.lit("candidate_"), F.col("rank")), "resolved_url")
    downloads = named.withColumn("path", F.concat_ws("/", "source_id", "__file")).drop("__file")
    kept = kept_files(judged)
    errors = error_log(*errors)
    status = source_status(sources, links, downloads, kept, errors)
    return LayerResult(links=links, downloads=downloads, preserved=kept, errors=errors, status=status, overall=overall_status(status))
