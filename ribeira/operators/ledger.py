"""Status over several discovery runs: each run leaves entries, and entries merge.

An entry says what became of one item of a source in one run: a link that was found, a fetch, a cached file, a page. Merged, an item has
one entry, that of its latest run. Merging is a maximum per key, so it can be done in any order and any number of times, entries that are merged
already included, and a file that one run has downloaded and the next one finds in the cache counts once. A run may report the same error of
an item several times, as of pages that share a URL: its entry has their number (``times``), as the run's own status counts each of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribeira.operators.landing import NOT_FETCHED

ENTRY = "source_id STRING, kind STRING, item STRING, outcome STRING, path STRING, run_at TIMESTAMP, run_id STRING"
# What ``run_entries`` gives; entries without ``times``, or with null there, count once.
COUNTED_ENTRY = ENTRY + ", times BIGINT"
KEY = ["source_id", "kind", "item"]
# The stages of the error log, by the kind of item that they are about.
KINDS = {"download": "fetch", "cache_validation": "cache", "page": "page"}


def relative_path(path: Column, root: str) -> Column:
    """A path without the folder ``root`` that it lies in, as downloads are named."""
    folder = root.rstrip("/") + "/" if root else ""
    return F.when(F.startswith(path, F.lit(folder)), F.substring(path, F.lit(len(folder) + 1), F.length(path))).otherwise(path)


def run_entries(
    links: DataFrame, downloads: DataFrame, preserved: DataFrame, errors: DataFrame,
    run_id: str, run_at: Column, root: str = "", page_log: DataFrame | None = None,
) -> DataFrame:
    """The entries of one run, from its tables. ``root`` is the cache's folder, below which each source has its own.

    Equal errors are one entry, with their number: the run knows all of them, so merging it again can't count them twice. With a ``page_log``, pages that have answered are entries too, so that the error of an earlier run ends with them.
    """
    def rows(df: DataFrame, kind: Column, item: Column, outcome: Column, path: Column) -> DataFrame:
        return df.select(
            "source_id", kind.alias("kind"), item.alias("item"), outcome.alias("outcome"), path.cast("string").alias("path"),
            run_at.cast("timestamp").alias("run_at"), F.lit(run_id).alias("run_id"),
        )

    stage = F.col("stage")
    kind = reduce(lambda c, pair: c.when(stage == pair[0], pair[1]), KINDS.items(), F.when(F.lit(False), ""))
    file = relative_path(F.col("path"), root)
    failed = F.when(F.col("type") == NOT_FETCHED, NOT_FETCHED).otherwise("error")
    parts = [
        rows(links, F.lit("link"), F.col("url"), F.lit("discovered"), F.lit(None)),
        rows(downloads, F.lit("fetch"), F.col("url"), F.lit("downloaded"), file),
        rows(preserved, F.lit("cache"), file, F.lit("preserved"), file),
    ]
    if page_log is not None:
        answered = page_log.filter(F.col("error").isNull() & F.col("http_status").between(200, 299))
        parts.append(rows(answered, F.lit("page"), F.col("url"), F.lit("answered"), F.lit(None)))
    reported = rows(errors, kind, F.when(stage == "cache_validation", file).otherwise(F.col("url")), failed, file)
    counted = reported.groupBy(*reported.columns).agg(F.count(F.lit(1)).alias("times"))
    return reduce(DataFrame.unionByName, parts).withColumn("times", F.lit(1).cast("bigint")).unionByName(counted)


def merge_entries(*entries: DataFrame) -> DataFrame:
    """One entry per item: that of the latest run, where "no attempt on record" gives way to any real outcome, whenever it was.

    Within one run an error goes before another outcome of the same item. The result has the columns of its input, and ``times``.
    """
    told = F.struct(
        (F.col("outcome") != NOT_FETCHED).alias("tried"), "run_at", "run_id", (F.col("outcome") == "error").alias("failed"), "outcome", "path", "times"
    )
    both = reduce(DataFrame.unionByName, [_counted(df) for df in entries])
    latest = both.groupBy(*KEY).agg(F.max(told).alias("__told"))
    return latest.select(*KEY, *[F.col(f"__told.{name}").alias(name) for name in ("outcome", "path", "run_at", "run_id", "times")])


def _counted(entries: DataFrame) -> DataFrame:
    times = F.coalesce("times", F.lit(1)) if "times" in entries.columns else F.lit(1)
    return entries.withColumn("times", times.cast("bigint"))


def merged_status(sources: DataFrame, merged: DataFrame) -> DataFrame:
    """Per source: what was found, downloaded, preserved and has failed over all merged runs, and the resulting status.

    A file counts once: as downloaded if some run has fetched it, else as preserved. Links that deliver a file of the same name count each, as
    in the status of a run. A file found broken in a later run than that of its download is an error and no longer available; one downloaded again, in
    the same run or later, is. A source without entries has failed. All groupings have partial aggregates.
    """
    merged = _counted(merged)
    fetched, cached = (F.col("kind") == "fetch") & (F.col("outcome") == "downloaded"), F.col("kind") == "cache"
    # first by run, so that a file has no more rows than runs, however many links deliver it
    by_run = (
        merged.filter(fetched | cached)
        .groupBy("source_id", F.coalesce("path", "item").alias("path"), "run_at")
        .agg(
            F.count_if(fetched).alias("links"),
            F.max(F.when(cached & (F.col("outcome") == "preserved"), F.col("run_at"))).alias("sound"),
            F.max(F.when(cached & (F.col("outcome") != "preserved"), F.struct("run_at", "times"))).alias("broken"),
        )
    )
    files = by_run.groupBy("source_id", "path").agg(
        F.collect_list(F.when(F.col("links") > 0, F.struct("run_at", "links"))).alias("got"), F.max("sound").alias("sound"), F.max("broken").alias("broken")
    )
    valid = F.filter("got", lambda g: F.coalesce(g["run_at"] >= F.col("broken.run_at"), F.lit(True)))
    states = files.withColumn("links", F.aggregate(valid, F.lit(0).cast("bigint"), lambda n, g: n + g["links"])).select(
        "source_id",
        F.when(F.col("links") > 0, "downloaded").when(F.col("broken").isNotNull(), "errors").when(F.col("sound").isNotNull(), "preserved").alias("state"),
        F.when(F.col("links") > 0, F.col("links")).otherwise(F.coalesce("broken.times", F.lit(1))).alias("times"),
    )
    others = merged.filter(~fetched & ~cached & (F.col("outcome") != "answered")).select(
        "source_id", F.when(F.col("kind") == "link", "discovered").otherwise("errors").alias("state"), "times"
    )
    rows = states.unionByName(others).unionByName(
        sources.select("source_id", F.lit(None).cast("string").alias("state"), F.lit(0).cast("bigint").alias("times"))
    )
    names = ("discovered", "downloaded", "preserved", "errors")
    counts = [F.coalesce(F.sum(F.when(F.col("state") == name, F.col("times"))), F.lit(0)).alias(name) for name in names]
    available = F.col("downloaded") + F.col("preserved")
    return rows.groupBy("source_id").agg(*counts).withColumns(
        {"available": available, "status": F.when(available > 0, "success").otherwise("failed")}
    )
