"""Landed files and fetch logs: inspection, acceptance, error log and status roll-ups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ribeira.fixed import MAX_BYTES
from ribeira.functions.urls import file_suffix
from ribeira.operators.quality import unique_by
from ribeira.operators.url_parts import PARTS, promises_data, split_url
from ribeira.sources.files import content_parts

ABSENT = "missing_or_empty"
TRANSPORT_ERROR, HTTP_ERROR, NOT_FETCHED, NOT_READ = "transport_error", "http_error", "not_fetched", "not_read"
JSON_SUFFIXES = (".json", ".geojson")
# An archive's closing record is at most this far from its end: 22 bytes and a comment of up to 65,535.
ARCHIVE_END, ARCHIVE_END_BYTES = b"PK\x05\x06", 65_557


def inspect_files(files: DataFrame, limit: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Files with what only their bytes tell: ``is_zip``, ``is_json``, archive ``members`` and their ``member_count``.

    ``files`` has (path, length, content). What makes a ZIP archive or a JSON text is taken from
    Python's own modules, so this is an Arrow pass over the file rows, about a megabyte of contents at a time.
    Only contents that end like an archive, or have a JSON suffix, are sent there. ``is_json`` is
    worked out for JSON suffixes only. All members are listed; with a ``limit``, the count is still of all.
    """
    cut = content_parts()
    suffix, content = file_suffix(F.col("path")), F.col("content")
    archive_end = F.contains(F.substring(content, -ARCHIVE_END_BYTES, ARCHIVE_END_BYTES), F.lit(ARCHIVE_END))
    wanted = F.when(archive_end | suffix.isin(*JSON_SUFFIXES), content).alias("content")
    inputs = files.select("path", *keep, "length", suffix.alias("suffix"), wanted)
    passed = [name for name in inputs.columns if name != "content"]
    schema = T.StructType(
        [inputs.schema[name] for name in passed]
        + [
            T.StructField("is_zip", T.BooleanType()),
            T.StructField("is_json", T.BooleanType()),
            T.StructField("members", T.ArrayType(T.StringType())),
            T.StructField("member_count", T.IntegerType()),
        ]
    )

    def inspect(batches: Iterator) -> Iterator:
        import io
        import json
        import zipfile

        import pyarrow as pa

        def read_zip(content: bytes):
            data = io.BytesIO(content)
            if not zipfile.is_zipfile(data):
                return False, []
            try:
                with zipfile.ZipFile(data) as archive:
                    return True, archive.namelist()
            except (zipfile.BadZipFile, NotImplementedError, UnicodeDecodeError):
                return True, None

        def read_json(content: bytes) -> bool:
            try:
                json.loads(content.decode("utf-8-sig"))
            except (ValueError, RecursionError):
                return False
            return True

        for batch in cut(batches):
            suffixes = batch.column("suffix").to_pylist()
            is_zip, is_json, members, counts = [], [], [], []
            for suffix, content in zip(suffixes, batch.column("content")):
                content = content.as_py() or b""
                zipped, names = read_zip(content)
                is_zip.append(zipped)
                members.append(names if names is None else names[:limit])
                counts.append(names if names is None else len(names))
                is_json.append(read_json(content) if suffix in JSON_SUFFIXES else None)
            columns = [batch.column(name) for name in passed]
            columns += [pa.array(is_zip, pa.bool_()), pa.array(is_json, pa.bool_()), pa.array(members, pa.list_(pa.string())), pa.array(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=passed + ["is_zip", "is_json", "members", "member_count"])

    return inputs.mapInArrow(inspect, schema)


def archive_inventory(inspected: DataFrame) -> DataFrame:
    """(path, pos, member) rows of each archive; a file that is no archive has none."""
    return inspected.filter("is_zip").select("path", F.posexplode("members").alias("pos", "member"))


def judge_files(inspected: DataFrame) -> DataFrame:
    """Inspected files with ``ok`` and, where that is false, the ``reason``."""
    reason = (
        F.when(F.col("length") == 0, ABSENT)
        .when((F.col("suffix") == ".zip") & ~F.col("is_zip"), "not_a_zip")
        .when(F.col("suffix").isin(".json", ".geojson") & ~F.col("is_json"), "invalid_json")
    )
    return inspected.withColumns({"ok": reason.isNull(), "reason": reason})


def landed_file_check(inspected: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(path, ok, reason) per landed file, and per declared path that did not land.

    Spark's file readers pass over empty files (and over names that start with ``_`` or ``.``), so
    an empty file shows up here through its declaration. Missing and empty are one outcome.
    """
    checked = judge_files(inspected).select("path", "ok", "reason")
    if declared is None:
        return checked
    # One grouping by path instead of an anti join, so that the files are inspected only once.
    both = checked.withColumn("landed", F.lit(True)).unionByName(
        declared.select("path", F.lit(None).cast("boolean").alias("landed")), allowMissingColumns=True
    )
    merged = both.groupBy("path").agg(
        F.bool_or("landed").alias("landed"), F.bool_or("ok").alias("ok"), F.max("reason").alias("reason")
    )
    return merged.select(
        "path", F.coalesce("ok", F.lit(False)).alias("ok"), F.when(F.col("landed"), F.col("reason")).otherwise(ABSENT).alias("reason")
    )


def landing_accept(fetch_log: DataFrame, catalog: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The fetch log with ``reject_reason``: null if accepted, otherwise the first rule that failed. A source listed twice fails the query.

    A log may tell more than the response: ``error`` of the transfer, ``http_status``, and
    ``file_reason``, what ``judge_files`` found wrong with the file.
    """
    def told(name: str) -> Column:
        return F.col(name) if name in fetch_log.columns else F.lit(None)

    expected = unique_by(catalog.select("source_id", "expected_sha256"), "source_id", "catalog", nulls_repeat=False)
    content_type = F.lower(F.coalesce("content_type", F.lit("")))
    reason = (
        F.when(told("error").isNotNull(), TRANSPORT_ERROR)
        .when(~told("http_status").cast("int").between(200, 299), HTTP_ERROR)
        .when(content_type.contains("text/html"), "html_response")
        .when(~F.coalesce(promises_data(), F.lit(False)), "no_data_extension")
        .when(F.col("content_length") > max_bytes, "declared_size_over_limit")
        .when(F.col("bytes") > max_bytes, "size_over_limit")
        .when(F.col("bytes") == 0, ABSENT)
        .when(told("file_reason").isNotNull(), told("file_reason").cast("string"))
        .when((F.col("expected_sha256") != "") & ~F.col("sha256").eqNullSafe(F.col("expected_sha256")), "checksum_mismatch")
    )
    told_apart = split_url(fetch_log.join(expected, "source_id", "left"), "resolved_url")
    return told_apart.withColumn("reject_reason", reason).drop("expected_sha256", PARTS)


def settle_attempts(judged: DataFrame) -> DataFrame:
    """One row per source and URL: the first accepted attempt, or the last one if all were rejected.

    Rows are redistributed by source and URL first. Otherwise the window could settle for the
    partitioning by source of a preceding join, which would put a large source into one task.
    """
    won = F.col("reject_reason").isNull()
    order = Window.partitionBy("source_id", "url").orderBy(
        won.desc(), F.when(won, F.col("attempt")).otherwise(-F.col("attempt"))
    )
    spread = judged.repartition("source_id", "url")
    return spread.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") == 1).drop("__place")


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reject_reason").isNull()).drop("reject_reason")


# Columns of the error log, with their types.
ERROR_COLUMNS = {
    "source_id": "string",
    "stage": "string",
    "url": "string",
    "path": "string",
    "type": "string",
    "message": "string",
    "attempts": "int",
}


def error_rows(rejected: DataFrame, stage: str) -> DataFrame:
    """Rejected rows in the error log's columns; what a row does not have is null."""
    have = {name: F.col(name) if name in rejected.columns else F.lit(None) for name in ERROR_COLUMNS}
    have["stage"] = F.lit(stage)
    return rejected.select(*[c.cast(ERROR_COLUMNS[name]).alias(name) for name, c in have.items()])


def fetch_errors(judged: DataFrame) -> DataFrame:
    """Download errors of a judged fetch log."""
    refused = judged.filter(F.col("reject_reason").isNotNull())
    return error_rows(
        refused.withColumns({"type": F.lit("rejected"), "message": F.col("reject_reason"), "attempts": F.col("attempt")}),
        "download",
    )


def cache_errors(checked: DataFrame) -> DataFrame:
    """Cache-validation errors of checked files (with their source_id)."""
    return error_rows(
        checked.filter(~F.col("ok")).withColumns({"type": F.lit("invalid_file"), "message": F.col("reason")}),
        "cache_validation",
    )


def page_errors(page_log: DataFrame) -> DataFrame:
    """Errors of pages that did not arrive: ``page_log`` has (source_id, url, http_status, error)."""
    failed = page_log.filter(F.col("error").isNotNull() | ~F.col("http_status").between(200, 299))
    kind = F.when(F.col("error").isNotNull(), TRANSPORT_ERROR).otherwise(HTTP_ERROR)
    message = F.coalesce(F.col("error"), F.concat(F.lit("HTTP "), F.col("http_status").cast("string")))
    return error_rows(failed.withColumns({"type": kind, "message": message}), "page")


def unfetched_errors(links: DataFrame, fetched: DataFrame) -> DataFrame:
    """Ranked links of which no attempt is on record."""
    missing = links.join(fetched.select("source_id", "url"), ["source_id", "url"], "left_anti")
    return error_rows(missing.withColumns({"type": F.lit(NOT_FETCHED), "message": F.lit("no attempt on record")}), "download")


def unread_files(listing: DataFrame, judged: DataFrame) -> DataFrame:
    """Listed files that no reader delivered (empty ones, names with a leading ``_`` or ``.``), with their verdict."""
    missing = listing.join(judged.select("source_id", "path"), ["source_id", "path"], "left_anti")
    return missing.withColumns({"ok": F.lit(False), "reason": F.when(F.col("length") == 0, ABSENT).otherwise(NOT_READ)})


def error_log(*errors: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, errors)


def source_status(
    sources: DataFrame, discovered: DataFrame, downloaded: DataFrame, preserved: DataFrame, errors: DataFrame
) -> DataFrame:
    """Per source: counts of what was found, fetched, kept and failed, and the resulting status.

    Each input is reduced to (source_id, kind) and counted in one aggregation with partial sums.
    ``sources`` lists every source, so that one without any rows shows as failed.
    """
    kinds = {"discovered": discovered, "downloaded": downloaded, "preserved": preserved, "errors": errors}
    rows = sources.select("source_id", F.lit(None).cast("string").alias("kind"))
    for kind, df in kinds.items():
        rows = rows.unionByName(df.select("source_id", F.lit(kind).alias("kind")))
    counted = rows.groupBy("source_id").agg(*[F.count_if(F.col("kind") == kind).alias(kind) for kind in kinds])
    available = F.col("downloaded") + F.col("preserved")
    return counted.withColumns(
        {"available": available, "status": F.when(available > 0, "success").otherwise("failed")}
    )


def overall_status(per_source: DataFrame) -> DataFrame:
    """One row: ``complete`` if every source has something, which holds for no sources at all too."""
    return per_source.agg(
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.col("available") > 0).alias("successful"),
        F.when(F.coalesce(F.bool_and(F.col("available") > 0), F.lit(True)), "complete").otherwise("partial").alias("status"),
    )


def probe_status(probe_log: DataFrame) -> DataFrame:
    """Probe rows with ``status``: available (2xx), http_error, or unreachable without a response."""
    code = F.col("http_status")
    status = F.when(code.isNull(), "unreachable").when(code.between(200, 299), "available").otherwise("http_error")
    return probe_log.withColumn("status", status)


def probe_catalog(catalog: DataFrame, probe_log: DataFrame) -> DataFrame:
    """Catalog rows with the fields and the ``status`` of their probes; ``not_probed`` where there are none."""
    probed = probe_status(probe_log).withColumn("__probed", F.lit(True))
    joined = catalog.join(probed, "source_id", "left")
    return joined.withColumn("status", F.when(F.col("__probed"), F.col("status")).otherwise("not_probed")).drop("__probed")


def probe_outcomes(probed: DataFrame) -> DataFrame:
    """Per source, how often each (status, code, error) came up."""
    return probed.groupBy("source_id", "status", "http_status", "error").agg(F.count(F.lit(1)).alias("probes"))


def availability(probe_log: DataFrame) -> DataFrame:
    """One row: probed sources, available and not. The per-source detail is ``probe_status``."""
    up = F.col("status") == "available"
    return probe_status(probe_log).agg(
        F.count(F.lit(1)).alias("source_count"),
        F.count_if(up).alias("available"),
        F.count_if(~up).alias("unavailable"),
    )
