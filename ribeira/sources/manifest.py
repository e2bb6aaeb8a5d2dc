"""Nested catalog and manifest JSON as flat tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.fixed import SOURCE_CATALOG

CATALOG_SCHEMA = (
    "source_id STRING, agency STRING, theme STRING, official_page STRING, metadata_page STRING, "
    "expected_formats ARRAY<STRING>, map_reference_year INT, download_enabled BOOLEAN, "
    "direct_urls ARRAY<STRING>, direct_urls_only BOOLEAN, expected_sha256 STRING, purpose STRING"
)
PROBED_SCHEMA = CATALOG_SCHEMA + (
    ", status STRING, http_status INT, resolved_url STRING, content_type STRING, error_type STRING, "
    "error STRING, checked_at_utc STRING"
)
FILE_FIELDS = "path: STRING, bytes: BIGINT, sha256: STRING, zip_inventory: ARRAY<STRING>"
SOURCE_RECORD = (
    "STRUCT<agency: STRING, official_page: STRING, discovery_policy: STRING, discovered: ARRAY<STRING>, "
    f"downloads: ARRAY<STRUCT<url: STRING, resolved_url: STRING, {FILE_FIELDS}, content_type: STRING, attempt: INT>>, "
    f"preserved: ARRAY<STRUCT<{FILE_FIELDS}>>, "
    "errors: ARRAY<STRUCT<stage: STRING, url: STRING, path: STRING, type: STRING, message: STRING, attempts: INT>>>"
)

# What ``flatten_manifest`` reads of a record; the parser passes over everything else.
FLAT_RECORD = (
    "STRUCT<agency: STRING, discovery_policy: STRING, "
    "downloads: ARRAY<STRUCT<url: STRING, path: STRING, bytes: BIGINT, sha256: STRING, zip_inventory: ARRAY<STRING>>>>"
)


def catalog_table(spark: SparkSession, sources: Sequence[Mapping[str, object]] = tuple(SOURCE_CATALOG)) -> DataFrame:
    """A source catalog given as records (configuration) as a table; absent fields are null."""
    return spark.createDataFrame([dict(source) for source in sources], CATALOG_SCHEMA)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its whole text as ``value``."""
    return spark.read.text(path, wholetext=True)


def catalog_sources(documents: DataFrame) -> DataFrame:
    """One row per source of catalog documents (``{"sources": [...]}``)."""
    parsed = F.from_json("value", f"sources ARRAY<STRUCT<{_typed(PROBED_SCHEMA)}>>", {"mode": "FAILFAST"})
    return documents.select(F.inline(parsed["sources"]))


def _typed(columns: str) -> str:
    return ", ".join(": ".join(part.split(" ", 1)) for part in columns.split(", "))


def manifest_sources(documents: DataFrame, record: str = SOURCE_RECORD) -> DataFrame:
    """One row per source of manifest documents (``{"sources": {id: record}}``), still nested, with the fields of ``record`` only.

    The parser of a task keeps the ids that it has met, some thousands at most, and a new one costs far more than one it has. So very many small
    documents should come sorted by source; the result is the same in any order.
    """
    parsed = F.from_json("value", f"sources MAP<STRING, {record}>", {"mode": "FAILFAST"})
    return documents.select(F.explode(parsed["sources"]).alias("source_id", "record")).select("source_id", "record.*")


def manifest_files(sources: DataFrame, kind: str = "downloads") -> DataFrame:
    """One row per file entry of a manifest (``downloads`` or ``preserved``)."""
    return sources.select("source_id", F.inline(kind))


def manifest_errors(sources: DataFrame) -> DataFrame:
    return sources.select("source_id", F.inline("errors"))


def manifest_links(sources: DataFrame) -> DataFrame:
    return sources.select("source_id", F.explode("discovered").alias("url"))


def flatten_manifest(sources: DataFrame) -> DataFrame:
    """One row per source and download, sources without any included: file fields and member count."""
    rows = sources.select("source_id", "agency", "discovery_policy", F.explode_outer("downloads").alias("download"))
    return rows.select(
        "source_id", "agency", "discovery_policy", "download.url", "download.path", "download.bytes",
        "download.sha256", F.coalesce(F.size("download.zip_inventory"), F.lit(0)).alias("members"),
    )
