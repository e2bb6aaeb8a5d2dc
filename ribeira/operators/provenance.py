"""Collection records: where data came from, when, and how much of it."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ribeira.sources.sinks import write_record

RECORD_SCHEMA = (
    "source STRING, endpoint STRING, collected_at_utc TIMESTAMP, parameters MAP<STRING, STRING>, "
    "record_count BIGINT, column_labels MAP<STRING, STRING>"
)


def collection_record(
    spark: SparkSession,
    source: str,
    endpoint: str,
    parameters: Mapping[str, object],
    record_count: int,
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """The one-row record of a collection. Values that are not text are kept as JSON."""
    texts = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True) for k, v in parameters.items()}
    row = (source, endpoint, datetime.now(timezone.utc), texts, record_count, dict(labels or {}))
    return spark.createDataFrame([row], RECORD_SCHEMA)


def write_with_provenance(
    df: DataFrame,
    path: str,
    log_path: str,
    source: str,
    endpoint: str,
    parameters: Mapping[str, object],
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """Write a table as Parquet and append its collection record to a JSON log; returns the record.

    The rows are counted while they are written, so there is no second pass.
    """
    counts = Observation()
    df.observe(counts, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    record = collection_record(df.sparkSession, source, endpoint, parameters, counts.get["rows"], labels)
    write_record(record, log_path)
    return record
