"""Writers for origins, summaries and one-record logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ribeira import fixed
from ribeira.operators.joins import RIGHT_KEY


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Parquet partitioned by a column.

    The rebalance hint brings the rows of a partition value together, so that it becomes few files,
    while adaptive execution splits a value that holds a large share of the rows over several tasks.
    """
    df.hint("rebalance", by).write.partitionBy(by).parquet(path)


def write_origins(origins: DataFrame, path: str, by: str = fixed.MUNICIPALITY_KEY) -> None:
    """All origin columns but the join helpers."""
    write_partitioned(origins.drop("_merge", RIGHT_KEY), path, by)


def write_summary(origins: DataFrame, path: str, columns: Sequence[str] = tuple(fixed.SUMMARY_COLUMNS)) -> None:
    """The summary columns as CSV with a header."""
    origins.select(*columns).write.csv(path, header=True, encoding="UTF-8", escape='"')


def write_record(record: DataFrame, path: str) -> None:
    """A one-row table appended to a JSON log, its columns sorted by name."""
    record.select(*sorted(record.columns)).write.mode("append").json(path)
