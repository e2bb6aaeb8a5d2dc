"""Row filters and tolerant projections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix_filter(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text starts with ``prefix``; null does not. Reaches the scan as StringStartsWith."""
    return df.filter(F.col(column).startswith(prefix))


def drop_if_present(df: DataFrame, *columns: str) -> DataFrame:
    """Without the named columns; a name that is absent is no error."""
    return df.drop(*columns)


def coerce_columns(df: DataFrame, columns: Iterable[str], coerce) -> DataFrame:
    """``coerce`` (Column -> Column) applied to several columns in one projection."""
    return df.withColumns({name: coerce(F.col(name)) for name in columns})


def eligible_sources(catalog: DataFrame, skip: str) -> DataFrame:
    """Catalog rows to work on: not the skipped source, and not switched off (unset means on)."""
    return catalog.filter((F.col("source_id") != skip) & F.coalesce(F.col("download_enabled"), F.lit(True)))


def all_present(*columns: Column) -> Column:
    present = columns[0].isNotNull()
    for column in columns[1:]:
        present = present & column.isNotNull()
    return present
