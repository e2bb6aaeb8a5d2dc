"""Statistical-API payload files to a table with a collection record."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ribeira.operators.provenance import write_with_provenance
from ribeira.sources.manifest import read_documents
from ribeira.sources.payload import payload_normalize


def run_statistics_table(
    spark: SparkSession,
    path: str,
    out: str,
    source: str,
    endpoint: str,
    parameters: Mapping[str, object],
) -> DataFrame:
    """Read landed payload files, write ``out/table`` and append to ``out/log``; returns the record."""
    table, labels = payload_normalize(read_documents(spark, path))
    return write_with_provenance(table, f"{out}/table", f"{out}/log", source, endpoint, parameters, labels)
