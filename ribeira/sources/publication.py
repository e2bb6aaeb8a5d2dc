"""Publication of a run's tables as a unit.

All tables of a run are staged in a folder of their own below ``<out>/runs``; a manifest of one row, written last below ``<out>/commits``, makes them
visible together. Readers take tables only from manifests. So a run that fails at any point leaves nothing that could be read, a
run that is started again under its id after it has been committed does nothing, and one that failed before starts over in a new
folder. Nothing is overwritten or removed; folders that no manifest names can be cleared by age.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ribeira.operators.quality import canonical

MANIFEST = "run_id STRING, committed_at TIMESTAMP, tables ARRAY<STRUCT<name: STRING, path: STRING, rows: BIGINT, digest: DECIMAL(38,0)>>, figures MAP<STRING, STRING>"


def row_metrics(df: DataFrame) -> list:
    """Aggregates: the number of rows, and the sum of their hashes, which doesn't depend on their order."""
    values = [canonical(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]
    marked = [part for v in values for part in (v.isNull(), v)]
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*marked).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest")]


class Run:
    """One run that publishes tables below ``out``."""

    def __init__(self, spark: SparkSession, out: str, run_id: str):
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run_id):
            raise ValueError(f"a run id has letters, digits and ._- only: {run_id!r}")
        self.spark, self.out, self.run_id = spark, out.rstrip("/"), run_id
        self.folder = f"{self.out}/runs/{run_id}-{uuid.uuid4().hex}"
        self.tables: list[tuple] = []

    def manifest(self) -> DataFrame | None:
        """The run's manifest, if it has been committed."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.out}/commits/{self.run_id}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def stage(self, name: str, df: DataFrame, write: Callable[[DataFrame, str], None]) -> str:
        """Writes a table by ``write(df, path)`` and notes its path; rows and digest are gathered by that same write."""
        seen, path = Observation(), f"{self.folder}/{name}"
        write(df.observe(seen, *row_metrics(df)), path)
        found = seen.get
        self.tables.append((name, path, found["rows"], found["digest"]))
        return path

    def commit(self, figures: Mapping[str, object] | None = None) -> None:
        """Makes the staged tables visible, with figures of the run as texts. A run committed meanwhile raises."""
        texts = {k: str(v) for k, v in (figures or {}).items() if v is not None}
        row = (self.run_id, datetime.now(timezone.utc), self.tables, texts)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{self.out}/commits/{self.run_id}")


def committed_runs(spark: SparkSession, out: str) -> DataFrame:
    """The manifests of all committed runs, none if there is no folder yet."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{out.rstrip('/')}/commits/*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MANIFEST)


def published_path(spark: SparkSession, out: str, name: str, run_id: str | None = None) -> str:
    """Where a table of a committed run lies, by default of the latest one; raises ``LookupError`` if there is none."""
    runs = committed_runs(spark, out)
    if run_id is not None:
        runs = runs.filter(F.col("run_id") == run_id)
    found = runs.orderBy(F.desc("committed_at"), F.desc("run_id")).select(F.get(F.filter("tables", lambda t: t["name"] == name), F.lit(0))["path"].alias("path")).first()
    if found is None or found["path"] is None:
        raise LookupError(f"no committed run has a table {name}")
    return found["path"]
