"""What the operators share: reading tables, and Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
"""Roughly how many bytes of payload a batch holds that leaves a Python worker."""


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and the text as UTF-8 bytes, null as empty. All other columns are left behind."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of Python values, a few hundred rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(column.to_pylist() for column in part.columns))


def text_groups(batches: Iterable[pa.RecordBatch], size: int = 2 << 20, rows=rows_of) -> Iterator[list[tuple]]:
    """Rows ``(id, bytes, …)`` in lists that hold about ``size`` bytes of text."""
    group, total = [], 0
    for row in rows(batches):
        group.append(row)
        total += len(row[1])
        if total >= size:
            yield group
            group, total = [], 0
    if group:
        yield group


class Emitter:
    """Gathers rows into Arrow batches; ``add`` gives a batch when enough bytes have come together."""

    def __init__(self, schema: pa.Schema, size: int = BATCH_BYTES):
        self.schema, self.size = schema, size
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple, weight: int = 64) -> list[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += weight
        return self.flush() if self.bytes >= self.size else []

    def flush(self) -> list[pa.RecordBatch]:
        if not self.rows:
            return []
        columns = [pa.array(c, field.type) for c, field in zip(zip(*self.rows), self.schema)]
        self.rows, self.bytes = [], 0
        return [pa.RecordBatch.from_arrays(columns, schema=self.schema)]
