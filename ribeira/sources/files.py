"""Whole files as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART_BYTES = 1 << 20
"""Roughly how many bytes of content a Python worker takes up at once."""


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of every file below ``path``; up to 2 GB each."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    )


def content_digest(c: Column) -> Column:
    return F.sha2(c, 256)


def file_digests(spark: SparkSession, path: str, glob: str = "*", *told: Column) -> DataFrame:
    """(path, bytes, sha256) per file, and what else is ``told`` of its ``content``; hashed in the JVM, file by file in parallel."""
    return scan_files(spark, path, glob).select(
        "path", F.col("length").alias("bytes"), content_digest(F.col("content")).alias("sha256"), *told
    )


def content_parts(size: int = PART_BYTES) -> Callable[[Iterable], Iterator]:
    """A function, which goes to the workers as it stands, that cuts Arrow batches into slices with about ``size`` bytes in their
    ``content``, at least a row each: what a pass makes of contents then never adds up to a whole batch."""

    def cut(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow.compute as pc

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("content")), 0)
            ends = np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64)
            low = 0
            while low < batch.num_rows:
                before = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + size, "right")))
                yield batch.slice(low, high - low)
                low = high

    return cut
