"""Delimited text."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ribeira import fixed
from ribeira.functions.text import coerce_numeric
from ribeira.operators.filters import coerce_columns, prefix_filter

HEADERS_AT_ONCE = 16
"""Files whose first line is looked at side by side."""


STYLE = {"encoding": "UTF-8", "quote": '"', "escape": '"'}
"""A quote within quotes is written twice."""


class HeaderError(ValueError):
    """A file lacks a column that was asked for, or has it more than once."""


def literal_path(path: str) -> str:
    """A path in which no character stands for others."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def files_below(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """The files that Spark's readers find, without the empty ones. Contents are not read."""
    listed = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return sorted(row["path"] for row in listed.where("length > 0").select("path").collect())


def header_of(spark: SparkSession, file: str, sep: str) -> tuple[str, ...]:
    """The fields of a file's first line, as they stand there; a byte order mark isn't part of them."""
    first = spark.read.csv(literal_path(file), sep=sep, header=False, inferSchema=False, **STYLE).first()
    return tuple((name or "").removeprefix("﻿") for name in first or ())


def scan_delimited(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], sep: str = ";") -> DataFrame:
    """The named columns of UTF-8 files with a header, all as text, whatever the order of columns in each file.

    Spark binds a file's columns by position to one schema, that of the first file's header or the one passed in: a file with
    another order would be misread without an error. Files are therefore grouped by their header, and each distinct header is one
    scan, which parses just the named columns and takes filters along. A name that a file lacks or repeats raises ``HeaderError``.

    Headers are read when the scan is defined, by one short job per file, several side by side. Where a name is
    unique whatever its case, Spark compares it to the file's header once more as it reads. Empty files have no rows.
    """
    files = files_below(spark, path)
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        for file, header in zip(files, pool.map(lambda f: header_of(spark, f, sep), files)):
            groups[header].append(file)
    if not groups:
        raise HeaderError(f"no file with a header in {path}")
    for header, members in groups.items():
        wrong = [name for name in columns if header.count(name) != 1]
        if wrong:
            raise HeaderError(f"{members[0]}: not exactly one column {', '.join(wrong)}")
    return reduce(DataFrame.unionByName, (_scan(spark, members, header, columns, sep) for header, members in groups.items()))


def _scan(spark: SparkSession, files: list[str], header: tuple[str, ...], columns: Sequence[str], sep: str) -> DataFrame:
    lower = [name.lower() for name in header]
    plain = {at for at, name in enumerate(lower) if name and lower.count(name) == 1}
    names = [name if at in plain else f"__column_{at}" for at, name in enumerate(header)]
    schema = StructType([StructField(name, StringType()) for name in names])
    wanted = [header.index(name) for name in columns]
    rows = spark.read.schema(schema).csv(
        [literal_path(f) for f in files], sep=sep, header=True, enforceSchema=not plain.issuperset(wanted), **STYLE
    )
    return rows.select(*[F.col(f"`{names[at]}`").alias(name) for at, name in zip(wanted, columns)])


def read_demography(
    spark: SparkSession,
    path: str | Sequence[str],
    state_code: str = fixed.STATE_CODE,
    key: str = fixed.DEMOGRAPHY_KEY,
    measures: Sequence[str] = tuple(fixed.MEASURES),
) -> DataFrame:
    """Census demography of one state: key as text, measures as DOUBLE with bad text as null."""
    rows = scan_delimited(spark, path, [key, *measures])
    return coerce_columns(prefix_filter(rows, key, state_code), measures, coerce_numeric)
