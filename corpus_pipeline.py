"""A training corpus from ``documents``: rejects low quality, exact copies, near copies and benchmark leaks, then encodes what stays.

Each stage takes the documents that the one before has kept, written to Parquet in between; all but the last give them back with all
their columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ribeira.llm import bpe, decontaminate, exact_dedup, quality, simhash
from ribeira.llm.common import read
from ribeira.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ordinal regression on the ratings; documents that likely have the lowest grade go."""
    return quality.keep_good(docs, quality.ratings_of(read(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by their SimHash fingerprints (3 bits or fewer, as in ``op9_simhash``), or by the similarity of their
    sets of five-word shingles (0.8 or more), the one of smallest id stays."""
    return simhash.drop_similar(docs, distance=3)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, be it with other names and numbers, go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them."""
    return bpe.token_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", reject_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("encode", encode),
]

ORACLE_SQL = None
"""SQL can train no classifier and has no XXH64."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
