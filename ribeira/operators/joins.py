"""Joins with checked keys.

A repeated key makes the query fail when it runs; no job runs while it is built. No side carries a broadcast hint: the optimizer broadcasts a side only if its size is under the
session's threshold, and otherwise shuffles, where adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribeira.operators.quality import ExpectationError, duplicate_keys, unique_by

BOTH, LEFT_ONLY = "both", "left_only"
RIGHT_KEY = "demography_key"


def require_unique(df: DataFrame, key: str, side: str) -> None:
    """Raise if a key repeats (runs a job over the key column)."""
    if not duplicate_keys(df, [key]).isEmpty():
        raise ExpectationError(f"{side} key {key} is not unique")


def validated_left_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    *,
    left_is_unique: bool = False,
    right_is_unique: bool = False,
    null_keys_match: bool = False,
) -> DataFrame:
    """One-to-one left join with an indicator column ``_merge`` (``both`` or ``left_only``).

    Both keys are checked inside the join's plan, on the rows as the join has shuffled and sorted them (``unique_by``); a flag says
    that a side is already known to be unique, for example because it was grouped by the key. The right key
    comes out as ``demography_key``: the two names may differ in case only, which Spark could not
    tell apart.

    Null keys match nothing unless ``null_keys_match`` asks for it. Plain equality is the default
    because it lets the join use the partitioning that a grouping by the key has left behind.
    """
    if not left_is_unique:
        left = unique_by(left, left_key, "left")
    if not right_is_unique:
        right = unique_by(right, right_key, "right")
    hits = right.withColumnRenamed(right_key, RIGHT_KEY).withColumn("_hit", F.lit(True))
    same = left[left_key].eqNullSafe(hits[RIGHT_KEY]) if null_keys_match else left[left_key] == hits[RIGHT_KEY]
    joined = left.join(hits, same, "left")
    return joined.withColumn("_merge", F.when(F.col("_hit"), BOTH).otherwise(LEFT_ONLY)).drop("_hit")


def right_only(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: number of right rows that the left join leaves out."""
    keys = left.select(F.col(left_key).alias("__left_key"))
    missing = right.join(keys, right[right_key] == keys["__left_key"], "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("demography_only"))


def checksum_join(declared: DataFrame, observed: DataFrame, on: str) -> DataFrame:
    """Declared (key, sha256) rows with each observed file and ``match``/``mismatch``/``missing``.

    With a source as the key, its one declared hash applies to each of its files; a key declared twice fails the query. Files are the left
    side of an inner join, where adaptive execution can split a source that holds a large share of
    them; declarations without a file come from an anti join with the distinct observed keys.
    """
    expected = unique_by(declared, on, "declared", nulls_repeat=False).withColumnRenamed("sha256", "expected_sha256")
    found = observed.withColumnRenamed("sha256", "observed_sha256").join(expected, on)
    same = F.col("expected_sha256").eqNullSafe(F.col("observed_sha256"))
    judged = found.withColumn("outcome", F.when(same, "match").otherwise("mismatch"))
    absent = expected.join(observed.select(on).distinct(), on, "left_anti").withColumn("outcome", F.lit("missing"))
    return judged.unionByName(absent, allowMissingColumns=True)
