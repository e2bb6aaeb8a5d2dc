"""Multipart features: one row per key, with the parts kept as rows of their own.

A key can hold any number of parts, so parts are never gathered into one value. A dissolved layer
is two tables: one row per key with its attributes, and one row per distinct part. Shared borders
between parts are not merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribeira.operators.quality import any_value, differs, fingerprints


def group_features(features: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """One row per key, the null key included: attributes, feature count and conflict list.

    The attribute kept is the least non-null value (of nested values that of least fingerprint), which for a key without conflicts is
    the only one. ``conflicts`` names the attributes on which the features of the key disagree. Minima of texts
    make this a sort aggregation; it is one shuffle, and a join on the key finds its rows in order.
    """
    columns = {name: (F.col(name), features.schema[name].dataType) for name in attributes}
    grouped = features.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_features"),
        *[any_value(*c).alias(name) for name, c in columns.items()],
        *[differs(fingerprints(*c)).alias(f"__differs_{i}") for i, c in enumerate(columns.values())],
    )
    named = F.array(*[F.when(F.col(f"__differs_{i}"), F.lit(name)) for i, name in enumerate(attributes)])
    return grouped.select(key, "n_features", *attributes, F.array_compact(named).alias("conflicts"))


def dissolve_sectors(features: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """One row per non-null key: attributes and number of features."""
    return group_features(features, key, attributes).filter(F.col(key).isNotNull()).drop("conflicts")


def dissolve_parts(features: DataFrame, key: str, geometry: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row per distinct part of each non-null key.

    Copies of a part are folded map-side, and the shuffle is on key and part together, so neither a
    key with very many parts nor a part with very many copies ends up in one task. ``carry`` takes
    along attributes that are constant per key, such as the one the sink partitions by.
    """
    keep = features.filter(F.col(key).isNotNull() & F.col(geometry).isNotNull())
    return keep.select(key, *carry, geometry).distinct()


def multipart_stats(features: DataFrame, key: str) -> DataFrame:
    """One row: features, distinct keys, surplus features, multipart keys and most parts of a key."""
    per_key = features.groupBy(key).agg(F.count(F.lit(1)).alias("n_features"))
    return multipart_stats_of(per_key, key)


def multipart_stats_of(per_key: DataFrame, key: str) -> DataFrame:
    """The same from a table that already has one row per key with its feature count."""
    n, known = F.col("n_features"), F.col(key).isNotNull()
    features, keys = F.coalesce(F.sum(n), F.lit(0)).cast("bigint"), F.count(key)
    return per_key.agg(
        features.alias("features"),
        keys.alias("unique_keys"),
        (features - keys).alias("surplus_features"),
        F.count_if(known & (n > 1)).alias("multipart_keys"),
        F.coalesce(F.max(F.when(known, n)), F.lit(0)).cast("bigint").alias("max_parts"),
    )
