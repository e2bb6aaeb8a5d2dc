"""Checks on keys, identities and attributes, and the expectation set that raises on them.

Every check is one aggregation with map-side partial sums, so a key that holds a large share of the
rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ribeira.operators.filters import all_present


class ExpectationError(ValueError):
    """Raised with the names and counts of the rules that do not hold."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts (null is a key like any other)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def unique_by(df: DataFrame, key: str, what: str, *, nulls_repeat: bool = True) -> DataFrame:
    """The same rows; the query that reads them fails if a key occurs a second time.

    The check is part of the plan: rows are numbered within their key, and a filter, which the optimizer can't leave out, raises at a
    number of 2. A join on the key that follows finds its rows partitioned and sorted, so that check and join
    share one exchange. Nothing is gathered, and a key with many rows fails at its second. The null key is a key like any other unless
    ``nulls_repeat`` is false. The partition number in the check, which isn't deterministic, keeps filters of the query above it: the check
    is of all rows of ``df``, those that a join would pass over included.
    """
    turn = F.row_number().over(Window.partitionBy(key).orderBy(key))
    value = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    repeated = F.raise_error(F.concat(F.lit(f"{what} key {key} is not unique: "), value)).cast("boolean")
    once = (F.col("__turn") == 1) | (F.spark_partition_id() < 0)
    return (
        df.withColumn("__turn", turn)
        .filter(F.when(once if nulls_repeat else once | F.col(key).isNull(), True).otherwise(repeated))
        .drop("__turn")
    )


def breaks_identity(total: Column, parts: Sequence[Column]) -> Column:
    """True where all values are present and the total is not the sum of its parts."""
    return all_present(total, *parts) & (total != reduce(lambda a, b: a + b, parts))


def identity_violations(df: DataFrame, total: str, parts: Sequence[str]) -> DataFrame:
    """One row: how many rows were checked and how many break ``total = sum(parts)``."""
    columns = [F.col(part) for part in parts]
    return df.agg(
        F.count_if(all_present(F.col(total), *columns)).alias("rows_checked"),
        F.count_if(breaks_identity(F.col(total), columns)).alias("violations"),
    )


def completeness_audit(df: DataFrame, key: str, total: str, part: str) -> DataFrame:
    """One row: rows, distinct keys, missing values, and the sum of what is present."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(F.col(key)).alias("unique_keys"),
        F.count_if(F.col(total).isNull()).alias("missing_total"),
        F.count_if(F.col(part).isNull()).alias("missing_part"),
        F.coalesce(F.sum(part), F.lit(0)).cast("bigint").alias("part_observed"),
    )


def keyed_profile(df: DataFrame, key: str, total: str, parts: Sequence[str], part: str) -> DataFrame:
    """Key, identity and completeness figures of a table in one pass and one small shuffle.

    Partial sums per key are shuffled once; everything else follows from them.
    """
    columns = [F.col(name) for name in parts]
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(breaks_identity(F.col(total), columns)).alias("broken"),
        F.count_if(F.col(total).isNull()).alias("no_total"),
        F.count_if(F.col(part).isNull()).alias("no_part"),
        F.sum(part).alias("part_sum"),
    )

    def total_of(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")

    return per_key.agg(
        total_of("n").alias("rows"),
        F.count(key).alias("unique_keys"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
        total_of("broken").alias("identity_violations"),
        total_of("no_total").alias("missing_total"),
        total_of("no_part").alias("missing_part"),
        total_of("part_sum").alias("part_observed"),
    )


FIXED_WIDTH = (T.BooleanType, T.IntegralType, T.FractionalType, T.DateType, T.TimestampType, T.TimestampNTZType)
"""Types whose least and greatest value a hash aggregation keeps in place."""


def nan_to_null(c: Column, kind: T.DataType) -> Column:
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c


def canonical(c: Column, kind: T.DataType) -> Column:
    """A value of a type that can be hashed and compared, the same for the same value.

    The entries of a map are sorted, NaN counts as null at any depth and -0.0 as 0.0. Every nested value goes with a flag for null and
    every list with its size, as a hash passes over nulls and over the borders of lists.
    """

    def nested(value: Column, of: T.DataType) -> Column:
        plain = canonical(value, of)
        return F.struct(plain.isNull().alias("none"), plain.alias("value"))

    if isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda item: nested(item, kind.elementType))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(
            F.map_entries(c), lambda e: F.struct(nested(e["key"], kind.keyType).alias("key"), nested(e["value"], kind.valueType).alias("value"))
        )
        items = F.array_sort(pairs)
    elif isinstance(kind, T.StructType):
        fields = [nested(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else F.when(c.isNotNull(), F.lit(0))
    elif isinstance(kind, T.VariantType):
        return F.to_json(c)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        return nan_to_null(c, kind) + F.lit(0.0).cast(kind)
    else:
        return c
    return F.when(c.isNotNull(), F.struct(F.size(c).alias("size"), items.alias("items")))


def profile_figures(key: str, total: str, parts: Sequence[str], part: str) -> list[Column]:
    """The figures of ``keyed_profile`` for a table of unique keys, as aggregates that can be observed while it is written."""
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count(key).alias("unique_keys"),
        F.count_if(breaks_identity(F.col(total), [F.col(name) for name in parts])).alias("identity_violations"),
        F.count_if(F.col(total).isNull()).alias("missing_total"),
        F.count_if(F.col(part).isNull()).alias("missing_part"),
        F.coalesce(F.sum(part), F.lit(0)).cast("bigint").alias("part_observed"),
    ]


def raise_on_counts(counts: Mapping[str, int]) -> None:
    """Raise unless every rule's number of violations is zero."""
    broken = [f"{rule}: {n}" for rule, n in sorted(counts.items()) if n]
    if broken:
        raise ExpectationError("; ".join(broken))


def fingerprints(c: Column, kind: T.DataType) -> list[Column]:
    """What tells a value from others of its type: the value itself if it has a fixed width, else two 64-bit hashes of it. Null stays null."""
    value = canonical(c, kind)
    if isinstance(kind, FIXED_WIDTH):
        return [value]
    return [F.when(value.isNotNull(), F.xxhash64(F.lit(seed), value)) for seed in (1, 2)]


def differs(marks: Sequence[Column]) -> Column:
    """Aggregate over a value's fingerprints: whether a group holds more than one value, null counting as a value. NaN is read as null.

    The least and the greatest fingerprint plus a count say the same as a distinct count, in one hash aggregation over buffers
    of fixed size, without the row expansion that several distinct counts need. It works for types without an order.
    """
    apart = reduce(lambda a, b: a | b, [F.min(m) != F.max(m) for m in marks])
    some = F.count(marks[0])
    return F.coalesce(apart | ((some > 0) & (some < F.count(F.lit(1)))), F.lit(False))


def any_value(c: Column, kind: T.DataType) -> Column:
    """Aggregate: the least value, or, for types without an order, the value of least fingerprint. Nulls are passed over."""
    if isinstance(kind, (T.MapType, T.ArrayType, T.StructType, T.VariantType)):
        first, second = fingerprints(c, kind)
        return F.min_by(c, F.when(first.isNotNull(), F.struct(first.alias("a"), second.alias("b"))))
    return F.min(nan_to_null(c, kind))


def attribute_conflicts(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per attribute: number of keys (the null key included) that hold more than one value."""
    marks = [fingerprints(F.col(name), df.schema[name].dataType) for name in columns]
    # as columns of their own first, so that each is worked out once per row
    named = [[F.col(f"mark_{i}_{j}") for j in range(len(pair))] for i, pair in enumerate(marks)]
    rows = df.select(key, *[m.alias(f"mark_{i}_{j}") for i, pair in enumerate(marks) for j, m in enumerate(pair)])
    flags = rows.groupBy(key).agg(*[differs(pair).alias(f"differs_{i}") for i, pair in enumerate(named)])
    counts = flags.agg(*[F.count_if(F.col(f"differs_{i}")).alias(f"keys_{i}") for i in range(len(columns))])
    return to_long(counts, {name: f"keys_{i}" for i, name in enumerate(columns)}, "attribute", "conflicting_keys")


def to_long(row: DataFrame, columns: Mapping[str, str], name: str, value: str) -> DataFrame:
    """A one-row table as (name, value) rows."""
    pairs = [
        F.struct(F.lit(label).alias(name), F.col(column).cast("bigint").alias(value))
        for label, column in columns.items()
    ]
    return row.select(F.inline(F.array(*pairs)))


def row_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations) for rules on single rows of one table: one shared aggregation."""
    counts = df.agg(*[F.count_if(violated).alias(f"rule_{i}") for i, violated in enumerate(rules.values())])
    return to_long(counts, {name: f"rule_{i}" for i, name in enumerate(rules)}, "rule", "violations")


def not_empty_rule(df: DataFrame, rule: str) -> DataFrame:
    """(rule, violations): one violation if the table has no rows."""
    return df.agg(F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint").alias("violations")).select(
        F.lit(rule).alias("rule"), "violations"
    )


def unique_rule(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """(rule, violations): number of keys that repeat."""
    return duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(rule).alias("rule"), "violations"
    )


def not_zero(c: Column) -> Column:
    """True where a value is not exactly zero; null is not zero."""
    return ~c.eqNullSafe(F.lit(0))


def expectations(*frames: DataFrame) -> DataFrame:
    """All rules and their violation counts as one (rule, violations) table."""
    return reduce(DataFrame.unionByName, frames)


def raise_on(checks: DataFrame) -> None:
    """Raise unless every rule has zero violations (runs a job; one row per rule reaches the driver)."""
    broken = checks.filter(F.col("violations") > 0).orderBy("rule").collect()
    if broken:
        raise ExpectationError("; ".join(f"{row['rule']}: {row['violations']}" for row in broken))
