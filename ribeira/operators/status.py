"""Population-data status, restricted zero fill and the origins audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribeira.fixed import STATUS_LEFT_ONLY, STATUS_OBSERVED, STATUS_UNAVAILABLE
from ribeira.operators.joins import LEFT_ONLY


def status_label(merge: Column, measure: Column) -> Column:
    """Why a population figure is what it is; only the female measure decides."""
    return (
        F.when(merge == LEFT_ONLY, STATUS_LEFT_ONLY)
        .when(measure.isNull(), STATUS_UNAVAILABLE)
        .otherwise(STATUS_OBSERVED)
    )


def zero_fill(df: DataFrame, merge: Column, columns: Sequence[str]) -> DataFrame:
    """Zero in the named columns of left-only rows. Every other null stays null."""
    return df.withColumns({name: F.when(merge == LEFT_ONLY, F.lit(0)).otherwise(F.col(name)) for name in columns})


def label_origins(joined: DataFrame, total: str, male: str, female: str) -> DataFrame:
    """Status, zero fill and the two population aliases, in the order they depend on each other."""
    merge = F.col("_merge")
    filled = zero_fill(
        joined.withColumn("population_data_status", status_label(merge, F.col(female))), merge, [total, male, female]
    )
    return filled.withColumns({"female_population": F.col(female), "total_population": F.col(total)})


def feature_figures(key: str) -> list[Column]:
    """Aggregates over grouped sectors: source features, keys and surplus features."""
    features = F.coalesce(F.sum("n_features"), F.lit(0)).cast("bigint")
    return [
        features.alias("source_features"),
        F.count(key).alias("unique_geometry_sectors"),
        (features - F.count(key)).alias("multipart_extra_features"),
    ]


def origin_figures(crs: str | None = None) -> list[Column]:
    """Aggregates over labelled origins, all but the number of municipalities. Mixed reference systems raise."""
    status = F.col("population_data_status")
    figures = [
        F.count(F.lit(1)).alias("output_sectors"),
        F.count_if(status == STATUS_LEFT_ONLY).alias("geometry_only_zero_population_sectors"),
        F.count_if(status == STATUS_UNAVAILABLE).alias("female_population_unavailable_sectors"),
        F.coalesce(F.sum("female_population"), F.lit(0)).cast("bigint").alias("female_population_observed"),
    ]
    if crs:
        mixed = F.raise_error(F.lit("origins mix several reference systems"))
        figures.append(F.when(F.min(crs) != F.max(crs), mixed).otherwise(F.min(crs)).alias("crs"))
    return figures


def origins_audit(counted: Mapping[str, int], origins: DataFrame, municipality: str, crs: str | None = None) -> DataFrame:
    """One row with the figures published about a set of origins.

    ``counted`` has the ``feature_figures``, as observed while the grouped sectors were written; ``origins`` is the labelled result.
    """
    row = origins.agg(F.count_distinct(municipality).alias("municipalities"), *origin_figures(crs))
    return row.select("*", *[F.lit(n).cast("bigint").alias(name) for name, n in counted.items()])
