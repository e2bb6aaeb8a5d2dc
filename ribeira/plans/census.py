"""Census origins: multipart sector features and demography to one audited row per sector."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ribeira import fixed
from ribeira.operators.dissolve import dissolve_parts, group_features
from ribeira.operators.filters import drop_if_present
from ribeira.operators.joins import LEFT_ONLY, validated_left_join
from ribeira.operators.quality import (
    expectations,
    keyed_profile,
    not_zero,
    profile_figures,
    raise_on,
    raise_on_counts,
    row_rules,
    to_long,
    unique_rule,
)
from ribeira.operators.status import feature_figures, label_origins, origin_figures
from ribeira.session import materialize
from ribeira.sources.delimited import read_demography
from ribeira.sources.publication import Run
from ribeira.sources.sinks import write_origins, write_partitioned, write_record, write_summary

RULE_ROWS = "demography has rows"
RULE_KEYS = "demography keys are unique"
RULE_IDENTITY = "total = male + female"
RULE_CONFLICTS = "features of a sector agree"
RULE_LEFT_ONLY = "sectors without demography have basic population 0"


@dataclass(frozen=True)
class SectorColumns:
    """Column names of the two inputs; the defaults are those of the 2022 census."""

    key: str = fixed.SECTOR_KEY
    demography_key: str = fixed.DEMOGRAPHY_KEY
    municipality: str = fixed.MUNICIPALITY_KEY
    total: str = fixed.POPULATION_TOTAL
    male: str = fixed.POPULATION_MALE
    female: str = fixed.POPULATION_FEMALE
    basic: str = fixed.BASIC_POPULATION
    geometry: str = "geom_wkb"
    crs: str | None = "crs"
    feature_id: str = "id"
    other_measures: Sequence[str] = field(default_factory=lambda: list(fixed.FEMALE_AGE_GROUPS))
    summary: Sequence[str] = field(default_factory=lambda: list(fixed.SUMMARY_COLUMNS))

    def attributes(self, features: DataFrame) -> list[str]:
        return [name for name in features.columns if name not in (self.key, self.geometry, self.feature_id)]


def group_sectors(features: DataFrame, names: SectorColumns) -> DataFrame:
    """Attributes, feature count and conflicts per sector key, the null key included."""
    plain = drop_if_present(features, names.feature_id)
    return group_features(plain, names.key, names.attributes(features))


def label_sectors(
    grouped: DataFrame, demography: DataFrame, names: SectorColumns, *, demography_is_unique: bool = True
) -> DataFrame:
    """Origins from grouped sectors: join, status, zero fill and population aliases (lazy).

    The grouped side is unique by construction. Both sides of the join are hash-partitioned by the
    sector key; the grouping has already put its side there.
    """
    sectors = grouped.filter(F.col(names.key).isNotNull()).drop("conflicts")
    joined = validated_left_join(
        sectors,
        demography,
        names.key,
        names.demography_key,
        left_is_unique=True,
        right_is_unique=demography_is_unique,
    )
    return label_origins(joined, names.total, names.male, names.female)


def left_only_rule(origins: DataFrame, names: SectorColumns) -> DataFrame:
    """(rule, violations): sectors without demography whose basic population is not exactly zero."""
    left_only = F.col("_merge") == LEFT_ONLY
    return row_rules(origins, {RULE_LEFT_ONLY: left_only & not_zero(F.col(names.basic))})


def profile_checks(profile: DataFrame) -> DataFrame:
    """The demography rules read off its one-pass profile."""
    counts = profile.select(
        F.when(F.col("rows") == 0, 1).otherwise(0).alias("empty"), "repeated_keys", "identity_violations"
    )
    return to_long(
        counts, {RULE_ROWS: "empty", RULE_KEYS: "repeated_keys", RULE_IDENTITY: "identity_violations"}, "rule", "violations"
    )


def census_checks(features: DataFrame, demography: DataFrame, names: SectorColumns) -> DataFrame:
    """(rule, violations) of all rules (runs jobs).

    Demography and grouped sectors are written once, so that either input's own recipe runs a single
    time; the demography's rules come from its one-pass profile, and conflicts are counted as the sectors are written.
    """
    people = materialize(demography, "demography")
    grouped, counted = write_grouped(features, names)
    conflicts = demography.sparkSession.createDataFrame([(RULE_CONFLICTS, counted["conflicts"])], "rule STRING, violations BIGINT")
    profile = keyed_profile(people, names.demography_key, names.total, [names.male, names.female], names.female)
    return expectations(profile_checks(profile), conflicts, left_only_rule(label_sectors(grouped, people, names), names))


def write_grouped(features: DataFrame, names: SectorColumns) -> tuple[DataFrame, dict]:
    """The grouped sectors as a table, and what its writing has counted: features, keys, sectors whose features disagree."""
    seen, grouped = Observation(), group_sectors(features, names)
    conflicts = F.count_if(F.size("conflicts") > 0).alias("conflicts")
    table = materialize(grouped.observe(seen, *feature_figures(names.key), conflicts), "sectors")
    return table, seen.get


def audit_table(spark: SparkSession, figures: Mapping[str, object], schema: str) -> DataFrame:
    names = [field.split()[0] for field in schema.split(", ")]
    return spark.createDataFrame([tuple(figures.get(name) for name in names)], schema)


AUDIT = (
    "source_features BIGINT, unique_geometry_sectors BIGINT, multipart_extra_features BIGINT, output_sectors BIGINT, municipalities BIGINT, "
    "geometry_only_zero_population_sectors BIGINT, female_population_unavailable_sectors BIGINT, female_population_observed BIGINT"
)


def run_census_origins(
    spark: SparkSession,
    features: DataFrame,
    demography_path: str,
    out: str,
    names: SectorColumns = SectorColumns(),
    state_code: str = fixed.STATE_CODE,
    stage: Callable[[str, DataFrame, Callable[[DataFrame, str], None]], object] | None = None,
) -> dict[str, dict]:
    """The whole job: check, dissolve, join, label, check again, write; returns the two audits.

    The demography of the state, the grouped sectors and the labelled origins are each written once to the work folder. All rules and
    figures about them are counted by these writes (``Observation``), and demography keys are checked inside the join: no
    table is read again for a check. The number of municipalities is counted on the one column that the audit needs. Nothing is published if
    a check fails.

    Writes below ``out``: ``origins`` and ``parts`` (Parquet, partitioned by municipality),
    ``summary`` (CSV) and ``audit`` (JSON), each through ``stage(name, df, write)`` if that is given.
    """
    measures = [names.total, names.male, names.female, *names.other_measures]
    people = read_demography(spark, demography_path, state_code, names.demography_key, measures)
    seen = Observation()
    of_people = profile_figures(names.demography_key, names.total, [names.male, names.female], names.female)
    demography = materialize(people.observe(seen, *of_people), "demography")
    profile = seen.get
    raise_on_counts({RULE_ROWS: int(profile["rows"] == 0), RULE_IDENTITY: profile["identity_violations"]})

    grouped, of_features = write_grouped(features, names)
    raise_on_counts({RULE_CONFLICTS: of_features.pop("conflicts")})
    seen = Observation()
    left_only = F.count_if((F.col("_merge") == LEFT_ONLY) & not_zero(F.col(names.basic))).alias("left_only")
    labelled = label_sectors(grouped, demography, names, demography_is_unique=False)
    try:
        origins = materialize(labelled.observe(seen, *origin_figures(names.crs), left_only), "origins")
    except SparkRuntimeException as error:
        if "is not unique" in str(error):
            raise_on(unique_rule(demography, [names.demography_key], RULE_KEYS))
        raise
    of_origins = seen.get
    raise_on_counts({RULE_LEFT_ONLY: of_origins.pop("left_only")})

    def put(name: str, df: DataFrame, write: Callable[[DataFrame, str], None]) -> None:
        stage(name, df, write) if stage else write(df, f"{out}/{name}")

    municipalities = origins.agg(F.count_distinct(names.municipality).alias("n")).first()["n"]
    figures = of_features | of_origins | {"municipalities": municipalities}
    put("origins", origins, lambda df, path: write_origins(df, path, names.municipality))
    parts = dissolve_parts(features, names.key, names.geometry, [names.municipality])
    put("parts", parts, lambda df, path: write_partitioned(df, path, names.municipality))
    put("summary", origins.select(*names.summary), lambda df, path: write_summary(df, path, names.summary))
    audit = audit_table(spark, figures, AUDIT + (", crs STRING" if names.crs else ""))
    put("audit", audit, write_record)
    return {"demography": profile | {"repeated_keys": 0}, "spatial": {name: figures[name] for name in audit.columns}}


def publish_census_origins(
    spark: SparkSession,
    features: DataFrame,
    demography_path: str,
    out: str,
    run_id: str,
    names: SectorColumns = SectorColumns(),
    state_code: str = fixed.STATE_CODE,
) -> bool:
    """The job as a unit: its four tables become visible together, by the manifest of ``run_id``. False if that run was published before."""
    run = Run(spark, out, run_id)
    if run.manifest() is not None:
        return False
    audits = run_census_origins(spark, features, demography_path, run.folder, names, state_code, run.stage)
    run.commit(audits["spatial"] | {f"demography_{k}": v for k, v in audits["demography"].items()})
    return True
