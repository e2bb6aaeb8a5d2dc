"""Door-to-door time and accessibility over a table of travel legs that is already computed.

Legs are (itinerary_id, origin_id, destination_id, category, mode, component, minutes). Legs are
summed per itinerary before scenarios multiply anything, and scenarios and thresholds are constants
in the plan, so no join is needed for either.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ribeira.fixed import COMPONENTS, MODES, SCENARIOS, THRESHOLDS_MINUTES
from ribeira.functions.sql import text, texts

ITINERARY = ["itinerary_id", "origin_id", "destination_id", "category"]
MICRO, MOST_MINUTES = 1_000_000, 1e9


def decide_waiting(
    scenarios: Mapping[str, tuple[bool | None, bool]], overrides: Mapping[str, bool] | None = None
) -> dict[str, tuple[bool, bool]]:
    """Scenarios with every open waiting rule settled by the caller; one left open raises."""
    settled = {}
    for name, (waiting, transfers) in scenarios.items():
        waiting = (overrides or {}).get(name, waiting)
        if waiting is None:
            raise ValueError(f"scenario {name!r} needs a decision on waiting time")
        settled[name] = (waiting, transfers)
    return settled


def shared_rules(
    scenarios: Mapping[str, tuple[bool | None, bool]] = SCENARIOS, overrides: Mapping[str, bool] | None = None
) -> tuple[dict[str, tuple[bool, bool]], dict[str, list[str]]]:
    """Scenarios reduced to their distinct rules, and which scenarios share each rule.

    Times depend on a scenario only through its rules. Summaries are worked out on the few rules
    (pass the first result as ``scenarios``) and named afterwards with ``name_scenarios``, so that
    no scenario is computed twice.
    """
    rules: dict[str, tuple[bool, bool]] = {}
    members: dict[str, list[str]] = {}
    for name, (waiting, transfers) in decide_waiting(scenarios, overrides).items():
        label = f"waiting={waiting} transfers={transfers}"
        rules[label] = (waiting, transfers)
        members.setdefault(label, []).append(name)
    return rules, members


def name_scenarios(df: DataFrame, members: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows of each rule once per scenario that has it."""
    entries = ", ".join(f"{text(label)}, array({texts(names)})" for label, names in members.items())
    others = [name for name in df.columns if name != "scenario"]
    return df.select(*others, F.explode(F.expr(f"map({entries})[scenario]")).alias("scenario")).select(*df.columns)


def _scenario_rows(settled: Mapping[str, tuple[bool, bool]]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                F.lit(waiting).alias("includes_waiting"),
                F.lit(transfers).alias("includes_transfers"),
            )
            for name, (waiting, transfers) in settled.items()
        ]
    )


def _uses_disabled(modes: Mapping[str, bool]) -> Column:
    """A mode that is unknown or null is not known to be enabled, and counts as disabled."""
    return ~F.coalesce(F.col("mode").isin([mode for mode, enabled in modes.items() if enabled]), F.lit(False))


def scenario_expand(
    legs: DataFrame,
    scenarios: Mapping[str, tuple[bool | None, bool]] = SCENARIOS,
    modes: Mapping[str, bool] = MODES,
    waiting_overrides: Mapping[str, bool] | None = None,
) -> DataFrame:
    """Legs that count, per scenario; an itinerary with any leg in a disabled mode is left out whole.

    Legs are read once: whether an itinerary is barred is known from the exchange that brings its legs together, which a join on the
    itinerary before makes needless. Legs without an itinerary count as one, as in ``door_to_door``, which does not need this table; it is
    for looking at single legs.
    """
    settled = decide_waiting(scenarios, waiting_overrides)
    barred = F.bool_or(_uses_disabled(modes)).over(Window.partitionBy("itinerary_id"))
    usable = legs.withColumn("__barred", barred).filter(~F.col("__barred")).drop("__barred")
    rows = usable.select("*", F.inline(_scenario_rows(settled)))
    skipped = ((F.col("component") == "waiting") & ~F.col("includes_waiting")) | (
        (F.col("component") == "transfer") & ~F.col("includes_transfers")
    )
    return rows.filter(~skipped).drop("includes_waiting", "includes_transfers")


def leg_gaps(legs: DataFrame) -> DataFrame:
    """One row: legs whose minutes are unknown (null, not finite, over 10^9), and legs whose component or mode is not a known one."""
    return legs.agg(
        F.count(F.lit(1)).alias("legs"),
        F.count_if(_micro_minutes(F.col("minutes")).isNull()).alias("without_minutes"),
        F.count_if(_unknown_component()).alias("unknown_component"),
        F.count_if(~F.coalesce(F.col("mode").isin(*MODES), F.lit(False))).alias("unknown_mode"),
    )


def _unknown_component() -> Column:
    return ~F.coalesce(F.col("component").isin(COMPONENTS), F.lit(False))


def _micro_minutes(minutes: Column) -> Column:
    """Minutes as whole millionths, which add up to the same in any order; null if they are no number or over ``MOST_MINUTES``."""
    number = minutes.cast("double")
    return F.when(F.abs(number) <= MOST_MINUTES, F.floor(number * MICRO + 0.5).cast("bigint"))


def _summed(legs: DataFrame, modes: Mapping[str, bool]) -> DataFrame:
    """Per usable itinerary: millionths of minutes per component, and ``gaps``, bit i for a leg of component i whose minutes are unknown.

    A leg of no known component sets all bits. One aggregation with partial sums: a sum per component, and one mask for all flags.
    """
    exact, barred, every = _micro_minutes(F.col("minutes")), 1 << len(COMPONENTS), (1 << len(COMPONENTS)) - 1
    unknown = F.when(_unknown_component(), every).when(exact.isNull(), _bit(F.col("component"))).otherwise(0)
    flags = F.bit_or(F.when(_uses_disabled(modes), barred).otherwise(0).bitwiseOR(unknown))
    sums = [F.coalesce(F.sum(F.when(F.col("component") == name, exact)), F.lit(0)).alias(name) for name in COMPONENTS]
    return legs.groupBy(*ITINERARY).agg(*sums, flags.alias("gaps")).filter(F.col("gaps") < barred)


def _bit(component: Column) -> Column:
    return reduce(lambda c, i: c.when(component == COMPONENTS[i], 1 << i), range(1, len(COMPONENTS)), F.when(component == COMPONENTS[0], 1))


def component_times(legs: DataFrame, modes: Mapping[str, bool] = MODES) -> DataFrame:
    """Per usable itinerary: minutes in each component, to a millionth.

    A component with a leg whose minutes are unknown (null, not finite, over 10^9) is null, and every component is null where a leg
    belongs to none of them.
    """
    known = [
        F.when(F.col("gaps").bitwiseAND(F.lit(1 << i)) == 0, F.col(name) / F.lit(float(MICRO))).alias(name) for i, name in enumerate(COMPONENTS)
    ]
    return _summed(legs, modes).select(*ITINERARY, *known)


def door_to_door(
    legs: DataFrame,
    waiting_overrides: Mapping[str, bool] | None = None,
    scenarios: Mapping[str, tuple[bool | None, bool]] = SCENARIOS,
    modes: Mapping[str, bool] = MODES,
) -> DataFrame:
    """Total minutes per itinerary and scenario: access, waiting, in-vehicle, transfer and egress.

    The total is null where the minutes of a counted leg are unknown, or where a leg's component is;
    ``leg_gaps`` counts such legs.
    """
    rows = []
    for name, (waiting, transfers) in decide_waiting(scenarios, waiting_overrides).items():
        taken = {"waiting": waiting, "transfer": transfers}
        counted = [(1 << i, c) for i, c in enumerate(COMPONENTS) if taken.get(c, True)]
        mask = sum(bit for bit, _ in counted)
        total = reduce(lambda a, b: a + b, (F.col(c) for _, c in counted)) / F.lit(float(MICRO))
        minutes = F.when(F.col("gaps").bitwiseAND(F.lit(mask)) == 0, total)
        rows.append(F.struct(F.lit(name).alias("scenario"), minutes.alias("minutes")))
    return _summed(legs, modes).select(*ITINERARY, F.inline(F.array(*rows)))


def min_time(times: DataFrame) -> DataFrame:
    """Shortest time per origin, category and scenario; categories are never merged."""
    return times.groupBy("origin_id", "category", "scenario").agg(F.min("minutes").alias("minutes"))


def cumulative_access(times: DataFrame, thresholds: Sequence[int] = THRESHOLDS_MINUTES) -> DataFrame:
    """Destinations within each threshold (inclusive) per origin, category and scenario.

    A destination counts once, at its shortest time.
    """
    group = ["origin_id", "category", "scenario"]
    nearest = times.groupBy(*group, "destination_id").agg(F.min("minutes").alias("minutes"))
    counted = nearest.groupBy(*group).agg(
        *[F.count_if(F.col("minutes") <= limit).alias(f"within_{limit}") for limit in thresholds]
    )
    rows = [
        F.struct(F.lit(limit).alias("threshold"), F.col(f"within_{limit}").alias("destinations")) for limit in thresholds
    ]
    return counted.select(*group, F.inline(F.array(*rows)))


def weighted_summary(
    times: DataFrame, origins: DataFrame, municipality: str = "CD_MUN", weight: str = "female_population"
) -> DataFrame:
    """Population-weighted mean time per municipality, category and scenario.

    Origins whose population is unknown leave the weight and are counted apart.
    """
    weights = origins.select("origin_id", municipality, F.col(weight).alias("__weight"))
    w, t = F.col("__weight"), F.col("minutes")
    return (
        times.join(weights, "origin_id")
        .groupBy(municipality, "category", "scenario")
        .agg(
            (F.sum((w * t).cast("decimal(28,6)")).cast("double") / F.nullif(F.sum(F.when(t.isNotNull(), w)), F.lit(0))).alias("weighted_minutes"),
            F.coalesce(F.sum(w), F.lit(0)).cast("bigint").alias("population"),
            F.count_if(w.isNull()).alias("origins_without_population"),
        )
    )


def coverage(
    origins: DataFrame, times: DataFrame, municipality: str = "CD_MUN", weight: str = "female_population"
) -> DataFrame:
    """Per municipality, two separate shares: sectors with known population, and population analysed.

    An origin is analysed if it has a time, to whatever destination.
    """
    reached = times.filter("minutes IS NOT NULL").select("origin_id").distinct().withColumn("__reached", F.lit(True))
    rows = origins.select("origin_id", municipality, weight).join(reached, "origin_id", "left")
    w = F.col(weight)
    return (
        rows.groupBy(municipality)
        .agg(
            F.count(F.lit(1)).alias("sectors"),
            F.count_if(w.isNotNull()).alias("sectors_known"),
            F.coalesce(F.sum(w), F.lit(0)).cast("bigint").alias("population_known"),
            F.coalesce(F.sum(F.when(F.col("__reached"), w)), F.lit(0)).cast("bigint").alias("population_analysed"),
        )
        .withColumns(
            {
                "sector_coverage": F.col("sectors_known") / F.col("sectors"),
                "population_coverage": F.col("population_analysed") / F.nullif(F.col("population_known"), F.lit(0)),
            }
        )
    )
