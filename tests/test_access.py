"""Door-to-door time and accessibility on small leg tables."""

import pytest

from ribeira import fixed
from ribeira.operators.access import (
    component_times,
    coverage,
    cumulative_access,
    decide_waiting,
    door_to_door,
    leg_gaps,
    min_time,
    name_scenarios,
    scenario_expand,
    shared_rules,
    weighted_summary,
)

LEGS = "itinerary_id BIGINT, origin_id STRING, destination_id STRING, category STRING, mode STRING, component STRING, minutes DOUBLE"
YES = {"emergency": True}


def legs(spark, *rows):
    return spark.createDataFrame(list(rows), LEGS)


def trip(number, minutes, origin="o", destination="d", mode="road", category="health"):
    return [(number, origin, destination, category, mode, c, m) for c, m in zip(fixed.COMPONENTS, minutes)]


def test_components_add_up(spark):
    df = legs(spark, *trip(1, [5.0, 10.0, 20.0, 5.0, 5.0]))
    got = {r["scenario"]: r["minutes"] for r in door_to_door(df, YES).collect()}
    assert got == {
        "theoretical_minimum": 35.0, "local_access": 35.0, "motorized": 35.0, "operational": 45.0, "emergency": 45.0,
        "flood_season": 45.0, "dry_season": 45.0,
    }
    assert door_to_door(df, {"emergency": False}).filter("scenario = 'emergency'").first()["minutes"] == 35.0
    assert scenario_expand(df, waiting_overrides=YES).groupBy("scenario").sum("minutes").filter("scenario = 'motorized'").first()[1] == 35.0


def test_disabled_modes(spark):
    assert [mode for mode, enabled in fixed.MODES.items() if not enabled] == ["air"]
    df = legs(spark, *trip(1, [1.0] * 5), (1, "o", "d", "health", "air", "in_vehicle", 1.0), *trip(2, [2.0] * 5))
    assert {r["itinerary_id"] for r in door_to_door(df, YES).collect()} == {2}
    assert {r["itinerary_id"] for r in scenario_expand(df, waiting_overrides=YES).collect()} == {2}
    everything = {mode: True for mode in fixed.MODES}
    assert door_to_door(df, YES, modes=everything).filter("scenario = 'operational'").count() == 2


def test_emergency_needs_a_decision(spark):
    with pytest.raises(ValueError, match="emergency"):
        door_to_door(legs(spark, *trip(1, [1.0] * 5)))
    assert decide_waiting(fixed.SCENARIOS, {"emergency": False})["emergency"] == (False, True)


def times(spark, *rows):
    return spark.createDataFrame(list(rows), "origin_id STRING, destination_id STRING, category STRING, scenario STRING, minutes DOUBLE")


def test_summaries_by_rule_are_those_by_scenario(spark):
    df = legs(spark, *trip(1, [5.0, 10.0, 20.0, 5.0, 5.0]), *trip(2, [1.0, 90.0, 2.0, 3.0, 4.0], destination="e"))
    rules, members = shared_rules(fixed.SCENARIOS, YES)
    assert len(rules) == 2 and sorted(n for names in members.values() for n in names) == sorted(fixed.SCENARIOS)
    by_rule, by_scenario = door_to_door(df, scenarios=rules), door_to_door(df, YES)
    for summary in (min_time, cumulative_access):
        assert sorted(name_scenarios(summary(by_rule), members).collect()) == sorted(summary(by_scenario).collect())


def test_nearest_keeps_categories_apart(spark):
    df = times(spark, ("o", "a", "health", "s", 20.0), ("o", "b", "health", "s", 10.0), ("o", "a", "justice", "s", 30.0))
    got = min_time(df).collect()
    assert sorted((r["category"], r["minutes"]) for r in got) == [("health", 10.0), ("justice", 30.0)]


def test_thresholds_are_inclusive_and_destinations_count_once(spark):
    df = times(spark, ("o", "a", "h", "s", 60.0), ("o", "a", "h", "s", 200.0), ("o", "b", "h", "s", 241.0))
    got = {r["threshold"]: r["destinations"] for r in cumulative_access(df).collect()}
    assert got == {30: 0, 60: 1, 120: 1, 180: 1, 240: 1}


def test_weights_and_coverage(spark):
    df = times(spark, ("o1", "a", "h", "s", 10.0), ("o2", "a", "h", "s", 40.0), ("o3", "a", "h", "s", 99.0))
    origins = spark.createDataFrame(
        [("o1", "M", 1), ("o2", "M", 2), ("o3", "M", None), ("o4", "M", 7), ("o5", "N", 0)],
        "origin_id STRING, CD_MUN STRING, female_population INT",
    )
    row = weighted_summary(df, origins).first()
    assert (row["weighted_minutes"], row["population"], row["origins_without_population"]) == (30.0, 3, 1)
    got = {r["CD_MUN"]: (r["sector_coverage"], r["population_coverage"]) for r in coverage(origins, df).collect()}
    assert got == {"M": (0.75, 0.3), "N": (1.0, None)}


def test_times_of_unknown_length_leave_the_weight(spark):
    df = times(spark, ("o1", "a", "h", "s", 10.0), ("o2", "a", "h", "s", None))
    origins = spark.createDataFrame([("o1", "M", 1), ("o2", "M", 3)], "origin_id STRING, CD_MUN STRING, female_population INT")
    assert weighted_summary(df, origins).first()["weighted_minutes"] == 10.0


def test_gaps_in_the_legs(spark):
    df = legs(
        spark, *trip(1, [1.0] * 5), *trip(2, [1.0, None, 1.0, 1.0, 1.0]), *trip(3, [1.0] * 5), (3, "o", "d", "health", "road", "parking", 9.0),
        *trip(4, [1.0] * 5), (4, "o", "d", "health", None, "access", 1.0), *trip(5, [1.0] * 5), (5, "o", "d", "health", "balloon", "access", 1.0),
        *trip(6, [None, 1.0, 1.0, 1.0, 1.0]),
    )
    got = {(r["itinerary_id"], r["scenario"]): r["minutes"] for r in door_to_door(df, YES).collect()}
    assert {i for i, _ in got} == {1, 2, 3, 6}
    assert (got[1, "operational"], got[2, "operational"], got[3, "operational"], got[6, "operational"]) == (5.0, None, None, None)
    assert got[2, "motorized"] == 4.0  # waiting doesn't count there
    assert {r["itinerary_id"] for r in scenario_expand(df, waiting_overrides=YES).select("itinerary_id").distinct().collect()} == {1, 2, 3, 6}
    assert tuple(leg_gaps(df).first()) == (33, 2, 1, 2)
    best = {r["scenario"]: r["minutes"] for r in min_time(door_to_door(df, YES)).collect()}
    assert best["operational"] == 5.0


def test_fractions_add_up_alike_in_any_partitioning(spark):
    df = spark.range(20_000).selectExpr(
        "id % 50 AS itinerary_id", "'o' AS origin_id", "'d' AS destination_id", "'health' AS category", "'road' AS mode", "'access' AS component",
        "CAST(id % 997 AS DOUBLE) / 7 AS minutes",
    )
    results = [
        {(r["itinerary_id"], r["scenario"]): r["minutes"].hex() for r in door_to_door(df.repartition(n), YES).collect()} for n in (1, 8)
    ]
    assert results[0] == results[1]


def test_minutes_that_are_no_number(spark):
    """Unknown minutes make the scenarios that count their leg unknown, and no others; sums don't depend on the order of legs."""
    nan, inf = float("nan"), float("inf")
    df = legs(spark, *trip(1, [1.0, nan, 1.0, 1.0, 1.0]), *trip(2, [1.0, 1.0, inf, 1.0, 1.0]), *trip(3, [1.0, None, 1.0, 1.0, 1.0]),
              *trip(4, [0.1, 0.2, 0.3, 1e10, 0.0]), *trip(5, [0.1, 0.2, 0.3, 0.0, 0.0]), *trip(5, [0.7, 0.1, 1e-7, 0.0, 0.0]))
    got = {(r["itinerary_id"], r["scenario"]): r["minutes"] for r in door_to_door(df, YES).collect()}
    assert [got[(n, "operational")] for n in (1, 2, 3, 4, 5)] == [None, None, None, None, 1.4]
    assert [got[(n, "motorized")] for n in (1, 2, 3, 4, 5)] == [4.0, None, 4.0, None, 1.1]
    assert leg_gaps(df).first()["without_minutes"] == 4
    times = {r["itinerary_id"]: r for r in component_times(df).collect()}
    assert (times[1]["waiting"], times[1]["access"], times[4]["transfer"], times[5]["waiting"]) == (None, 1.0, None, 0.3)


def test_travel_times_need_one_exchange(spark):
    plan = door_to_door(legs(spark, *trip(1, [1.0] * 5)), YES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("partial_sum") == len(fixed.COMPONENTS) and plan.count("partial_bit_or") == 1
