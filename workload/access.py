"""Accessibility over legs.

An itinerary is an order and a leg is a line of it; the origin is the customer, the destination the
month, the category the order priority. Origins carry a municipality and a population.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.fixed import SCENARIOS
from ribeira.operators.access import (
    coverage,
    cumulative_access,
    door_to_door,
    leg_gaps,
    min_time,
    name_scenarios,
    scenario_expand,
    shared_rules,
    weighted_summary,
)
from workload.registry import query, table

OVERRIDES = {"emergency": True}
# Gaps as they occur in practice: components and modes that are no known ones, and legs without minutes.
COMPONENT = """CASE CASE WHEN l_linenumber = 6 AND l_quantity = 50 THEN 5 ELSE l_linenumber % 5 END WHEN 5 THEN 'parking' WHEN 0 THEN 'access' WHEN 1 THEN 'waiting' WHEN 2 THEN 'in_vehicle'
  WHEN 3 THEN 'transfer' ELSE 'egress' END"""
MODE = """CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'air' WHEN l_linenumber = 5 AND l_quantity = 7 THEN NULL WHEN l_returnflag = 'A' THEN 'road'
  WHEN l_returnflag = 'N' THEN 'river' ELSE 'walking' END"""

ACCESS_SQL = f"""
WITH legs AS (
  SELECT o_orderkey AS itinerary_id, o_custkey AS origin_id, 'month_' || month(o_orderdate) AS destination_id,
         o_orderpriority AS category, {MODE} AS mode, {COMPONENT} AS component, nullif(l_quantity, 13) AS minutes
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
scenarios(scenario, includes_waiting) AS (VALUES ('theoretical_minimum', false), ('local_access', false),
  ('motorized', false), ('operational', true), ('emergency', true), ('flood_season', true), ('dry_season', true)),
expanded AS (
  SELECT legs.*, scenario FROM legs, scenarios
  WHERE itinerary_id NOT IN (SELECT itinerary_id FROM legs WHERE mode = 'air' OR mode IS NULL) AND (includes_waiting OR component <> 'waiting')),
totals AS (
  SELECT itinerary_id, origin_id, destination_id, category, scenario,
         CASE WHEN NOT bool_or(component = 'parking') AND NOT bool_or(minutes IS NULL AND (includes_waiting OR component <> 'waiting'))
           THEN coalesce(sum(minutes) FILTER (WHERE includes_waiting OR component <> 'waiting'), 0) END AS minutes
  FROM legs, scenarios WHERE itinerary_id NOT IN (SELECT itinerary_id FROM legs WHERE mode = 'air' OR mode IS NULL)
  GROUP BY 1, 2, 3, 4, 5),
nearest AS (SELECT origin_id, category, scenario, min(minutes) AS minutes FROM totals GROUP BY 1, 2, 3),
origins AS (
  SELECT c_custkey AS origin_id, c_nationkey AS CD_MUN,
         CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(floor(c_acctbal) AS BIGINT) + 1000 END AS female_population FROM customer)
"""


def legs(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    lines = table(spark, folder, "lineitem")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("itinerary_id"),
        F.col("o_custkey").alias("origin_id"),
        F.concat(F.lit("month_"), F.month("o_orderdate")).alias("destination_id"),
        F.col("o_orderpriority").alias("category"),
        F.expr(MODE).alias("mode"),
        F.expr(COMPONENT).alias("component"),
        F.nullif("l_quantity", F.lit(13)).alias("minutes"),
    )


RULES, MEMBERS = shared_rules(SCENARIOS, OVERRIDES)


def times(spark: SparkSession, folder: str) -> DataFrame:
    """Times by rule; the summaries below are named by scenario at the end."""
    return door_to_door(legs(spark, folder), scenarios=RULES)


def origins(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("origin_id"),
        F.col("c_nationkey").alias("CD_MUN"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.floor("c_acctbal") + 1000).alias("female_population"),
    )


@query("scenario_expand", ACCESS_SQL + "SELECT * FROM expanded")
def expand(spark, folder):
    return scenario_expand(legs(spark, folder), waiting_overrides=OVERRIDES)


@query(
    "leg_gaps",
    ACCESS_SQL
    + """
SELECT count(*) AS legs, count(*) FILTER (WHERE minutes IS NULL) AS without_minutes,
       count(*) FILTER (WHERE component = 'parking') AS unknown_component, count(*) FILTER (WHERE mode IS NULL) AS unknown_mode FROM legs
""",
)
def gaps(spark, folder):
    return leg_gaps(legs(spark, folder))


@query("door_to_door", ACCESS_SQL + "SELECT * FROM totals")
def totals(spark, folder):
    return door_to_door(legs(spark, folder), OVERRIDES)


@query("min_time", ACCESS_SQL + "SELECT * FROM nearest")
def nearest(spark, folder):
    return name_scenarios(min_time(times(spark, folder)), MEMBERS)


@query(
    "cumulative_access",
    ACCESS_SQL
    + """
SELECT origin_id, category, scenario, CAST(threshold AS INTEGER) AS threshold,
       count(DISTINCT destination_id) FILTER (WHERE minutes <= threshold) AS destinations
FROM totals, (VALUES (30), (60), (120), (180), (240)) t(threshold) GROUP BY 1, 2, 3, 4
""",
)
def cumulative(spark, folder):
    return name_scenarios(cumulative_access(times(spark, folder)), MEMBERS)


@query(
    "weighted_summary",
    ACCESS_SQL
    + """
SELECT CD_MUN, category, scenario,
       sum(female_population * minutes) / nullif(sum(female_population) FILTER (WHERE minutes IS NOT NULL), 0) AS weighted_minutes,
       CAST(coalesce(sum(female_population), 0) AS BIGINT) AS population,
       count(*) FILTER (WHERE female_population IS NULL) AS origins_without_population
FROM nearest JOIN origins USING (origin_id) GROUP BY 1, 2, 3
""",
)
def weighted(spark, folder):
    summary = weighted_summary(min_time(times(spark, folder)), origins(spark, folder))
    return name_scenarios(summary, MEMBERS)


@query(
    "coverage",
    ACCESS_SQL
    + """
, counted AS (
  SELECT CD_MUN, count(*) AS sectors, count(female_population) AS sectors_known,
         CAST(coalesce(sum(female_population), 0) AS BIGINT) AS population_known,
         CAST(coalesce(sum(female_population) FILTER (WHERE origin_id IN (
           SELECT origin_id FROM totals WHERE minutes IS NOT NULL)), 0) AS BIGINT) AS population_analysed
  FROM origins GROUP BY CD_MUN)
SELECT *, sectors_known / sectors AS sector_coverage, population_analysed / nullif(population_known, 0) AS population_coverage
FROM counted
""",
)
def covered(spark, folder):
    return coverage(origins(spark, folder), times(spark, folder))
