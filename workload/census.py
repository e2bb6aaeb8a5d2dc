"""Census operators.

Stand-ins: a sector is a customer and its parts are the customer's orders. Demography counts the
lines of the customer's orders in status F and suppresses the female figure of small sectors; the
basic population on the geometry side is the number of such orders.
"""

from __future__ import annotations

import re

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.functions.text import coerce_numeric
from ribeira.operators.dissolve import dissolve_parts, dissolve_sectors, multipart_stats
from ribeira.operators.filters import drop_if_present, prefix_filter
from ribeira.operators.joins import right_only, validated_left_join
from ribeira.operators.provenance import write_with_provenance
from ribeira.operators.quality import (
    attribute_conflicts,
    completeness_audit,
    duplicate_keys,
    identity_violations,
    keyed_profile,
)
from ribeira.operators.status import origins_audit, status_label, zero_fill
from ribeira.plans.census import (
    SectorColumns,
    census_checks,
    group_sectors,
    label_sectors,
    publish_census_origins,
    run_census_origins,
    write_grouped,
)
from ribeira.session import work_dir
from ribeira.sources.delimited import scan_delimited
from ribeira.sources.publication import published_path
from ribeira.sources.sinks import write_origins, write_summary
from workload.registry import query, table

NAMES = SectorColumns(
    key="sector_id",
    demography_key="demo_id",
    municipality="mun_id",
    total="total",
    male="male",
    female="female",
    basic="v0001",
    geometry="geom_wkb",
    crs=None,
    feature_id="part_id",
    other_measures=[],
    summary=["sector_id", "mun_id", "sector_name", "situation", "total_population", "male", "female_population", "population_data_status"],
)


def features(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    basic = orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("v0001"))
    customer = table(spark, folder, "customer")
    return (
        orders.join(basic, "o_custkey")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_custkey").cast("string").alias("sector_id"),
            F.col("o_orderkey").alias("part_id"),
            F.col("c_name").alias("sector_name"),
            F.col("c_nationkey").cast("string").alias("mun_id"),
            F.col("c_mktsegment").alias("situation"),
            F.col("v0001").cast("double").alias("v0001"),
            F.col("o_orderkey").cast("string").cast("binary").alias("geom_wkb"),
        )
    )


def demography(spark: SparkSession, folder: str) -> DataFrame:
    # Lines are summed per order first, so the join moves one row per order.
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("n_male")
    )
    orders = table(spark, folder, "orders").filter(F.col("o_orderstatus") == "F")
    per_sector = (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_custkey")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total"),
            F.coalesce(F.sum("n_male"), F.lit(0)).cast("double").alias("male"),
        )
    )
    return per_sector.select(
        F.col("o_custkey").cast("string").alias("demo_id"),
        "total",
        "male",
        F.when(F.col("total") >= 5, F.col("total") - F.col("male")).alias("female"),
    )


CENSUS_SQL = """
WITH basic AS (
  SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS v0001 FROM orders GROUP BY o_custkey),
features AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS sector_id, o.o_orderkey AS part_id, c.c_name AS sector_name,
         CAST(c.c_nationkey AS VARCHAR) AS mun_id, c.c_mktsegment AS situation, CAST(b.v0001 AS DOUBLE) AS v0001,
         CAST(o.o_orderkey AS VARCHAR) AS part
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN basic b ON o.o_custkey = b.o_custkey),
demo AS (
  SELECT demo_id, total, male, CASE WHEN total >= 5 THEN total - male END AS female FROM (
    SELECT CAST(o_custkey AS VARCHAR) AS demo_id, CAST(count(l_orderkey) AS DOUBLE) AS total,
           CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS male
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY o_custkey)),
sectors AS (
  SELECT sector_id, count(*) AS n_features, min(sector_name) AS sector_name, min(mun_id) AS mun_id,
         min(situation) AS situation, min(v0001) AS v0001
  FROM features WHERE sector_id IS NOT NULL GROUP BY sector_id),
origins AS (
  SELECT s.*, demo_id,
         CASE WHEN demo_id IS NULL THEN 'left_only' ELSE 'both' END AS _merge,
         CASE WHEN demo_id IS NULL THEN 0 ELSE total END AS total_population,
         CASE WHEN demo_id IS NULL THEN 0 ELSE male END AS male,
         CASE WHEN demo_id IS NULL THEN 0 ELSE female END AS female_population,
         CASE WHEN demo_id IS NULL THEN 'zero_population_not_in_demography'
              WHEN female IS NULL THEN 'female_population_unavailable' ELSE 'observed' END AS population_data_status
  FROM sectors s LEFT JOIN demo d ON s.sector_id = d.demo_id)
"""
ORIGIN_COLUMNS = (
    "sector_id, mun_id, sector_name, situation, v0001, n_features, total_population, male, female_population, "
    "population_data_status"
)


def origins(spark: SparkSession, folder: str) -> DataFrame:
    return label_sectors(group_sectors(features(spark, folder), NAMES), demography(spark, folder), NAMES)


@query("census_origins", CENSUS_SQL + f"SELECT {ORIGIN_COLUMNS} FROM origins")
def census_origins(spark, folder):
    return origins(spark, folder).select(*ORIGIN_COLUMNS.split(", "))


@query("census_job", CENSUS_SQL + f"SELECT {ORIGIN_COLUMNS} FROM origins")
def census_job(spark, folder):
    """The whole job with its checks, intermediate tables and sinks, from a delimited demography file."""
    out = work_dir(spark, "census-job")
    demography(spark, folder).write.csv(f"{out}/demography", sep=";", header=True)
    run_census_origins(spark, features(spark, folder), f"{out}/demography", f"{out}/result", NAMES, state_code="")
    rows = spark.read.parquet(f"{out}/result/origins").withColumn("mun_id", F.col("mun_id").cast("string"))
    return rows.select(*ORIGIN_COLUMNS.split(", "))


@query("census_published", CENSUS_SQL + f"SELECT {ORIGIN_COLUMNS} FROM origins")
def census_published(spark, folder):
    """The job published as a unit, started twice under one id, and read by the manifest."""
    out = work_dir(spark, "census-published")
    demography(spark, folder).write.csv(f"{out}/demography", sep=";", header=True)
    job = (spark, features(spark, folder), f"{out}/demography", f"{out}/result", "first", NAMES, "")
    if not publish_census_origins(*job) or publish_census_origins(*job):
        raise RuntimeError("a run is published once")
    rows = spark.read.parquet(published_path(spark, f"{out}/result", "origins")).withColumn("mun_id", F.col("mun_id").cast("string"))
    return rows.select(*ORIGIN_COLUMNS.split(", "))


RULES_SQL = """
SELECT 'demography has rows' AS rule, CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS violations FROM demo
UNION ALL SELECT 'demography keys are unique', count(*) FROM (SELECT demo_id FROM demo GROUP BY demo_id HAVING count(*) > 1)
UNION ALL SELECT 'total = male + female', count(*) FROM demo WHERE total <> male + female
UNION ALL SELECT 'features of a sector agree', count(*) FROM (
  SELECT sector_id FROM features GROUP BY sector_id HAVING count(DISTINCT sector_name) + count(DISTINCT mun_id)
    + count(DISTINCT situation) + count(DISTINCT v0001) > 4)
UNION ALL SELECT 'sectors without demography have basic population 0', count(*) FROM (
  SELECT s.v0001 FROM sectors s LEFT JOIN demo d ON s.sector_id = d.demo_id WHERE d.demo_id IS NULL)
  WHERE v0001 IS NULL OR v0001 <> 0
"""


@query("expectations", CENSUS_SQL + RULES_SQL)
def all_expectations(spark, folder):
    return census_checks(features(spark, folder), demography(spark, folder), NAMES)


# The same rules where they do not hold: the order status as an attribute differs between the parts
# of a sector, a null stands for 0 basic population, and the total is off by one for small sectors.
BROKEN_SQL = (
    CENSUS_SQL.replace("CAST(b.v0001 AS DOUBLE) AS v0001", "nullif(CAST(b.v0001 AS DOUBLE), 0) AS v0001")
    .replace("c.c_mktsegment AS situation", "o.o_orderstatus AS situation")
    .replace("SELECT demo_id, total, male,", "SELECT demo_id, CASE WHEN total < 9 THEN total + 1 ELSE total END AS total, male,")
)


@query(
    "expectations_broken",
    BROKEN_SQL + RULES_SQL.replace("+ count(DISTINCT v0001) > 4", "+ count(DISTINCT coalesce(v0001, -1)) > 4"),
)
def broken_expectations(spark, folder):
    people = demography(spark, folder).withColumn(
        "total", F.when(F.col("total") < 9, F.col("total") + 1).otherwise(F.col("total"))
    )
    status = table(spark, folder, "orders").select(F.col("o_orderkey").alias("part_id"), "o_orderstatus")
    parts = (
        features(spark, folder)
        .join(status, "part_id")
        .withColumns({"situation": F.col("o_orderstatus"), "v0001": F.nullif(F.col("v0001"), F.lit(0.0))})
        .drop("o_orderstatus")
    )
    return census_checks(parts, people, NAMES)


@query(
    "attribute_conflicts",
    """
SELECT attribute, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS conflicting_keys FROM (
  SELECT 'l_returnflag' AS attribute, l_orderkey, count(DISTINCT coalesce(v, '')) AS n
  FROM (SELECT l_orderkey, nullif(l_returnflag, 'R') AS v FROM lineitem) GROUP BY l_orderkey
  UNION ALL SELECT 'l_linestatus', l_orderkey, count(DISTINCT coalesce(l_linestatus, '')) FROM lineitem GROUP BY l_orderkey
  UNION ALL SELECT 'l_quantity', l_orderkey, count(DISTINCT coalesce(l_quantity, -1)) FROM lineitem GROUP BY l_orderkey
  UNION ALL SELECT 'l_suppkey', l_orderkey, count(DISTINCT coalesce(l_suppkey, -1)) FROM lineitem GROUP BY l_orderkey
  UNION ALL SELECT 'tags', l_orderkey,
    count(DISTINCT CASE WHEN l_linenumber = 7 THEN 'none' ELSE l_returnflag || l_linestatus END) FROM lineitem GROUP BY l_orderkey
  UNION ALL SELECT 'nested', l_orderkey, count(DISTINCT l_suppkey % 3) FROM lineitem GROUP BY l_orderkey)
GROUP BY attribute
""",
)
def conflicts(spark, folder):
    """Also of a map whose entries stand in either order, and of a list in a struct where NaN stands for null."""
    even = F.col("l_linenumber") % 2 == 0
    flag, status = (F.lit("flag"), F.col("l_returnflag")), (F.lit("status"), F.col("l_linestatus"))
    tags = F.when(even, F.create_map(*flag, *status)).otherwise(F.create_map(*status, *flag))
    gap = F.when(even, F.lit(float("nan")))
    lines = table(spark, folder, "lineitem").withColumns(
        {
            "tags": F.when(F.col("l_linenumber") != 7, tags),
            "nested": F.struct(F.array(gap, F.col("l_suppkey") % 3 + F.lit(0.0)).alias("list")),
            "l_returnflag": F.nullif(F.col("l_returnflag"), F.lit("R")),
        }
    )
    return attribute_conflicts(lines, "l_orderkey", ["l_returnflag", "l_linestatus", "l_quantity", "l_suppkey", "tags", "nested"])


@query(
    "dissolve_sectors",
    CENSUS_SQL + "SELECT sector_id, n_features, sector_name, mun_id, situation, v0001 FROM sectors",
)
def sectors(spark, folder):
    return dissolve_sectors(features(spark, folder), "sector_id", ["sector_name", "mun_id", "situation", "v0001"])


@query(
    "dissolve_parts",
    """
SELECT DISTINCT doc_id, lang, part FROM (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS part FROM documents)
""",
)
def parts(spark, folder):
    """Parts are the lines of a document, of which many repeat."""
    lines = table(spark, folder, "documents").select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("part"))
    lines = lines.withColumn("part", F.col("part").cast("binary"))
    return dissolve_parts(lines, "doc_id", "part", ["lang"]).withColumn("part", F.col("part").cast("string"))


@query(
    "multipart_stats",
    """
SELECT CAST(sum(n) AS BIGINT) AS features, count(k) AS unique_keys, CAST(sum(n) - count(k) AS BIGINT) AS surplus_features,
       count(*) FILTER (WHERE k IS NOT NULL AND n > 1) AS multipart_keys,
       CAST(max(n) FILTER (WHERE k IS NOT NULL) AS BIGINT) AS max_parts
FROM (SELECT nullif(o_custkey, 7) AS k, count(*) AS n FROM orders GROUP BY 1)
""",
)
def stats(spark, folder):
    return multipart_stats(table(spark, folder, "orders").select(F.nullif(F.col("o_custkey"), F.lit(7)).alias("k")), "k")


DOCUMENT_LABELS_SQL = """
WITH joined AS (
  SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS _merge,
         nullif(quality, 0) AS quality, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id")
    labels = table(spark, folder, "labels").withColumn("quality", F.nullif(F.col("quality"), F.lit(0)))
    return validated_left_join(documents, labels, "doc_id", "doc_id")


@query("validated_left_join", DOCUMENT_LABELS_SQL + "SELECT doc_id, _merge, quality, toxic FROM joined")
def left_join(spark, folder):
    return labelled(spark, folder).select("doc_id", "_merge", "quality", "toxic")


@query(
    "validated_join_refused",
    """
SELECT side || ' key k is not unique' AS refused FROM (
  SELECT 'left' AS side, count(*) AS n, count(DISTINCT l_orderkey) AS k FROM lineitem
  UNION ALL SELECT 'right', count(*), count(DISTINCT o_custkey) FROM orders
  UNION ALL SELECT 'none', count(*), count(DISTINCT o_orderkey) FROM orders) WHERE n > k
""",
)
def refused(spark, folder):
    """One row per join that fails for a repeated key: lines or customers of orders against orders, and orders against themselves."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    once = orders.select(F.col("o_orderkey").alias("k"))
    pairs = {
        "left": (lines.select(F.col("l_orderkey").alias("k")), once),
        "right": (once, orders.select(F.col("o_custkey").alias("k"))),
        "none": (once, once),
    }
    found = []
    for left, right in pairs.values():
        try:
            validated_left_join(left, right, "k", "k").write.format("noop").mode("overwrite").save()
        except SparkRuntimeException as error:
            found.append((re.search(r"(\w+ key k is not unique)", str(error)).group(1),))
    return spark.createDataFrame(found, "refused STRING")


@query(
    "right_only",
    "SELECT count(*) AS demography_only FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)
def left_out(spark, folder):
    closed = table(spark, folder, "orders").filter("o_orderstatus = 'F'")
    return right_only(closed, table(spark, folder, "lineitem"), "o_orderkey", "l_orderkey")


@query(
    "status_label",
    DOCUMENT_LABELS_SQL
    + """
SELECT doc_id, quality AS female_population, toxic AS total_population,
       CASE WHEN _merge = 'left_only' THEN 'zero_population_not_in_demography'
            WHEN quality IS NULL THEN 'female_population_unavailable' ELSE 'observed' END AS population_data_status
FROM joined
""",
)
def statuses(spark, folder):
    return labelled(spark, folder).select(
        "doc_id",
        F.col("quality").alias("female_population"),
        F.col("toxic").alias("total_population"),
        status_label(F.col("_merge"), F.col("quality")).alias("population_data_status"),
    )


@query(
    "zero_fill",
    DOCUMENT_LABELS_SQL
    + "SELECT doc_id, CASE WHEN _merge = 'left_only' THEN 0 ELSE quality END AS quality, toxic FROM joined",
)
def filled(spark, folder):
    return zero_fill(labelled(spark, folder), F.col("_merge"), ["quality"]).select("doc_id", "quality", "toxic")


@query(
    "origins_audit",
    CENSUS_SQL
    + """
SELECT (SELECT count(*) FROM features) AS source_features,
       (SELECT count(DISTINCT sector_id) FROM features) AS unique_geometry_sectors,
       (SELECT count(*) - count(DISTINCT sector_id) FROM features) AS multipart_extra_features,
       count(*) AS output_sectors, count(DISTINCT mun_id) AS municipalities,
       count(*) FILTER (WHERE population_data_status = 'zero_population_not_in_demography')
         AS geometry_only_zero_population_sectors,
       count(*) FILTER (WHERE population_data_status = 'female_population_unavailable')
         AS female_population_unavailable_sectors,
       CAST(sum(female_population) AS BIGINT) AS female_population_observed
FROM origins
""",
)
def audit(spark, folder):
    """The features' figures are counted as the sectors are written; the origins' come from the join that reads them."""
    grouped, counted = write_grouped(features(spark, folder), NAMES)
    counted.pop("conflicts")
    return origins_audit(counted, label_sectors(grouped, demography(spark, folder), NAMES), "mun_id")


@query("origins_sink", CENSUS_SQL + f"SELECT {ORIGIN_COLUMNS} FROM origins")
def origins_sink(spark, folder):
    """Written partitioned by municipality and read back."""
    path = work_dir(spark, "origins-sink")
    write_origins(origins(spark, folder), path, "mun_id")
    return spark.read.parquet(path).select(
        *[F.col(c).cast("string") if c == "mun_id" else F.col(c) for c in ORIGIN_COLUMNS.split(", ")]
    )


@query("summary_projection", CENSUS_SQL + f"SELECT {', '.join(NAMES.summary)} FROM origins")
def summary(spark, folder):
    """Written as CSV and read back."""
    path = work_dir(spark, "summary")
    write_summary(drop_if_present(origins(spark, folder), "part_id"), path, NAMES.summary)
    numbers = ("total_population", "male", "female_population")
    rows = scan_delimited(spark, path, NAMES.summary, sep=",")
    return rows.withColumns({name: coerce_numeric(F.col(name)) for name in numbers})


@query(
    "provenance_record",
    "SELECT 'customers' AS source, 'harness://customer' AS endpoint, count(*) AS record_count, '1' AS level, 'Saldo' AS label FROM customer",
)
def provenance(spark, folder):
    out = work_dir(spark, "provenance")
    write_with_provenance(
        table(spark, folder, "customer"), f"{out}/table", f"{out}/log", "customers", "harness://customer",
        {"level": 1}, {"c_acctbal": "Saldo"},
    )
    schema = "source STRING, endpoint STRING, record_count BIGINT, parameters MAP<STRING, STRING>, column_labels MAP<STRING, STRING>"
    return spark.read.schema(schema).json(f"{out}/log").select(
        "source", "endpoint", "record_count",
        F.col("parameters")["level"].alias("level"), F.col("column_labels")["c_acctbal"].alias("label"),
    )


@query(
    "csv_scan",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer",
)
def csv_scan(spark, folder):
    """The table written as ;-separated text of two column orders, one with further columns; three columns are read back."""
    path, rows = work_dir(spark, "csv"), table(spark, folder, "customer")
    odd = F.col("c_nationkey") % 2 == 1
    rows.filter(odd).write.csv(f"{path}/a", sep=";", header=True, encoding="UTF-8")
    rows.filter(~odd).select("c_mktsegment", "c_acctbal", "c_name", "c_custkey").write.csv(f"{path}/b", sep=";", header=True, encoding="UTF-8")
    return scan_delimited(spark, [f"{path}/a", f"{path}/b"], ["c_custkey", "c_name", "c_mktsegment"])


@query("prefix_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%'")
def prefix(spark, folder):
    urgent = prefix_filter(table(spark, folder, "orders"), "o_orderpriority", "1")
    return urgent.select("o_orderkey", "o_orderpriority")


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicates(spark, folder):
    return duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


# n_chars = dark + blanks, except that the total of German texts is one too high.
SPLIT_SQL = """
WITH counted AS (
  SELECT doc_id, lang, CASE WHEN lang = 'de' THEN n_chars + 1 ELSE n_chars END AS n_chars,
         length(replace(text, ' ', '')) AS dark, nullif(length(text) - length(replace(text, ' ', '')), 0) AS blanks
  FROM documents)
"""


def counted(spark: SparkSession, folder: str) -> DataFrame:
    dark = F.length(F.replace("text", F.lit(" "), F.lit("")))
    return table(spark, folder, "documents").select(
        "doc_id",
        "lang",
        F.when(F.col("lang") == "de", F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"),
        dark.alias("dark"),
        F.nullif(F.length("text") - dark, F.lit(0)).alias("blanks"),
    )


@query(
    "row_identity",
    SPLIT_SQL
    + """
SELECT count(*) FILTER (WHERE blanks IS NOT NULL) AS rows_checked,
       count(*) FILTER (WHERE n_chars <> dark + blanks) AS violations FROM counted
""",
)
def identity(spark, folder):
    return identity_violations(counted(spark, folder), "n_chars", ["dark", "blanks"])


@query(
    "completeness_audit",
    DOCUMENT_LABELS_SQL
    + """
SELECT count(*) AS rows, count(DISTINCT doc_id) AS unique_keys, count(*) FILTER (WHERE toxic IS NULL) AS missing_total,
       count(*) FILTER (WHERE quality IS NULL) AS missing_part, CAST(coalesce(sum(quality), 0) AS BIGINT) AS part_observed
FROM joined
""",
)
def completeness(spark, folder):
    return completeness_audit(labelled(spark, folder), "doc_id", "toxic", "quality")


@query(
    "keyed_profile",
    """
WITH lines AS (SELECT l_orderkey AS k, l_quantity AS total, nullif(l_linenumber, 7) AS male,
                      CASE WHEN l_returnflag <> 'R' THEN l_quantity - l_linenumber END AS female FROM lineitem)
SELECT count(*) AS rows, count(DISTINCT k) AS unique_keys,
       (SELECT count(*) FROM (SELECT k FROM lines GROUP BY k HAVING count(*) > 1)) AS repeated_keys,
       count(*) FILTER (WHERE total <> male + female) AS identity_violations,
       count(*) FILTER (WHERE total IS NULL) AS missing_total, count(*) FILTER (WHERE female IS NULL) AS missing_part,
       CAST(sum(female) AS BIGINT) AS part_observed
FROM lines
""",
)
def profile(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_quantity").alias("total"),
        F.nullif(F.col("l_linenumber"), F.lit(7)).alias("male"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity") - F.col("l_linenumber")).alias("female"),
    )
    return keyed_profile(lines, "k", "total", ["male", "female"], "female")
