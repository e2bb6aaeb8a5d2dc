"""Nested JSON: event properties, manifests made of line items, API payloads made of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.plans.statistics import run_statistics_table
from ribeira.session import work_dir
from ribeira.sources.manifest import FLAT_RECORD, flatten_manifest, manifest_sources
from ribeira.sources.payload import payload_normalize, payload_strict
from workload.registry import query, table


@query(
    "json_flatten",
    "SELECT event_id, 'k' AS key, props ->> '$.k' AS value FROM events",
)
def flatten(spark, folder):
    entries = F.from_json("props", "MAP<STRING, STRING>")
    return table(spark, folder, "events").select("event_id", F.explode(entries).alias("key", "value"))


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One manifest text per line item: its supplier as the source, the line as a download.

    The texts come by source, as ``manifest_sources`` reads them best; order and line are sort keys too, so that a large supplier is split.
    """
    path = F.concat_ws("/", F.lit("raw"), "l_orderkey", F.concat("l_linenumber", F.lit(".zip")))
    download = F.struct(
        F.concat(F.lit("https://files.example/"), path).alias("url"),
        path.alias("path"),
        F.col("l_quantity").cast("bigint").alias("bytes"),
        F.sha2(path, 256).alias("sha256"),
        F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda i: F.concat(F.lit("member_"), i)).alias("zip_inventory"),
        F.lit(1).alias("attempt"),
    )
    record = F.struct(
        F.col("l_returnflag").alias("agency"),
        F.lit("registered_direct_urls_only").alias("discovery_policy"),
        F.when(F.col("l_linestatus") == "F", F.array(download)).otherwise(F.array()).alias("downloads"),
    )
    source = F.concat(F.lit("supplier_"), "l_suppkey")
    return table(spark, folder, "lineitem").sort("l_suppkey", "l_orderkey", "l_linenumber").select(
        F.to_json(F.struct(F.lit("2026-01-01").alias("generated_at_utc"), F.create_map(source, record).alias("sources"))).alias("value")
    )


@query(
    "manifest_flatten",
    """
SELECT 'supplier_' || l_suppkey AS source_id, l_returnflag AS agency, 'registered_direct_urls_only' AS discovery_policy,
       CASE WHEN f THEN 'https://files.example/' || p END AS url, CASE WHEN f THEN p END AS path,
       CASE WHEN f THEN CAST(l_quantity AS BIGINT) END AS bytes, CASE WHEN f THEN sha256(p) END AS sha256,
       CASE WHEN f THEN l_linenumber ELSE 0 END AS members
FROM (SELECT *, l_linestatus = 'F' AS f, 'raw/' || l_orderkey || '/' || l_linenumber || '.zip' AS p FROM lineitem)
""",
)
def manifest(spark, folder):
    return flatten_manifest(manifest_sources(manifests(spark, folder), FLAT_RECORD))


def payloads(spark: SparkSession, folder: str, header: dict[str, str]) -> DataFrame:
    """One payload per hundred customers: a header element and then at most that many rows."""

    def entries(values: dict) -> F.Column:
        return F.create_map(*[c for name, value in values.items() for c in (F.lit(name), value)])

    row = entries(
        {
            "D1C": F.col("c_custkey").cast("string"),
            "D1N": F.col("c_name"),
            "V": F.col("c_nationkey").cast("string"),
            "M": F.col("c_mktsegment"),
        }
    )
    grouped = table(spark, folder, "customer").groupBy(F.expr("c_custkey DIV 100")).agg(F.collect_list(row).alias("rows"))
    head = F.array(entries({code: F.lit(label) for code, label in header.items()}))
    return grouped.select(F.to_json(F.concat(head, "rows")).alias("value"))


@query(
    "payload_normalize",
    """
SELECT CAST(c_custkey AS VARCHAR) AS codigo_do_municipio, c_name AS valor, CAST(c_nationkey AS VARCHAR) AS valor_2,
       c_mktsegment AS m FROM customer
""",
)
def normalize(spark, folder):
    header = {"D1C": "Código do Município", "D1N": "Valor", "V": "(Valor)", "M": "***", "Z": "Nota"}
    return payload_normalize(payloads(spark, folder, header))[0]


@query(
    "payload_strict",
    """
SELECT CAST(c_custkey AS VARCHAR) AS "Código", c_name AS "Nome", CAST(c_nationkey AS VARCHAR) AS "Valor (R$)",
       c_mktsegment AS "M" FROM customer
""",
)
def strict(spark, folder):
    return payload_strict(payloads(spark, folder, {"D1C": "Código", "D1N": "Nome", "V": "Valor (R$)"}))


@query(
    "statistics_job",
    """
SELECT CAST(c_custkey AS VARCHAR) AS codigo_do_municipio, c_name AS valor, CAST(c_nationkey AS VARCHAR) AS valor_2,
       c_mktsegment AS m, (SELECT count(*) FROM customer) AS record_count FROM customer
""",
)
def statistics(spark, folder):
    """Payload files, one per hundred customers, landed, read, normalized and written with their record."""
    header = {"D1C": "Código do Município", "D1N": "Valor", "V": "(Valor)", "M": "***", "Z": "Nota"}
    landed, out = work_dir(spark, "payloads"), work_dir(spark, "statistics")
    payloads(spark, folder, header).write.option("maxRecordsPerFile", 1).text(landed)
    record = run_statistics_table(spark, landed, out, "statistics office", "https://api.example/t", {"table": 1})
    counted = spark.read.parquet(f"{out}/table")
    return counted.withColumn("record_count", F.lit(record.first()["record_count"]).cast("bigint"))
