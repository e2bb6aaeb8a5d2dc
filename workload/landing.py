"""Landed files, fetch logs and status tables, derived from documents and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.operators.joins import checksum_join
from ribeira.operators.landing import (
    accepted,
    archive_inventory,
    availability,
    error_log,
    error_rows,
    fetch_errors,
    inspect_files,
    landed_file_check,
    landing_accept,
    overall_status,
    probe_catalog,
    probe_outcomes,
    probe_status,
    settle_attempts,
    source_status,
)
from ribeira.session import work_dir
from ribeira.sources.files import content_parts, file_digests
from workload.registry import query, table

# What a document lands as: an archive of its lines, and besides, by its length, text that only claims to be one, JSON,
# broken JSON, an empty file or plain text.
LANDED_FORM = """CASE n_chars % 5 WHEN 0 THEN 'text.zip' WHEN 1 THEN 'good.json' WHEN 2 THEN 'bad.geojson'
  WHEN 3 THEN 'empty.zip' ELSE 'text.csv' END"""
LANDED_SQL = f"""
WITH landed AS (SELECT doc_id, text, form, 'landed/' || source || '/' || doc_id || '/' || form AS path
  FROM (SELECT *, unnest(['archive.zip', {LANDED_FORM}]) AS form FROM documents))
"""


def forms() -> Column:
    return F.explode(F.array(F.lit("archive.zip"), F.expr(LANDED_FORM))).alias("form")


def packed(files: DataFrame) -> DataFrame:
    """Files with their ``length``; where ``pack`` is set, the content becomes an archive of its lines. Other columns stay.

    A batch of rows is packed and given on part by part, so that a worker holds little besides the batch it was sent.
    """
    cut = content_parts()
    others = [field for field in files.schema if field.name not in ("pack", "content")]

    def pack_lines(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in cut(batches):
            contents = []
            for pack, content in zip(batch.column("pack").to_pylist(), batch.column("content").to_pylist()):
                if pack:
                    data = io.BytesIO()
                    with zipfile.ZipFile(data, "w") as archive:
                        for i, line in enumerate(content.split(b"\n")):
                            archive.writestr(f"line_{i}.txt", line)
                    content = data.getvalue()
                contents.append(content)
            lengths = [len(content) for content in contents]
            columns = [batch.column(field.name) for field in others]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lengths, pa.int64()), pa.array(contents, pa.binary())],
                names=[*(field.name for field in others), "length", "content"],
            )

    ddl = "".join(f"{field.name} {field.dataType.simpleString()}, " for field in others)
    return files.mapInArrow(pack_lines, ddl + "length BIGINT, content BINARY")


def landed(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("*", forms())
    content = (
        F.when(F.col("form") == "good.json", F.to_json(F.struct("doc_id", "text")))
        .when(F.col("form") == "bad.geojson", F.concat(F.lit("{"), "text"))
        .when(F.col("form") == "empty.zip", "")
        .otherwise(F.col("text"))
    )
    rows = documents.select(
        F.concat_ws("/", F.lit("landed"), "source", "doc_id", "form").alias("path"),
        (F.col("form") == "archive.zip").alias("pack"),
        content.cast("binary").alias("content"),
    )
    return packed(rows).select("path", "length", "content")


@query(
    "archive_inventory",
    LANDED_SQL
    + """
SELECT path, CAST(pos AS INTEGER) AS pos, 'line_' || pos || '.txt' AS member FROM (
  SELECT path, unnest(range(length(text) - length(replace(text, chr(10), '')) + 1)) AS pos
  FROM landed WHERE form = 'archive.zip')
""",
)
def inventory(spark, folder):
    return archive_inventory(inspect_files(landed(spark, folder)))


@query(
    "landed_file_check",
    LANDED_SQL
    + """
SELECT path, form IN ('archive.zip', 'good.json', 'text.csv') AS ok,
       CASE form WHEN 'text.zip' THEN 'not_a_zip' WHEN 'bad.geojson' THEN 'invalid_json' WHEN 'empty.zip' THEN 'missing_or_empty' END AS reason FROM landed
UNION ALL SELECT DISTINCT 'landed/' || source || '/index.json', false, 'missing_or_empty' FROM documents
""",
)
def checks(spark, folder):
    documents = table(spark, folder, "documents")
    files = documents.select("source", "doc_id", forms()).select(F.concat_ws("/", F.lit("landed"), "source", "doc_id", "form").alias("path"))
    declared = files.union(documents.select(F.concat_ws("/", F.lit("landed"), "source", F.lit("index.json"))))
    return landed_file_check(inspect_files(landed(spark, folder)), declared)


@query(
    "file_digest",
    """
SELECT s_suppkey, strlen(line) + 1 AS bytes, sha256(line || chr(10)) AS sha256
FROM (SELECT s_suppkey, s_name || ';' || s_nationkey || ';' || s_suppkey AS line FROM supplier)
""",
)
def digests(spark, folder):
    """Each supplier is written to a file of its own, and the files are scanned. One that lacks a part of its line has no file.

    Every task has one folder for all its files, which is renamed as a whole when the job commits; folders are listed in parallel.
    """
    path = work_dir(spark, "suppliers")
    line = F.concat("s_name", F.lit(";"), "s_nationkey", F.lit(";"), "s_suppkey")
    rows = table(spark, folder, "supplier").select("s_suppkey", line.alias("value"))
    folders = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.filter("value IS NOT NULL").select("value", F.pmod(F.xxhash64("s_suppkey"), F.lit(folders)).alias("folder"))
    dealt.repartition(folders, "folder").write.partitionBy("folder").option("maxRecordsPerFile", 1).text(path)
    key = F.regexp_extract(F.col("content").cast("string"), ";(-?[0-9]+)\n$", 1).cast("bigint").alias("s_suppkey")
    found = file_digests(spark, path, "part-*", key).drop("path")
    absent = rows.filter("value IS NULL").select("s_suppkey", F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("sha256"))
    return found.select("s_suppkey", "bytes", "sha256").union(absent)


# A fetch of every document: type by language, extension by length. Each URL is tried twice, and
# the first try reports a size over the limit for texts that mention no full stop.
FETCH_EXTENSION = "CASE n_chars % 4 WHEN 0 THEN '.zip' WHEN 1 THEN '.bin' WHEN 2 THEN '/ows?outputFormat=csv' ELSE '.json' END"
MAX_BYTES = 20000
FETCH_SQL = f"""
WITH expected AS (
  SELECT l.doc_id, CASE WHEN quality = 1 THEN sha256(text) ELSE sha256(lang) END AS expected_sha256
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
tries AS (
  SELECT *, 'https://' || source || '.example/' || doc_id || {FETCH_EXTENSION} AS url FROM documents, (VALUES (1), (2)) t(attempt)),
judged AS (
  SELECT CAST(t.doc_id AS VARCHAR) AS source_id, url, attempt, n_chars AS bytes,
    CASE WHEN lang = 'de' THEN 'html_response'
      WHEN n_chars % 4 = 1 THEN 'no_data_extension'
      WHEN attempt = 1 AND NOT contains(text, '.') THEN 'declared_size_over_limit'
      WHEN n_chars > {MAX_BYTES} THEN 'size_over_limit'
      WHEN n_chars = 0 THEN 'missing_or_empty'
      WHEN expected_sha256 IS NOT NULL AND expected_sha256 <> sha256(text) THEN 'checksum_mismatch' END AS reject_reason
  FROM tries t LEFT JOIN expected e ON t.doc_id = e.doc_id)
"""


def fetch_log(spark: SparkSession, folder: str) -> DataFrame:
    url = F.concat(F.lit("https://"), "source", F.lit(".example/"), "doc_id", F.expr(FETCH_EXTENSION))
    documents = table(spark, folder, "documents").withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    oversized = (F.col("attempt") == 1) & ~F.contains(F.col("text"), F.lit("."))
    return documents.select(
        F.col("doc_id").cast("string").alias("source_id"),
        url.alias("url"),
        url.alias("resolved_url"),
        F.when(F.col("lang") == "de", "Text/HTML; charset=utf-8").otherwise("application/zip").alias("content_type"),
        F.when(oversized, MAX_BYTES + 1).alias("content_length"),
        F.col("n_chars").alias("bytes"),
        F.sha2("text", 256).alias("sha256"),
        "attempt",
    )


def expected(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    documents = table(spark, folder, "documents").select("doc_id", "lang", "text")
    digest = F.when(F.col("quality") == 1, F.sha2("text", 256)).otherwise(F.sha2("lang", 256))
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").cast("string").alias("source_id"), digest.alias("expected_sha256")
    )


def judged(spark: SparkSession, folder: str) -> DataFrame:
    return landing_accept(fetch_log(spark, folder), expected(spark, folder), MAX_BYTES)


@query("landing_accept", FETCH_SQL + "SELECT source_id, url, attempt, bytes, reject_reason FROM judged")
def acceptance(spark, folder):
    return judged(spark, folder).select("source_id", "url", "attempt", "bytes", "reject_reason")


@query(
    "landing_accepted",
    FETCH_SQL + "SELECT source_id, url, min(attempt) AS attempt, min(bytes) AS bytes FROM judged WHERE reject_reason IS NULL GROUP BY 1, 2",
)
def landed_once(spark, folder):
    return accepted(settle_attempts(judged(spark, folder))).select("source_id", "url", "attempt", "bytes")


@query(
    "error_log",
    FETCH_SQL
    + """
SELECT source_id, 'download' AS stage, url, CAST(NULL AS VARCHAR) AS path, 'rejected' AS type,
       arg_max(reject_reason, attempt) AS message, 2 AS attempts
FROM judged GROUP BY source_id, url HAVING count(*) FILTER (WHERE reject_reason IS NULL) = 0
UNION ALL SELECT CAST(page_id AS VARCHAR), 'page', url, NULL, 'no_links', 'page has no links', NULL FROM pages
WHERE NOT contains(html, 'href=')
""",
)
def errors(spark, folder):
    bare = table(spark, folder, "pages").filter(~F.contains(F.col("html"), F.lit("href="))).select(
        F.col("page_id").alias("source_id"), "url", F.lit("no_links").alias("type"), F.lit("page has no links").alias("message")
    )
    return error_log(fetch_errors(settle_attempts(judged(spark, folder))), error_rows(bare, "page"))


@query(
    "checksum_join",
    """
SELECT d.doc_id, CASE WHEN d.lang = 'fr' THEN 'missing' WHEN quality = 1 THEN 'match' ELSE 'mismatch' END AS outcome
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
""",
)
def checksums(spark, folder):
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    digest = F.when(F.col("quality") == 1, F.sha2("text", 256)).otherwise(F.sha2("lang", 256))
    declared = labels.join(documents, "doc_id").select("doc_id", digest.alias("sha256"))
    observed = documents.filter("lang <> 'fr'").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return checksum_join(declared, observed, "doc_id").select("doc_id", "outcome")


STATUS_SQL = """
WITH counted AS (
  SELECT c_custkey AS source_id, count(*) FILTER (WHERE event_type = 'view') AS discovered,
         count(*) FILTER (WHERE event_type = 'purchase' AND value > 50) AS downloaded,
         count(*) FILTER (WHERE event_type = 'signup' AND value > 50) AS preserved,
         count(*) FILTER (WHERE event_type = 'error') AS errors
  FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY c_custkey),
status AS (
  SELECT *, downloaded + preserved AS available,
         CASE WHEN downloaded + preserved > 0 THEN 'success' ELSE 'failed' END AS status FROM counted)
"""


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    sources = table(spark, folder, "customer").select(F.col("c_custkey").alias("source_id"))
    events = table(spark, folder, "events").withColumnRenamed("user_id", "source_id")

    def of(condition: str) -> DataFrame:
        return events.filter(condition)

    return source_status(
        sources,
        of("event_type = 'view'"),
        of("event_type = 'purchase' AND value > 50"),
        of("event_type = 'signup' AND value > 50"),
        of("event_type = 'error'"),
    )


@query("source_status", STATUS_SQL + "SELECT * FROM status")
def per_source(spark, folder):
    return statuses(spark, folder)


@query(
    "overall_status",
    STATUS_SQL
    + """
SELECT count(*) AS sources, count(*) FILTER (WHERE available > 0) AS successful,
       CASE WHEN coalesce(bool_and(available > 0), true) THEN 'complete' ELSE 'partial' END AS status FROM status
""",
)
def overall(spark, folder):
    return overall_status(statuses(spark, folder))


PROBES = "CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 404 WHEN 'signup' THEN 204 ELSE 200 END"


@query(
    "probe_status",
    f"""
SELECT event_id AS source_id, CAST({PROBES} AS INTEGER) AS http_status,
       CASE WHEN event_type = 'error' THEN 'unreachable' WHEN event_type = 'click' THEN 'http_error' ELSE 'available' END AS status
FROM events
""",
)
def probes(spark, folder):
    return probe_status(probe_log(spark, folder))


def probe_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("event_id").alias("source_id"), F.expr(PROBES).alias("http_status"))


CATALOG_SQL = f"""
WITH probed AS (
  SELECT c_custkey AS source_id, c_name AS agency, CASE WHEN event_id IS NOT NULL THEN CAST({PROBES} AS INTEGER) END AS http_status,
         CASE WHEN event_type = 'error' THEN 'timeout' END AS error,
         CASE WHEN event_id IS NULL THEN 'not_probed' WHEN event_type = 'error' THEN 'unreachable' WHEN event_type = 'click' THEN 'http_error'
           ELSE 'available' END AS status
  FROM customer LEFT JOIN events ON c_custkey = user_id)
"""


def catalog_probes(spark: SparkSession, folder: str) -> DataFrame:
    catalog = table(spark, folder, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("agency"))
    log = table(spark, folder, "events").select(
        F.col("user_id").alias("source_id"), F.expr(PROBES).alias("http_status"), F.expr("CASE WHEN event_type = 'error' THEN 'timeout' END").alias("error")
    )
    return probe_catalog(catalog, log)


@query("probe_catalog", CATALOG_SQL + "SELECT * FROM probed")
def probed_catalog(spark, folder):
    return catalog_probes(spark, folder)


@query("probe_outcomes", CATALOG_SQL + "SELECT source_id, status, http_status, error, count(*) AS probes FROM probed GROUP BY 1, 2, 3, 4")
def outcomes(spark, folder):
    return probe_outcomes(catalog_probes(spark, folder))


@query(
    "availability",
    """
SELECT count(*) AS source_count, count(*) FILTER (WHERE event_type NOT IN ('error', 'click')) AS available,
       count(*) FILTER (WHERE event_type IN ('error', 'click')) AS unavailable FROM events
""",
)
def available(spark, folder):
    return availability(probe_log(spark, folder))
