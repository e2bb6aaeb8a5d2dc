"""The discovery job: pages as the web, documents as the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.operators.ledger import merge_entries, merged_status, run_entries
from ribeira.plans.layers import LayerResult, discover_layers
from workload.landing import packed
from workload.links import DIRECT_ONLY, KEYWORDS, RANKED_SQL, SCORED_SQL, SOURCE, TOPK_SQL, page_rows
from workload.registry import query, table

# What became of a ranked link, by the length of its URL: no attempt, a failed transfer, an error status, HTML, an empty
# file, no archive, or a file. Documents are cached for the source named like their language: as an archive of their lines, as
# a table, and as one odd form by their id: hidden from the readers, empty, text that claims to be an archive, or of no accepted kind.
OUTCOME = "length(url) % 7"
ODD_FORM = "CASE doc_id % 4 WHEN 0 THEN '_hidden.zip' WHEN 1 THEN 'empty.zip' WHEN 2 THEN 'text.zip' ELSE 'notes.txt' END"
LAYERS_SQL = f"""
{RANKED_SQL.strip()},
ranked AS ({TOPK_SQL[len(SCORED_SQL):]}),
reasons AS (
  SELECT source_id, url, {OUTCOME} AS o,
         CASE {OUTCOME} WHEN 1 THEN 'transport_error' WHEN 2 THEN 'http_error' WHEN 3 THEN 'html_response' WHEN 4 THEN 'missing_or_empty'
           WHEN 5 THEN 'not_a_zip' END AS reason FROM ranked),
files AS (
  SELECT lang AS source_id, 'cache/' || doc_id || '/' || form AS path,
         CASE form WHEN '_hidden.zip' THEN 'not_read' WHEN 'empty.zip' THEN 'missing_or_empty' WHEN 'text.zip' THEN 'not_a_zip' END AS reason,
         CASE form WHEN 'archive.zip' THEN length(text) - length(replace(text, chr(10), '')) + 1 ELSE 0 END AS members
  FROM (SELECT *, unnest(['archive.zip', 'table.csv', {ODD_FORM}]) AS form FROM documents)
  WHERE form <> 'notes.txt' AND lang <> 'de'),
failed_pages AS (
  SELECT {SOURCE} AS source_id, url, CASE WHEN page_id % 5 = 0 THEN 'reset' ELSE 'HTTP 503' END AS message, page_id
  FROM pages WHERE page_id % 5 < 2 AND {SOURCE} <> 'de')
"""


def run(spark: SparkSession, folder: str) -> LayerResult:
    rows = page_rows(spark, folder)
    first = F.concat(F.lit("https://registered.example/"), "source_id", F.lit("/"), F.min("page_id"), F.lit(".zip"))
    catalog = rows.groupBy("source_id").agg(F.array(first).alias("direct_urls")).withColumns(
        {
            "download_enabled": F.lit(None).cast("boolean"), "direct_urls_only": F.col("source_id").isin(DIRECT_ONLY),
            "expected_sha256": F.lit(None).cast("string"),
        }
    )
    zipped = F.regexp_replace("html", 'href="([^"]+)"', 'href="$1.zip"')
    pages = rows.select("source_id", "url", zipped.alias("html"))
    site = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit("(?i)href=[\"']([^\"']+)[\"']"), F.lit(1)))
    found = rows.select("source_id", site.alias("site"), F.explode(hrefs).alias("href")).select(
        "source_id", F.concat("site", "href", F.lit(".zip")).alias("url")
    )
    urls = found.union(catalog.select("source_id", F.explode("direct_urls"))).distinct()
    outcome = F.expr(OUTCOME)
    log = urls.filter(outcome != 0).select(
        "source_id", "url", F.col("url").alias("resolved_url"),
        F.when(outcome == 3, "text/html").otherwise("application/zip").alias("content_type"),
        F.lit(None).cast("bigint").alias("content_length"), F.when(outcome == 4, 0).otherwise(9).cast("bigint").alias("bytes"),
        F.sha2("url", 256).alias("sha256"), F.lit(1).alias("attempt"), F.when(outcome == 2, 404).otherwise(200).alias("http_status"),
        F.when(outcome == 1, "timed out").alias("error"), F.when(outcome == 5, "not_a_zip").alias("file_reason"),
    )
    documents = table(spark, folder, "documents")
    form = F.explode(F.array(F.lit("archive.zip"), F.lit("table.csv"), F.expr(ODD_FORM))).alias("form")
    files = documents.select("doc_id", "lang", "text", form).select(
        F.col("lang").alias("source_id"), F.concat_ws("/", F.lit("cache"), "doc_id", "form").alias("path"),
        (F.col("form") == "archive.zip").alias("pack"), F.col("text").cast("binary").alias("content"),
    )
    unread = files.path.rlike("/(_hidden|empty)[.]zip$")
    read = packed(files.filter(~unread))
    listed = files.select("source_id", "path", F.when(files.path.endswith("empty.zip"), 0).otherwise(F.octet_length("content")).cast("bigint").alias("length"))
    page_log = rows.select(
        "source_id", "url", F.when(F.col("page_id") % 5 == 1, 503).when(F.col("page_id") % 5 > 1, 200).alias("http_status"),
        F.when(F.col("page_id") % 5 == 0, "reset").alias("error"),
    )
    return discover_layers(pages, catalog, log, read, KEYWORDS, page_log=page_log, listing=listed)


@query(
    "layers_job",
    LAYERS_SQL
    + """
SELECT source_id, 'download' AS stage, url, CAST(NULL AS VARCHAR) AS path, CASE WHEN o = 0 THEN 'no attempt on record' ELSE reason END AS message,
       CAST(NULL AS INTEGER) AS members
FROM reasons WHERE o < 6
UNION ALL SELECT source_id, 'cache_validation', NULL, path, reason, NULL FROM files WHERE reason IS NOT NULL
UNION ALL SELECT source_id, 'page', url, NULL, message, NULL FROM failed_pages
UNION ALL SELECT source_id, 'downloaded', url, source_id || '/' || regexp_replace(regexp_extract(url, '([^/?#]+)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), NULL, NULL FROM reasons WHERE o = 6
UNION ALL SELECT source_id, 'preserved', NULL, path, NULL, CAST(members AS INTEGER) FROM files WHERE reason IS NULL
""",
)
def job(spark, folder) -> DataFrame:
    """All that the job gave account of: errors of the three stages, downloads, and cached files that stay, with their number of members."""
    result = run(spark, folder)
    errors = result.errors.select("source_id", "stage", "url", "path", "message", F.lit(None).cast("int").alias("members"))
    none = F.lit(None).cast("string")
    kept = result.downloads.select("source_id", F.lit("downloaded").alias("stage"), "url", "path", none.alias("message"), F.lit(None).cast("int").alias("members"))
    files = result.preserved.select("source_id", F.lit("preserved").alias("stage"), none.alias("url"), "path", none.alias("message"), F.coalesce(F.array_size("members"), F.lit(0)).alias("members"))
    return errors.union(kept).union(files)


STATUS_SQL = LAYERS_SQL + """
, sources AS (SELECT DISTINCT SOURCE_ID AS source_id FROM (SELECT {0} AS SOURCE_ID FROM pages)),
counted AS (
  SELECT source_id, (SELECT count(*) FROM ranked r WHERE r.source_id = s.source_id) AS discovered,
         (SELECT count(*) FROM reasons r WHERE r.source_id = s.source_id AND o = 6) AS downloaded,
         (SELECT count(*) FROM files f WHERE f.source_id = s.source_id AND reason IS NULL) AS preserved,
         (SELECT count(*) FROM reasons r WHERE r.source_id = s.source_id AND o < 6)
           + (SELECT count(*) FROM files f WHERE f.source_id = s.source_id AND reason IS NOT NULL)
           + (SELECT count(*) FROM failed_pages p WHERE p.source_id = s.source_id) AS errors
  FROM sources s)
SELECT *, downloaded + preserved AS available, CASE WHEN downloaded + preserved > 0 THEN 'success' ELSE 'failed' END AS status FROM counted
""".replace("{0}", SOURCE)


@query("layers_status", STATUS_SQL)
def status(spark, folder) -> DataFrame:
    return run(spark, folder).status


@query("layers_rerun", STATUS_SQL)
def rerun(spark, folder) -> DataFrame:
    """Status over two runs, of which the second finds in the cache what the first has downloaded: the same as that of the first run."""
    result = run(spark, folder)
    landed = result.downloads.select("source_id", F.concat(F.lit("cache/"), "path").alias("path"))
    kept = result.preserved.select("source_id", "path")
    first = run_entries(result.links, result.downloads, kept, result.errors, "1", F.lit("2026-01-01").cast("timestamp"), "cache")
    second = run_entries(result.links, result.downloads.limit(0), kept.union(landed), result.errors, "2", F.lit("2026-01-02").cast("timestamp"), "cache")
    catalog = page_rows(spark, folder).select("source_id").distinct()
    return merged_status(catalog, merge_entries(first, second))
