"""Link operators over the pages table.

A page's source is the language in its path, so one source holds more than half of all pages. The
links of the pages are bare words; query strings, formats and extensions are put on by their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.functions.urls import resolve_link
from ribeira.operators.filters import eligible_sources
from ribeira.operators.keywords import keyword_join
from ribeira.operators.links import allowlist_semi, extract_links, link_score, links_union, topk_links
from ribeira.operators.url_parts import is_candidate, split_url, with_file_name
from ribeira.plans.layers import rank_links
from workload.registry import query, table

SOURCE = "regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1)"
DIRECT_ONLY = ["de"]
KEYWORDS = {
    "en": ["the", "tion", "er", "zip"],
    "fr": ["eau", "ment", "geojson"],
    "es": ["ado", "ci", "zip"],
    "de": ["sch", "er", "zip"],
}
DECORATION = """CASE length(link) % 6 WHEN 0 THEN '.zip' WHEN 1 THEN '.csv?v=2'
  WHEN 2 THEN '?service=WFS&request=GetFeature&outputFormat=SHAPE-ZIP' WHEN 3 THEN '.kml#part'
  WHEN 4 THEN '/ows?OUTPUTFORMAT=&outputFormat=application%2Fgeo%2Bjson' ELSE '.gov.br.geojson' END"""


def page_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").withColumn("source_id", F.expr(SOURCE))


def decorated(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, page_id, url): every link of every page, completed."""
    links = extract_links(page_rows(spark, folder))
    return links.select("source_id", "page_id", F.concat("link", F.expr(DECORATION)).alias("url"))


FOUND_SQL = f"""
WITH raw AS (
  SELECT page_id, url AS page_url, {SOURCE} AS source_id, regexp_extract(url, '^[a-z]+://[^/]+') AS site,
         unnest(list_distinct(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1))) AS href FROM pages),
found AS (SELECT page_id, page_url, source_id, site || href AS link FROM raw),
links AS (SELECT source_id, page_id, link || {DECORATION} AS url FROM found)
"""
PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
EXTENSION_SQL = r"'\.(zip|csv|json|geojson|kml|kmz|gpkg|shp)$'"
FORMAT_SQL = """CASE WHEN contains(url, 'outputFormat=SHAPE-ZIP') THEN '.zip'
  WHEN contains(url, 'outputFormat=application%2Fgeo%2Bjson') THEN '.geojson' END"""
CANDIDATE_SQL = f"(NOT contains(url, '#') AND (regexp_matches(lower({PATH_SQL}), {EXTENSION_SQL}) OR {FORMAT_SQL} IS NOT NULL))"


@query("extract_links", FOUND_SQL + "SELECT page_id, page_url AS url, source_id, link FROM found")
def found(spark, folder):
    return extract_links(page_rows(spark, folder))


@query(
    "resolve_links",
    FOUND_SQL
    + """
, parts AS (
  SELECT page_id, href, site, site || regexp_extract(page_url, '^[a-z]+://[^/?#]*(/[^?#]*/)', 1) AS folder,
         substr(href, 2) AS rest, length(href) % 5 AS form FROM raw JOIN (SELECT page_id AS p, url AS u FROM pages) ON page_id = p)
SELECT page_id, href, CASE form WHEN 0 THEN site || href WHEN 1 THEN folder || rest
    WHEN 2 THEN regexp_replace(folder, '[^/]*/$', '') || rest
    WHEN 3 THEN regexp_extract(folder, '^[a-z]+:') || '//other.example' || href
    ELSE 'ftp://other.example/' || rest END AS link FROM parts
""",
)
def resolved(spark, folder):
    """The same links written in five ways: rooted, relative, one folder up, by host, and absolute."""
    form = """CASE length(href) % 5 WHEN 0 THEN href WHEN 1 THEN concat('./', substr(href, 2))
      WHEN 2 THEN concat('../', substr(href, 2)) WHEN 3 THEN concat('//other.example', href)
      ELSE concat('ftp://other.example', href) END"""
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1)))
    rows = table(spark, folder, "pages").select("page_id", "url", F.explode(hrefs).alias("href"))
    return rows.select("page_id", "href", resolve_link(F.col("url"), F.expr(form)).alias("link"))


@query("url_output_format", FOUND_SQL + f"SELECT page_id, url, {FORMAT_SQL} AS extension FROM links")
def formats(spark, folder):
    return split_url(decorated(spark, folder)).select("page_id", "url", "url_parts.extension")


@query("url_candidate", FOUND_SQL + f"SELECT page_id, url, {CANDIDATE_SQL} AS candidate FROM links")
def candidates(spark, folder):
    return split_url(decorated(spark, folder)).select("page_id", "url", is_candidate().alias("candidate"))


@query(
    "safe_filename",
    FOUND_SQL
    + f"""
, named AS (SELECT page_id, url, {FORMAT_SQL} AS extension,
            regexp_extract({PATH_SQL}, '([^/]+)/*$', 1) AS name FROM links)
SELECT page_id, url, regexp_replace(CASE
    WHEN extension IS NOT NULL AND NOT regexp_matches(lower(coalesce(name, '')), {EXTENSION_SQL}) THEN 'page_' || page_id || extension
    ELSE name END, '[^A-Za-z0-9._-]+', '_', 'g') AS file_name FROM named
""",
)
def file_names(spark, folder):
    fallback = F.concat(F.lit("page_"), F.col("page_id"))
    return with_file_name(decorated(spark, folder), "file_name", fallback).select("page_id", "url", "file_name")


@query(
    "catalog_eligible",
    """
SELECT s_name AS source_id FROM supplier
WHERE s_suppkey <> 0 AND coalesce(CASE s_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END, true)
""",
)
def eligible(spark, folder):
    catalog = table(spark, folder, "supplier").select(
        F.col("s_name").alias("source_id"),
        F.when(F.col("s_nationkey") % 3 == 0, True).when(F.col("s_nationkey") % 3 == 1, False).alias("download_enabled"),
    )
    return eligible_sources(catalog, "Supplier#000000000").select("source_id")


UNION_SQL = FOUND_SQL + """
, registered AS (SELECT DISTINCT source_id, page_url || '/data.zip' AS url FROM raw),
united AS (SELECT source_id, url FROM links WHERE source_id <> 'de' UNION SELECT source_id, url FROM registered)
"""


def registered(spark: SparkSession, folder: str) -> DataFrame:
    rows = page_rows(spark, folder)
    return rows.filter(F.regexp_count("html", F.lit(r"""(?i)href=["'][^"']+["']""")) > 0).select(
        "source_id", F.concat("url", F.lit("/data.zip")).alias("url")
    )


def united(spark: SparkSession, folder: str) -> DataFrame:
    catalog = page_rows(spark, folder).select("source_id").distinct()
    catalog = catalog.withColumn("direct_urls_only", F.when(F.col("source_id").isin(DIRECT_ONLY), True))
    return links_union(decorated(spark, folder), registered(spark, folder), catalog)


@query("links_union", UNION_SQL + "SELECT source_id, url FROM united")
def union(spark, folder):
    return united(spark, folder)


SCORED_SQL = UNION_SQL + f"""
, terms(source_id, term) AS (VALUES {", ".join(f"('{s}', '{t}')" for s, ts in KEYWORDS.items() for t in ts)}),
scored AS (
  SELECT u.source_id, u.url, CAST(3 * count(term)
    + CASE WHEN regexp_matches(lower(u.url), {EXTENSION_SQL}) THEN 5 ELSE 0 END
    + CASE WHEN {FORMAT_SQL.replace("url", "u.url")} IS NOT NULL THEN 8 ELSE 0 END
    + CASE WHEN contains(lower(u.url), 'request=getfeature') THEN 4 ELSE 0 END
    + CASE WHEN contains(lower(u.url), 'gov.br') THEN 2 ELSE 0 END AS INTEGER) AS score
  FROM united u LEFT JOIN terms t ON u.source_id = t.source_id AND contains(lower(u.url), term) GROUP BY u.source_id, u.url)
"""
TOPK_SQL = SCORED_SQL + f"""
SELECT source_id, url, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT source_id, url, score, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, url) AS rank
  FROM scored WHERE score >= 5 AND {CANDIDATE_SQL}) WHERE rank <= 3
"""


@query("link_score", SCORED_SQL + "SELECT source_id, url, score FROM scored")
def scores(spark, folder):
    return link_score(united(spark, folder), KEYWORDS)


@query("topk_links", TOPK_SQL)
def best(spark, folder):
    return topk_links(link_score(united(spark, folder), KEYWORDS))


WORD = "[a-zà-öø-ÿ]+"


@query(
    "keyword_join",
    FOUND_SQL
    + f"""
, words AS (SELECT lang AS source_id, doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM documents),
terms AS (SELECT source_id, term, count(DISTINCT doc_id) AS times FROM words GROUP BY 1, 2)
SELECT l.source_id, page_id, url, term, times FROM links l JOIN terms t ON l.source_id = t.source_id AND contains(lower(url), term)
""",
)
def keywords_found(spark, folder):
    """Every word of every document is a keyword of the source named like its language; ``times`` is the number of documents with it."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("term")
    keywords = table(spark, folder, "documents").select(F.col("lang").alias("source_id"), words)
    return keyword_join(decorated(spark, folder), keywords)


RANKED_SQL = f"""
WITH raw AS (
  SELECT page_id, {SOURCE} AS source_id, regexp_extract(url, '^[a-z]+://[^/]+') AS site,
         unnest(list_distinct(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1))) AS href FROM pages),
united AS (SELECT source_id, site || href || '.zip' AS url FROM raw WHERE source_id <> 'de' UNION
  SELECT {SOURCE}, 'https://registered.example/' || {SOURCE} || '/' || min(page_id) || '.zip' FROM pages GROUP BY {SOURCE}),
{SCORED_SQL[SCORED_SQL.index("terms(source_id"):]}
"""


@query("rank_links", RANKED_SQL + TOPK_SQL[len(SCORED_SQL):])
def ranked(spark, folder):
    """Discovery from page text to ranked links in one plan; the catalog comes from the pages too."""
    rows = page_rows(spark, folder)
    first = F.concat(F.lit("https://registered.example/"), "source_id", F.lit("/"), F.min("page_id"), F.lit(".zip"))
    catalog = rows.groupBy("source_id").agg(F.array(first).alias("direct_urls")).withColumns(
        {"download_enabled": F.lit(None).cast("boolean"), "direct_urls_only": F.col("source_id").isin(DIRECT_ONLY)}
    )
    zipped = F.regexp_replace("html", 'href="([^"]+)"', 'href="$1.zip"')
    return rank_links(rows.select("source_id", "url", zipped.alias("html")), catalog, KEYWORDS).select(
        "source_id", "url", "score", "rank"
    )


# Ten documents make a source; one with a toxic document accepts only names registered for it.
FILE_EXTENSION = "CASE lang WHEN 'en' THEN '.zip' WHEN 'fr' THEN '.txt' ELSE '.CSV' END"


@query(
    "allowlist_semi",
    f"""
WITH files AS (SELECT doc_id, doc_id // 10 AS source, lang, 'cache/' || doc_id || {FILE_EXTENSION} AS path FROM documents),
catalog AS (SELECT doc_id // 10 AS source, coalesce(max(toxic) = 1, false) AS direct_only
            FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT CAST(source AS VARCHAR) AS source_id, path
FROM files JOIN catalog USING (source) LEFT JOIN labels USING (doc_id)
WHERE lang <> 'fr' AND (NOT direct_only OR quality = 1)
""",
)
def allowed(spark, folder):
    documents = table(spark, folder, "documents").select(
        "doc_id", F.expr("CAST(doc_id DIV 10 AS STRING)").alias("source_id"), F.expr(FILE_EXTENSION).alias("extension")
    )
    url = F.concat(F.lit("https://files.example/a/"), "doc_id", "extension")
    catalog = documents.join(table(spark, folder, "labels"), "doc_id", "left").groupBy("source_id").agg(
        F.collect_list(F.when(F.col("quality") == 1, url)).alias("direct_urls"),
        (F.max("toxic") == 1).alias("direct_urls_only"),
    )
    files = documents.select("source_id", F.concat(F.lit("cache/"), "doc_id", "extension").alias("path"))
    return allowlist_semi(files, catalog)
