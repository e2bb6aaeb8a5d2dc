"""Text, code and number functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ribeira.functions.text import clean_code, coerce_numeric, localized_number, normalize_text, slug
from ribeira.sources.files import content_digest
from workload.registry import query, table

ASCII_SQL = "regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')"
NORMALIZED_SQL = (
    f"regexp_replace(lower(regexp_replace({ASCII_SQL}, '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g')), "
    "'[\\s\\x1c-\\x1f]+', ' ', 'g')"
)
NUMBER_SQL = "(?i)^\\s*[+-]?((\\d+\\.?\\d*|\\.\\d+)(e[+-]?\\d+)?|inf(inity)?)\\s*$"


@query("normalize_text", f"SELECT doc_id, {NORMALIZED_SQL} AS normalized FROM documents")
def normalized(spark, folder):
    return table(spark, folder, "documents").select("doc_id", normalize_text(F.col("text")).alias("normalized"))


@query("slug", f"SELECT doc_id, trim(regexp_replace(lower({ASCII_SQL}), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents")
def slugs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", slug(F.col("text")).alias("slug"))


# Keys as they come from spreadsheets: with a decimal tail, blanks around them, or a letter in them.
CODE_TEXT = """CASE o_orderstatus WHEN 'F' THEN concat(o_orderkey, '.0') WHEN 'O' THEN concat('  ', o_custkey * 100000, ' ')
  ELSE concat(CASE WHEN o_orderpriority = '5-LOW' THEN 'x' ELSE '' END, o_orderkey) END"""


@query(
    "clean_code",
    f"""
SELECT o_orderkey, CASE WHEN regexp_matches(c, '^[0-9]+$') THEN CASE WHEN length(c) >= 7 THEN c ELSE lpad(c, 7, '0') END END AS code
FROM (SELECT o_orderkey, trim(regexp_replace({CODE_TEXT}, '\\.0$', '')) AS c FROM orders)
""",
)
def codes(spark, folder):
    raw = F.expr(CODE_TEXT)
    return table(spark, folder, "orders").select("o_orderkey", clean_code(raw).alias("code"))


# Numbers written with grouping dots and a decimal comma, and texts that are no numbers.
LOCALIZED_TEXT = """CASE o_orderpriority WHEN '1-URGENT' THEN '-' WHEN '2-HIGH' THEN 'X'
  WHEN '3-MEDIUM' THEN concat(o_custkey, '.', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), ',5')
  WHEN '4-NOT SPECIFIED' THEN concat(' ', o_orderkey, 'd') ELSE concat('1 ', o_orderkey, ',25') END"""


@query(
    "localized_number",
    f"""
SELECT o_orderkey, CASE WHEN regexp_matches(c, '{NUMBER_SQL}') THEN try_cast(c AS DOUBLE) END AS number
FROM (SELECT o_orderkey, replace(replace(replace({LOCALIZED_TEXT}, ' ', ''), '.', ''), ',', '.') AS c FROM orders)
""",
)
def numbers(spark, folder):
    raw = F.expr(LOCALIZED_TEXT)
    return table(spark, folder, "orders").select("o_orderkey", localized_number(raw).alias("number"))


NUMERIC_TEXT = """CASE WHEN event_type = 'click' THEN concat(event_id, 'f') WHEN event_type = 'view' THEN 'NaN'
  WHEN event_type = 'signup' THEN concat('1_', event_id) WHEN event_type = 'error' THEN concat(' +', event_id, '.5 ')
  ELSE concat(event_id, 'e2') END"""


@query(
    "coerce_numeric",
    f"""
SELECT event_id, CASE WHEN regexp_matches(c, '{NUMBER_SQL}') THEN try_cast(trim(c) AS DOUBLE) END AS number
FROM (SELECT event_id, {NUMERIC_TEXT} AS c FROM events)
""",
)
def coerced(spark, folder):
    return table(spark, folder, "events").select("event_id", coerce_numeric(F.expr(NUMERIC_TEXT)).alias("number"))


@query("content_digest", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def digests(spark, folder):
    return table(spark, folder, "documents").select("doc_id", content_digest(F.col("text")).alias("sha256"))
