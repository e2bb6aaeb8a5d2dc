"""URLs taken apart as columns: the same as the expressions say, and once per row."""

import re
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from ribeira.functions.urls import safe_filename, url_candidate, url_host, url_output_format, url_path, url_promises_data
from ribeira.operators.links import link_score, topk_links
from ribeira.operators.url_parts import is_candidate, promises_data, split_url, with_file_name
from tests.test_urls import BASES, HREFS

URLS = [
    *BASES, *HREFS, None, "https://u:p@X.com:80/a.zip", "https://[::1]:80/a.zip", "https://a@[::1]/a.ZIP;v=1", "https://[x@h/b.csv", "https://a@[b@c/d",
    "https://h/a.zip#x", "https://h/ows?OutputFormat=SHAPE-ZIP", "https://h/ows?outputFormat=", "https://h/x;a=1;b=2", "ftp://h/a;b/c.json;type=a",
    "https://h/ows?outputformat=&OUTPUTFORMAT=csv&outputFormat=application%2Fjson&outputFormat=kml", "https://h/ows?output%46ormat=csv",
    "https://h/ows?outputFormat=%zz", "https://h/?outputFormat=KML", "https://h/" + "long" * 90 + ".zip", "https://h/./", "https://h/a b é.csv", "https://h/a;",
    "https://h/a.zip?outputFormat=csv", "\x01 https://h/a.csv", "https://h/a\nb.csv", "javascript:a;b",
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, url, "clash") for i, url in enumerate(URLS)], "id INT, url STRING, `a.b` STRING")


def test_parts_are_those_of_the_expressions(rows):
    u = F.col("url")
    got = split_url(rows).select(
        "id", "url_parts.host", "url_parts.path", "url_parts.extension", is_candidate().alias("candidate"), promises_data().alias("data")
    )
    want = rows.select(
        "id", url_host(u).alias("host"), url_path(u).alias("path"), url_output_format(u).alias("extension"), url_candidate(u).alias("candidate"),
        url_promises_data(u).alias("data"),
    )
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)


def test_parts_against_the_standard_library(rows):
    for row in split_url(rows).select("url", "url_parts.*").collect():
        if row.url is None:
            assert row.scheme is None and row.fragment is None
        elif "[" not in row.url:
            parts = urlsplit(row.url)
            assert (row.scheme, row.authority, row.query, row.fragment) == (parts.scheme, parts.netloc, parts.query, parts.fragment)
            assert row.path + (row.params or "") == parts.path.removesuffix(";")


@pytest.mark.parametrize("limit", [None, 40])
def test_file_names(rows, limit):
    fallback = F.concat(F.lit("f_"), F.col("id"))
    got = with_file_name(rows, "name", fallback, limit=limit).select("id", "name", "`a.b`")
    want = rows.select("id", safe_filename(F.col("url"), fallback, limit).alias("name"), F.col("`a.b`"))
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)


def test_empty_and_repeated_rows(rows):
    assert split_url(rows.limit(0)).count() == 0
    assert split_url(rows.union(rows)).count() == 2 * len(URLS)
    once = split_url(rows)
    assert split_url(once) is once


def test_urls_are_split_once_and_no_value_is_named_by_a_lambda(spark):
    links = spark.range(100).selectExpr("'s' AS source_id", "concat('https://h/', id, '.zip') AS url")
    ranked = topk_links(link_score(split_url(links), {"s": ["1"]}))
    assert ranked.columns == ["source_id", "url", "score", "rank"]
    text = ranked._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"split\(regexp_replace", text)) == 1
    assert "transform(array(" not in text
