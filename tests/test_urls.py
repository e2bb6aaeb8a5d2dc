"""URL functions against the standard library."""

import itertools
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from ribeira.functions.urls import (
    file_suffix,
    page_links,
    path_name,
    resolve_link,
    safe_filename,
    url_candidate,
    url_host,
    url_output_format,
    url_path,
)

BASES = [
    "http://h.example/a/b/c.html?q=1#f", "https://h.example", "http://h/", "http://h//x//y", "ftp://h/d/", "file:///x/y",
    "http://h/a/b;p?q", "mailto:x@y", "", "rel/path/x", "/abs/p",
]
HREFS = [
    "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../",
    "../g", "g;", "/g;", "http://h/g;?x", "..;x", "g;?#", "/a b?c d", "/x?y#z", "http://h/x?", " /x", "/x\ty", "/x/..?q", "http://h/a/../b?c", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "./g/.", "g/./h", "g/../h",
    "http:g", "http://g/x", "HTTP://G/x", "https://z", "mailto:a@b", "javascript:void(0)", "a//b", "//", "///x", "/a//b/../c",
    "http:", "http:?q", "x/..", "./.", "http://h?", "g?#", "/g?", "a/b/../../..", "tel:1", "a:b", "1:b", "/", "//h2",
    "//h2/../x", "/a/.", "/a/..", "..//x", "/de", "èê x", "http:../q", "http:/q",
]


def test_links_resolve_as_in_the_standard_library(spark):
    pairs = list(itertools.product(BASES, HREFS))
    rows = spark.createDataFrame(pairs, "base STRING, href STRING")
    out = rows.select("base", "href", resolve_link(F.col("base"), F.col("href")).alias("link")).collect()
    assert [r for r in out if r["link"] != urljoin(r["base"], r["href"])] == []
    assert len(out) == len(pairs)


def one(spark, function, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} STRING" for i in range(len(values))))
    return row.select(function(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    "url, wanted",
    [
        ("https://h.example/a.zip", True), ("https://h.example/a.zip#x", False), ("https://x.com/a.zip", False),
        ("https://X.COM:80/a.zip", False), ("https://u@x.com/a.zip", False), ("https://h/ows?OutputFormat=SHAPE-ZIP", True),
        ("https://h/ows?outputFormat=", False), ("https://h/a.zip?v=2", True), ("https://h/x/a.ZIP;v=1", True),
        ("https://h/a.html", False), ("", False), (None, False), ("https://h/x.com/a.zip", True),
    ],
)
def test_candidates(spark, url, wanted):
    assert one(spark, url_candidate, url) is wanted


@pytest.mark.parametrize(
    "query, extension",
    [
        ("outputFormat=SHAPE-ZIP", ".zip"), ("outputFormat=application/json", ".geojson"), ("outputFormat=text/csv", ".csv"),
        ("outputFormat=kml", ".kml"), ("outputFormat=gml", None), ("x=1", None), ("outputFormat=&outputFormat=csv", ".csv"),
        ("OUTPUTFORMAT=kml&outputformat=csv", ".csv"), ("outputformat=kml&OUTPUTFORMAT=csv&outputformat=json", ".csv"),
        ("output%46ormat=application%2Fjson", ".geojson"), ("outputFormat=%zzcsv", ".csv"), ("x=outputFormat=csv", None),
    ],
)
def test_output_format(spark, query, extension):
    assert one(spark, url_output_format, f"https://h/ows?service=WFS&{query}") == extension


@pytest.mark.parametrize(
    "url, name",
    [
        ("https://h/ows?service=WFS&outputFormat=SHAPE-ZIP", "candidate_1.zip"), ("https://h/d/a b.zip", "a_b.zip"),
        ("https://h/", "candidate_1"), ("https://h/a/b/./", "b"), ("https://h/a.csv?outputFormat=json", "a.csv"),
        ("https://h/" + "x" * 200 + ".zip", "x" * 200 + ".zip"), ("https://h/çã o.zip", "_o.zip"),
    ],
)
def test_file_names(spark, url, name):
    assert one(spark, safe_filename, url, "candidate_1") == name


def test_parts(spark):
    for url in ["https://User@H.Example:8/p/q;r?s#t", "//h/p", "p?q", "http://[::1]:80/x"]:
        parts = urlsplit(url)
        assert one(spark, url_host, url) == (parts.hostname or "")
        assert one(spark, url_path, url) == parts.path.split(";")[0]
    assert one(spark, path_name, "/a/b/.//") == "b"
    assert [one(spark, file_suffix, p) for p in ["a/b.ZIP", ".zip", "a", "x/..zip", "a.b/c"]] == [".zip", "", "", ".zip", ""]


def test_page_links_are_distinct_and_sorted(spark):
    html = """<a HREF='/b'>x</a><a href="/a">y</a><a href="b">z</a><a href=/no>n</a>"""
    assert one(spark, page_links, html, "http://h/x") == ["http://h/a", "http://h/b"]


def test_long_names_stay_apart(spark):
    urls = ["https://h/" + "x" * 200 + f"{i}.zip" for i in range(2)]
    assert one(spark, safe_filename, urls[0], "c") != one(spark, safe_filename, urls[1], "c")
    df = spark.createDataFrame([(u,) for u in urls], "u STRING")
    cut = [r[0] for r in df.select(safe_filename(F.col("u"), F.lit("c"), limit=180)).collect()]
    assert len(set(cut)) == 2 and all(len(n) == 180 and n.endswith(".zip") for n in cut)
