"""Link discovery on small tables."""

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from ribeira import fixed
from ribeira.operators.filters import eligible_sources
from ribeira.operators.links import allowlist_semi, extract_links, link_score, links_union, registered_links, topk_links
from ribeira.plans.layers import rank_links
from ribeira.sources.manifest import catalog_table

PORTS = [
    "https://www.gov.br/antaq/pt-br/central-de-conteudos/Instalacoes_Portuarias_20212.zip",
    "https://www.gov.br/antaq/pt-br/central-de-conteudos/Instalaesporturias06052025.zip",
    "https://www.gov.br/antaq/pt-br/central-de-conteudos/Linhasdetravessias06052025.zip",
]
AERODROMES = [
    "https://geoaisweb.decea.gov.br/geoserver/ICA/ows?service=WFS&version=1.0.0&request=GetFeature&typeName=ICA:airport&outputFormat=SHAPE-ZIP",
    "https://geoaisweb.decea.gov.br/geoserver/ICA/ows?service=WFS&version=2.0.0&request=GetFeature&typeNames=ICA:airport&outputFormat=SHAPE-ZIP",
    "https://geoaisweb.decea.gov.br/geoserver/ICA/ows?service=WFS&version=2.0.0&request=GetFeature&typeNames=ICA:airport&outputFormat=application/json",
]


def links(spark, source, urls):
    return spark.createDataFrame([(source, url) for url in urls], "source_id STRING, url STRING")


def catalog(spark, *rows):
    return catalog_table(spark, rows)


def test_catalog_of_official_sources(spark):
    sources = catalog_table(spark)
    ids = [r["source_id"] for r in sources.collect()]
    assert len(ids) == len(set(ids)) == 8
    assert eligible_sources(sources, fixed.BOUNDARY_SOURCE).count() == 6
    assert set(fixed.SOURCE_KEYWORDS) == set(ids) - {fixed.BOUNDARY_SOURCE}
    direct = topk_links(link_score(registered_links(eligible_sources(sources, fixed.BOUNDARY_SOURCE))))
    assert [r["url"] for r in direct.filter("source_id = 'decea_airports'").orderBy("rank").collect()] == AERODROMES


@pytest.mark.parametrize("source, urls, score", [("antaq_ports", PORTS, 10), ("decea_airports", AERODROMES, 23)])
def test_recorded_order_comes_back(spark, source, urls, score):
    got = topk_links(link_score(links(spark, source, urls[::-1]))).orderBy("rank").collect()
    assert [(r["url"], r["score"], r["rank"]) for r in got] == [(u, score, i + 1) for i, u in enumerate(urls)]


def test_score_looks_at_the_whole_url(spark):
    urls = ["https://h/a.zip", "https://h/a.zip?v=2", "https://h/a.zip#t", "https://x.com/a.csv", "https://h/page"]
    got = {r["url"]: r["score"] for r in link_score(links(spark, "none", urls)).collect()}
    assert got == dict(zip(urls, [5, 0, 0, 5, 0]))
    kept = topk_links(link_score(links(spark, "none", urls))).collect()
    assert [r["url"] for r in kept] == ["https://h/a.zip"]


def test_repeated_and_missing_terms(spark):
    scored = link_score(links(spark, "s", ["https://h/aXb"]), {"s": ["ax", "axb", "ax", "q"]})
    assert scored.first()["score"] == 9
    assert link_score(links(spark, "s", ["https://h/a"]), {}).first()["score"] == 0


def test_topk_of_one_hot_source(spark):
    many = spark.range(50000).selectExpr(
        "if(id < 40000, 'hot', concat('s', id % 100)) AS source_id", "concat('https://h/', lpad(id, 6, '0'), '.zip') AS url"
    )
    got = topk_links(link_score(many), k=3)
    assert got.count() == 101 * 3
    assert [r["url"][-10:-4] for r in got.filter("source_id = 'hot'").orderBy("rank").collect()] == ["000000", "000001", "000002"]


CATALOG = [
    {"source_id": "open", "direct_urls": ["https://h/reg.zip"]},
    {"source_id": "closed", "direct_urls": ["https://h/only.zip", "https://h/only.zip"], "direct_urls_only": True},
    {"source_id": "off", "download_enabled": False, "direct_urls": ["https://h/off.zip"]},
    {"source_id": fixed.BOUNDARY_SOURCE},
    {"source_id": "bare", "download_enabled": True},
]


def test_eligibility(spark):
    got = eligible_sources(catalog(spark, *CATALOG), fixed.BOUNDARY_SOURCE)
    assert sorted(r["source_id"] for r in got.collect()) == ["bare", "closed", "open"]


def test_union(spark):
    sources = catalog(spark, *CATALOG[:2])
    found = links(spark, "open", ["https://h/x.zip", "https://h/reg.zip"]).union(links(spark, "closed", ["https://h/y.zip"]))
    got = links_union(found, registered_links(sources), sources).collect()
    assert sorted((r["source_id"], r["url"]) for r in got) == [
        ("closed", "https://h/only.zip"), ("open", "https://h/reg.zip"), ("open", "https://h/x.zip"),
    ]


def test_extract_keeps_page_columns(spark):
    pages = spark.createDataFrame([("s", "http://h/d/", "<a href='x'></a><a href=\"x\"></a>"), ("s", "http://h", "none")],
                                  "source_id STRING, url STRING, html STRING")
    assert [tuple(r) for r in extract_links(pages).collect()] == [("s", "http://h/d/", "http://h/d/x")]


def test_allowlist(spark):
    files = spark.createDataFrame(
        [("open", "d/any.kml"), ("open", "d/any.txt"), ("closed", "d/only.zip"), ("closed", "d/other.zip"), ("gone", "d/a.zip")],
        "source_id STRING, path STRING",
    )
    got = allowlist_semi(files, catalog(spark, *CATALOG)).collect()
    assert sorted(r["path"] for r in got) == ["d/any.kml", "d/only.zip"]


def test_discovery(spark):
    pages = spark.createDataFrame(
        [("open", "https://h/d/", "<a href='a.zip'>"), ("closed", "https://h/", "<a href='/b.zip'>"), ("off", "https://h/", "<a href='/c.zip'>")],
        "source_id STRING, url STRING, html STRING",
    )
    got = rank_links(pages, catalog(spark, *CATALOG), {}).orderBy("source_id", "rank").collect()
    assert [(r["source_id"], r["url"], r["rank"]) for r in got] == [
        ("closed", "https://h/only.zip", 1), ("open", "https://h/d/a.zip", 1), ("open", "https://h/reg.zip", 2),
    ]


def test_a_source_may_register_any_number_of_names(spark):
    """No list of names is searched per file, and a source in the catalog twice fails the query."""
    n = 100_000
    urls = spark.range(n).agg(F.collect_list(F.concat(F.lit("https://x.example/d/"), "id", F.lit(".zip"))).alias("direct_urls"))
    limited = urls.select(F.lit("s").alias("source_id"), "direct_urls", F.lit(True).alias("direct_urls_only"))
    files = spark.range(0, 2 * n, 2).select(F.lit("s").alias("source_id"), F.concat(F.lit("cache/"), "id", F.lit(".zip")).alias("path"))
    assert allowlist_semi(files, limited).count() == n // 2
    plan = allowlist_semi(files, limited)._jdf.queryExecution().executedPlan().toString()
    assert "array_contains" not in plan
    with pytest.raises(SparkRuntimeException, match="catalog key source_id is not unique"):
        allowlist_semi(files, limited.union(limited)).count()
