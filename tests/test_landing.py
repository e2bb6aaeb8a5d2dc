"""Landed files, acceptance and status."""

import hashlib
import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ribeira.operators.landing import (
    accepted,
    archive_inventory,
    availability,
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
from ribeira.operators.quality import ExpectationError
from ribeira.plans.layers import discover_layers
from ribeira.sources.files import content_parts, file_digests, scan_files
from tests.test_links import catalog
from workload import QUERIES


def archive(*names):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        for name in names:
            out.writestr(name, "x")
    return data.getvalue()


CONTENTS = {
    "good.zip": archive("b.shp", "pasta/é.dbf"),
    "none.zip": archive(),
    "fake.zip": b"<html>",
    "empty.csv": b"",
    "bom.json": b'\xef\xbb\xbf{"a": 1, "a": NaN}',
    "latin.json": '{"a": "é"}'.encode("latin-1"),
    "broken.GeoJSON": b"{",
    "hidden.kml": archive("doc.kml"),
    "text.csv": b"a;b",
}


@pytest.fixture()
def landed(spark, tmp_path):
    for name, content in CONTENTS.items():
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_digests(spark, landed):
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in file_digests(spark, str(landed)).collect()}
    # Spark passes over empty files.
    assert got == {name: (len(content), hashlib.sha256(content).hexdigest()) for name, content in CONTENTS.items() if content}
    assert scan_files(spark, str(landed), "*.zip").count() == 3


def test_every_supplier_has_a_digest(spark, tmp_path):
    rows = [(7, "Ann", 1), (-8, "B\nb;9", 1), (9, None, 1), (10, "Dé", 2)]
    spark.createDataFrame(rows, "s_suppkey BIGINT, s_name STRING, s_nationkey INT").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["s_suppkey"]: (r["bytes"], r["sha256"]) for r in QUERIES["file_digest"](spark, str(tmp_path)).collect()}
    lines = {key: f"{name};{nation};{key}\n".encode() for key, name, nation in rows if name}
    assert got == {9: (None, None), **{key: (len(line), hashlib.sha256(line).hexdigest()) for key, line in lines.items()}}


def test_contents_are_taken_up_in_parts():
    contents = [b"x" * n for n in (0, 300, 900, 50, 50)] + [None, b"y" * 5000, b"", b"z" * 999, b"z", b"z"]
    batches = [pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], names=["content"]) for part in (contents, [], [None], contents[::-1])]
    got = [part.column(0).to_pylist() for part in content_parts(1000)(batches)]
    assert sum(got, []) == contents + [None] + contents[::-1]
    assert all(len(part) == 1 or sum(len(c or b"") for c in part) <= 1000 for part in got) and len(got) == 11


def test_checks(spark, landed):
    inspected = inspect_files(scan_files(spark, str(landed)))
    unseen = spark.createDataFrame([("absent.zip",), (f"file:{landed}/empty.csv",)], "path STRING")
    declared = inspected.select("path").union(unseen)
    got = {r["path"].rsplit("/", 1)[-1]: r["reason"] for r in landed_file_check(inspected, declared).collect()}
    assert got == {
        "good.zip": None, "none.zip": None, "fake.zip": "not_a_zip", "empty.csv": "missing_or_empty", "bom.json": None,
        "latin.json": "invalid_json", "broken.GeoJSON": "invalid_json", "hidden.kml": None, "text.csv": None,
        "absent.zip": "missing_or_empty",
    }


def test_inventory(spark, landed):
    files = scan_files(spark, str(landed))
    got = {(r["path"].rsplit("/", 1)[1], r["pos"], r["member"]) for r in archive_inventory(inspect_files(files)).collect()}
    assert got == {("good.zip", 0, "b.shp"), ("good.zip", 1, "pasta/é.dbf"), ("hidden.kml", 0, "doc.kml")}
    assert archive_inventory(inspect_files(files, limit=1)).count() == 2


LOG = "source_id STRING, url STRING, resolved_url STRING, content_type STRING, content_length BIGINT, bytes BIGINT, sha256 STRING, attempt INT"


def fetched(spark, *rows):
    full = [(s, u, r or u, t, n, b, h, a) for s, u, r, t, n, b, h, a in rows]
    return spark.createDataFrame(full, LOG)


@pytest.mark.parametrize(
    "row, reason",
    [
        (("a", "https://h/x.zip", None, "application/zip", 5, 5, "h", 1), None),
        (("a", "https://h/x.zip", None, None, None, 5, "h", 1), None),
        (("a", "https://h/x", None, "Text/HTML; charset=x", 80_000_001, 5, "bad", 1), "html_response"),
        (("a", "https://h/x.zip", "https://h/x", "application/zip", 80_000_001, 5, "bad", 1), "no_data_extension"),
        (("a", "https://h/x.zip", None, "application/zip", 80_000_001, 80_000_001, "bad", 1), "declared_size_over_limit"),
        (("a", "https://h/x.zip", None, "application/zip", None, 80_000_001, "bad", 1), "size_over_limit"),
        (("a", "https://h/x.zip", None, "application/zip", 80_000_000, 80_000_000, "bad", 1), "checksum_mismatch"),
        (("a", "https://h/x.zip", None, "application/zip", None, 0, "bad", 1), "missing_or_empty"),
        (("free", "https://h/x.zip", None, "application/zip", None, 5, "bad", 1), None),
        (("unlisted", "https://h/x.zip", None, "application/zip", None, 5, None, 1), None),
    ],
)
def test_acceptance(spark, row, reason):
    sources = catalog(spark, {"source_id": "a", "expected_sha256": "h"}, {"source_id": "free"})
    assert landing_accept(fetched(spark, row), sources).first()["reject_reason"] == reason


def test_attempts(spark):
    ok, bad = "application/zip", "text/html"
    log = fetched(
        spark,
        ("a", "https://h/1.zip", None, bad, None, 1, "", 1), ("a", "https://h/1.zip", None, ok, None, 1, "", 2),
        ("a", "https://h/1.zip", None, ok, None, 1, "", 3), ("a", "https://h/2.zip", None, bad, None, 1, "", 1),
        ("a", "https://h/2.zip", None, ok, 90_000_000, 1, "", 2),
    )
    settled = settle_attempts(landing_accept(log, catalog(spark, {"source_id": "a"})))
    assert [(r["url"], r["attempt"]) for r in accepted(settled).collect()] == [("https://h/1.zip", 2)]
    error = fetch_errors(settled).first()
    assert (error["stage"], error["url"], error["message"], error["attempts"]) == (
        "download", "https://h/2.zip", "declared_size_over_limit", 2,
    )


def test_status(spark):
    def of(*ids):
        return spark.createDataFrame([(i,) for i in ids], "source_id STRING")

    got = source_status(of("a", "b", "c"), of("a", "a"), of("a"), of("a", "b"), of("c"))
    rows = {r["source_id"]: tuple(r)[1:] for r in got.collect()}
    assert rows == {"a": (2, 1, 1, 0, 2, "success"), "b": (0, 0, 1, 0, 1, "success"), "c": (0, 0, 0, 1, 0, "failed")}
    assert overall_status(got).first()["status"] == "partial"
    assert overall_status(got.filter("source_id <> 'c'")).first()["status"] == "complete"
    assert overall_status(got.limit(0)).first()["status"] == "complete"


def test_availability(spark):
    log = spark.createDataFrame([("a", 200), ("b", 299), ("c", 404), ("d", None), ("e", 301)], "source_id STRING, http_status INT")
    assert [r["status"] for r in probe_status(log).orderBy("source_id").collect()] == [
        "available", "available", "http_error", "unreachable", "http_error",
    ]
    assert tuple(availability(log).first()) == (5, 2, 3)


# What one published discovery run downloaded, as (source, files, bytes, members).
PUBLISHED = [
    ("mapbiomas_state_roads", [(11870908, 4)]),
    ("mapbiomas_federal_roads", [(4256367, 4)]),
    ("mapbiomas_other_roads", [(31596135, 4)]),
    ("antaq_ports", [(3028070, 8), (518623, 7), (47307, 7)]),
    ("antaq_waterways", [(2415007, 7), (3243886, 7), (710326, 8)]),
    ("decea_airports", [(728363, 5), (728824, 5), (3115559, 0)]),
]


def test_published_run(spark):
    rows = [(source, size, members) for source, files in PUBLISHED for size, members in files]
    downloads = spark.createDataFrame(rows, "source_id STRING, bytes BIGINT, members INT")
    assert downloads.selectExpr("count(*)", "sum(bytes)", "sum(members)").first() == (12, 62_259_375, 66)
    sources = downloads.select("source_id").distinct()
    none = downloads.limit(0)
    status = source_status(sources, downloads, downloads, none, none)
    assert [r["status"] for r in status.collect()] == ["success"] * 6
    assert overall_status(status).first()["status"] == "complete"


def test_discovery_run(spark, tmp_path):
    sources = catalog(
        spark,
        {"source_id": "roads", "direct_urls": ["https://h/r.zip"], "direct_urls_only": True, "expected_sha256": "no"},
        {"source_id": "ports"},
        {"source_id": "off", "download_enabled": False},
    )
    pages = spark.createDataFrame([("ports", "https://p/", "<a href='one.zip'><a href='two.json'>")], "source_id STRING, url STRING, html STRING")
    log = fetched(
        spark,
        ("roads", "https://h/r.zip", None, "application/zip", None, 5, "other", 3),
        ("ports", "https://p/one.zip", None, "application/zip", None, 5, "x", 1),
        ("ports", "https://p/unranked.zip", None, "application/zip", None, 5, "x", 1),
    )
    good = archive("a")
    cached = spark.createDataFrame(
        [("roads", "c/r.zip", len(good), bytearray(good)), ("roads", "c/else.zip", len(good), bytearray(good)),
         ("ports", "c/bad.zip", 3, bytearray(b"abc")), ("off", "c/o.zip", len(good), bytearray(good))],
        "source_id STRING, path STRING, length BIGINT, content BINARY",
    )
    run = discover_layers(pages, sources, log, cached)
    assert sorted(r["url"] for r in run.links.collect()) == ["https://h/r.zip", "https://p/one.zip", "https://p/two.json"]
    assert [r["url"] for r in run.downloads.collect()] == ["https://p/one.zip"]
    kept = run.preserved.collect()
    assert [(r["path"], r["sha256"], r["members"]) for r in kept] == [("c/r.zip", hashlib.sha256(good).hexdigest(), ["a"])]
    assert sorted((r["stage"], r["message"]) for r in run.errors.collect()) == [
        ("cache_validation", "not_a_zip"), ("download", "checksum_mismatch"), ("download", "no attempt on record"),
    ]
    status = {r["source_id"]: (r["discovered"], r["downloaded"], r["preserved"], r["errors"], r["status"]) for r in run.status.collect()}
    assert status == {"roads": (1, 0, 1, 1, "success"), "ports": (2, 1, 0, 2, "success")}
    assert run.overall.first()["status"] == "complete"
    assert [r["path"] for r in run.downloads.collect()] == ["ports/one.zip"]
    run.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "errors")).count() == 3


def test_everything_that_was_listed_or_ranked_is_accounted_for(spark):
    sources = catalog(spark, {"source_id": "a"}, {"source_id": "d", "direct_urls": ["https://h/d.zip"], "direct_urls_only": True})
    pages = spark.createDataFrame([("a", "https://p/", "<a href='1.zip'><a href='2.zip'><a href='3.zip'>")], "source_id STRING, url STRING, html STRING")
    ok = "application/zip"
    log = fetched(
        spark, ("a", "https://p/1.zip", None, ok, None, 5, "x", 1), ("a", "https://p/2.zip", None, ok, None, 5, "x", 1),
        ("d", "https://h/d.zip", None, ok, None, 5, "x", 1),
    ).withColumns(
        {
            "http_status": F.when(F.col("url").contains("1.zip"), 404).otherwise(200),
            "error": F.when(F.col("url").contains("d.zip"), "timed out"),
            "file_reason": F.when(F.col("url").contains("2.zip"), "not_a_zip"),
        }
    )
    good = archive("x")
    listing = spark.createDataFrame([("a", "c/e.zip", 0), ("a", "c/_b.zip", 9), ("a", "c/.c.zip", 9), ("a", "c/ok.zip", len(good)), ("a", "c/n.txt", 0)], "source_id STRING, path STRING, length BIGINT")
    cached = spark.createDataFrame([("a", "c/ok.zip", len(good), bytearray(good))], "source_id STRING, path STRING, length BIGINT, content BINARY")
    page_log = spark.createDataFrame(
        [("a", "https://p/", 200, None), ("a", "https://p/x", 503, None), ("a", "https://p/y", None, "reset"), ("d", "https://p/z", 500, None)],
        "source_id STRING, url STRING, http_status INT, error STRING",
    )
    run = discover_layers(pages, sources, log, cached, page_log=page_log, listing=listing)
    got = sorted((r["stage"], (r["url"] or r["path"]), r["message"]) for r in run.errors.collect())
    assert got == [
        ("cache_validation", "c/.c.zip", "not_read"), ("cache_validation", "c/_b.zip", "not_read"), ("cache_validation", "c/e.zip", "missing_or_empty"),
        ("download", "https://h/d.zip", "transport_error"), ("download", "https://p/1.zip", "http_error"), ("download", "https://p/2.zip", "not_a_zip"),
        ("download", "https://p/3.zip", "no attempt on record"), ("page", "https://p/x", "HTTP 503"), ("page", "https://p/y", "reset"),
    ]
    assert [r["path"] for r in run.preserved.collect()] == ["c/ok.zip"] and run.downloads.count() == 0
    assert run.overall.first()["status"] == "partial"
    with pytest.raises(ExpectationError):
        discover_layers(pages, sources.union(sources), log, cached)


def test_all_members_are_listed(spark):
    content = archive(*(f"m{i}" for i in range(6000)))
    files = spark.createDataFrame([("a.zip", len(content), bytearray(content))], "path STRING, length BIGINT, content BINARY")
    assert archive_inventory(inspect_files(files)).count() == 6000
    cut = inspect_files(files, limit=10).first()
    assert (len(cut["members"]), cut["member_count"]) == (10, 6000)


def test_contents_go_to_python_only_where_they_may_tell_something(spark):
    files = spark.createDataFrame([("a.csv", 3, bytearray(b"abc"))], "path STRING, length BIGINT, content BINARY")
    plan = inspect_files(files)._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN (contains(" in plan and "substring(content" in plan


def test_catalog_with_its_probes(spark):
    log = spark.createDataFrame([("a", 200, None), ("a", None, "timeout"), ("b", 404, None)], "source_id STRING, http_status INT, error STRING")
    probed = probe_catalog(catalog(spark, {"source_id": "a"}, {"source_id": "b"}, {"source_id": "c"}), log)
    assert sorted((r["source_id"], r["status"], r["error"]) for r in probed.collect()) == [
        ("a", "available", None), ("a", "unreachable", "timeout"), ("b", "http_error", None), ("c", "not_probed", None),
    ]
    assert {tuple(r) for r in probe_outcomes(probed).collect()} >= {("a", "available", 200, None, 1), ("c", "not_probed", None, None, 1)}
