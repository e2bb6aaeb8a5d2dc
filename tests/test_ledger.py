"""Status over several discovery runs."""

import hashlib
import io
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from ribeira.operators.ledger import ENTRY, merge_entries, merged_status, run_entries
from ribeira.plans.layers import discover_layers, status_over_runs
from ribeira.sources.manifest import catalog_table

LOG = "source_id STRING, url STRING, resolved_url STRING, content_type STRING, content_length BIGINT, bytes BIGINT, sha256 STRING, attempt INT, error STRING"
CACHE = "source_id STRING, path STRING, length BIGINT, content BINARY"


def day(n):
    return datetime(2026, 1, n)


def entries(spark, *rows):
    return spark.createDataFrame([(s, kind, item, outcome, path, day(n), f"r{n}") for s, kind, item, outcome, path, n in rows], ENTRY)


def counts(spark, merged, *sources):
    status = merged_status(spark.createDataFrame([(s,) for s in sources], "source_id STRING"), merged)
    return {r["source_id"]: (r["discovered"], r["downloaded"], r["preserved"], r["errors"], r["status"]) for r in status.collect()}


def archive():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a", "x")
    return data.getvalue()


def test_an_item_has_the_outcome_of_its_latest_run(spark):
    rows = [
        ("s", "link", "u1", "discovered", None, 1), ("s", "link", "u1", "discovered", None, 2),
        ("s", "fetch", "u1", "error", None, 1), ("s", "fetch", "u1", "downloaded", "s/1", 2),  # failed, then fetched
        ("s", "fetch", "u2", "downloaded", "s/2", 1), ("s", "fetch", "u2", "not_fetched", None, 2),  # not asked for again
        ("s", "cache", "s/2", "preserved", "s/2", 2),
        ("s", "fetch", "u3", "downloaded", "s/3", 1), ("s", "cache", "s/3", "error", "s/3", 2),  # broken since
        ("s", "cache", "s/4", "error", "s/4", 1), ("s", "cache", "s/4", "preserved", "s/4", 3),  # mended by hand
        ("s", "cache", "s/5", "error", "s/5", 2), ("s", "fetch", "u5", "downloaded", "s/5", 2),  # broken, fetched anew in the same run
        ("s", "page", "p1", "error", None, 1), ("s", "page", "p1", "answered", None, 2), ("s", "page", "p2", "error", None, 2),
        ("t", "fetch", "u1", "not_fetched", None, 1),
    ]
    whole = merge_entries(entries(spark, *rows))
    want = {"s": (1, 3, 1, 2, "success"), "t": (0, 0, 0, 1, "failed"), "none": (0, 0, 0, 0, "failed")}
    assert counts(spark, whole, "s", "t", "none") == want
    by_day = [merge_entries(entries(spark, *[r for r in rows if r[-1] == n])) for n in (3, 1, 2)]
    again = merge_entries(merge_entries(by_day[0], by_day[1]), by_day[2], whole)
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))


def test_no_entries(spark):
    assert counts(spark, merge_entries(entries(spark)), "a") == {"a": (0, 0, 0, 0, "failed")}


def test_a_second_run_leaves_the_status_as_it_was(spark, tmp_path):
    sources = catalog_table(spark, [{"source_id": "ports"}, {"source_id": "roads"}])
    pages = spark.createDataFrame([("ports", "https://p/", "<a href='one.zip'><a href='two.zip'>")], "source_id STRING, url STRING, html STRING")
    good, out = archive(), str(tmp_path / "out")
    log = spark.createDataFrame(
        [("ports", f"https://p/{n}.zip", f"https://p/{n}.zip", "application/zip", None, len(good), hashlib.sha256(good).hexdigest(), 1, e) for n, e in (("one", None), ("two", "reset"))], LOG
    )
    old = ("roads", "c/roads/old.zip", len(good), bytearray(good))
    first = discover_layers(pages, sources, log, spark.createDataFrame([old], CACHE))
    assert first.publish(spark, out, "first", day(1), root="c")
    before = sorted(map(tuple, status_over_runs(spark, out, sources).collect()))
    assert before == sorted(map(tuple, first.status.collect()))
    landed = spark.createDataFrame([old, ("ports", "c/ports/one.zip", len(good), bytearray(good))], CACHE)
    second = discover_layers(pages, sources, log, landed)
    assert second.status.filter("source_id = 'ports'").first()["available"] == 2  # of this run alone
    assert second.publish(spark, out, "second", day(2), root="c")
    assert sorted(map(tuple, status_over_runs(spark, out, sources).collect())) == before
    third = discover_layers(pages, sources, log.limit(0), landed)
    assert third.publish(spark, out, "third", day(3), root="c") and not third.publish(spark, out, "third", day(3), root="c")
    assert sorted(map(tuple, status_over_runs(spark, out, sources).collect())) == before


def test_what_repeats_in_a_run_counts_as_in_its_own_status(spark):
    """Pages that share a URL fail each, and links that deliver a file of the same name are downloads each."""
    sources = catalog_table(spark, [{"source_id": "s"}])
    urls = [f"https://h/{n}/data.zip" for n in "ab"]
    pages = spark.createDataFrame([("s", "https://h/", "".join(f"<a href='{u}'>" for u in urls))], "source_id STRING, url STRING, html STRING")
    log = spark.createDataFrame([("s", u, u, "application/zip", None, 9, "x", 1, None) for u in urls], LOG)
    page_log = spark.createDataFrame(
        [("s", "p", 503, None), ("s", "p", 503, None), ("s", "p", None, "reset"), ("s", "q", 404, None)], "source_id STRING, url STRING, http_status INT, error STRING"
    )
    cached = spark.createDataFrame([("s", "c/s/old.zip", 4, bytearray(b"text"))], CACHE)
    run = discover_layers(pages, sources, log, cached, page_log=page_log)
    want = sorted(map(tuple, run.status.collect()))
    assert want == [("s", 2, 2, 0, 5, 2, "success")]
    parts = [
        run_entries(run.links, run.downloads.limit(2 if n == 1 else 0), run.preserved, run.errors, str(n), F.lit(day(n)), "c") for n in (1, 2)
    ]
    merged = merge_entries(*parts)
    assert sorted(map(tuple, merged_status(sources, merged).collect())) == want
    assert sorted(map(tuple, merged_status(sources, merge_entries(merged, *parts)).collect())) == want


def test_links_to_a_file_found_broken_since(spark):
    rows = [("s", "fetch", "u1", "downloaded", "s/1", 1), ("s", "fetch", "u2", "downloaded", "s/1", 1), ("s", "cache", "s/1", "error", "s/1", 2)]
    assert counts(spark, merge_entries(entries(spark, *rows)), "s") == {"s": (0, 0, 0, 1, "failed")}
    anew = [*rows, ("s", "fetch", "u2", "downloaded", "s/1", 3)]
    assert counts(spark, merge_entries(entries(spark, *anew)), "s") == {"s": (0, 1, 0, 0, "success")}


def test_no_committed_run(spark, tmp_path):
    sources = catalog_table(spark, [{"source_id": "a"}])
    assert status_over_runs(spark, str(tmp_path / "none"), sources).select("status", F.col("errors")).collect() == [("failed", 0)]
