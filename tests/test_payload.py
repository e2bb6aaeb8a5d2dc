"""API payloads, manifests and collection records."""

import json

import pytest

from ribeira.operators.provenance import write_with_provenance
from ribeira.plans.statistics import run_statistics_table
from ribeira.sources.manifest import catalog_sources, flatten_manifest, manifest_errors, manifest_files, manifest_links, manifest_sources
from ribeira.sources.manifest import read_documents
from ribeira.sources.payload import PayloadError, payload_normalize, payload_strict, safe_names


def texts(spark, *payloads):
    return spark.createDataFrame([(json.dumps(p, ensure_ascii=False),) for p in payloads], "value STRING")


def test_columns_and_labels(spark):
    table, labels = payload_normalize(
        texts(spark, [{"D1C": "Código", "V": "Valor", "X": "Valor"}, {"D1C": "15", "V": "7", "X": "8"}])
    )
    assert table.columns == ["codigo", "valor", "valor_2"]
    assert table.collect() == [("15", "7", "8")]
    assert labels == {"codigo": "Código", "valor": "Valor", "valor_2": "Valor"}


@pytest.mark.parametrize(
    "header, names",
    [
        ([("A", "a", "a", "a"), ("B", "a", "a", "b"), ("C", "a_2", "a_2", "c")], ["a", "a_2", "a_2_2"]),
        ([("D9", "***", "", "d9")], ["d9"]),
    ],
)
def test_safe_names(header, names):
    assert list(safe_names(header).values()) == names


def test_codes_without_values_have_no_column(spark):
    table, labels = payload_normalize(texts(spark, [{"A": "a", "B": "b"}, {"A": "1", "Q": "9"}]))
    assert (table.columns, labels) == (["a"], {"a": "a", "b": "b"})


def test_header_only_and_empty(spark):
    table, labels = payload_normalize(texts(spark, [{"A": "a", "B": "b"}]))
    assert (table.columns, table.count(), list(labels)) == (["a", "b"], 0, ["a", "b"])
    table, labels = payload_normalize(texts(spark, []))
    assert (table.columns, table.count(), labels) == ([], 0, {})
    for short in ([], [{"A": "a"}]):
        with pytest.raises(PayloadError):
            payload_strict(texts(spark, short))


def test_several_payloads_share_a_header(spark):
    first, second = [{"A": "a"}, {"A": "1"}], [{"A": "a"}, {"A": "2"}, {"A": "3"}]
    table, _ = payload_normalize(texts(spark, first, second))
    assert sorted(r["a"] for r in table.collect()) == ["1", "2", "3"]
    with pytest.raises(PayloadError):
        payload_normalize(texts(spark, first, [{"A": "other"}, {"A": "2"}]))


def test_strict_keeps_labels(spark):
    table = payload_strict(texts(spark, [{"A": "Á b", "B": "c"}, {"A": "1", "B": "2", "Z": "3"}]))
    assert (table.columns, table.collect()) == (["Á b", "c", "Z"], [("1", "2", "3")])
    with pytest.raises(PayloadError):
        payload_strict(texts(spark, [{"A": "x", "B": "x"}, {"A": "1", "B": "2"}]))


def test_statistics_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    payload = [{"D1C": "Código", "V": "Valor"}, {"D1C": "15", "V": "7"}, {"D1C": "16", "V": "8"}]
    (tmp_path / "in" / "a.json").write_text(json.dumps(payload, indent=1, ensure_ascii=False), encoding="utf-8")
    out = str(tmp_path / "out")
    record = run_statistics_table(spark, str(tmp_path / "in"), out, "statistics office", "https://api.example/t/9514", {"table": 9514})
    row = record.first()
    assert (row["record_count"], row["column_labels"], row["parameters"]) == (2, {"codigo": "Código", "valor": "Valor"}, {"table": "9514"})
    assert spark.read.parquet(f"{out}/table").count() == 2


def test_records_are_appended_sorted_and_readable(spark, tmp_path):
    table = spark.range(5)
    for run in ("a", "b"):
        write_with_provenance(table, str(tmp_path / run), str(tmp_path / "log"), "fonte é", "e", {"k": run})
    lines = [line for f in sorted((tmp_path / "log").glob("*.json")) for line in f.read_text(encoding="utf-8").splitlines()]
    assert len(lines) == 2 and all("fonte é" in line for line in lines)
    assert list(json.loads(lines[0])) == sorted(json.loads(lines[0]))
    assert json.loads(lines[0])["column_labels"] == {}


def download(name, size, members):
    return {"url": f"https://h/{name}", "resolved_url": f"https://h/{name}", "path": f"raw/{name}", "bytes": size,
            "sha256": "0" * 64, "content_type": "application/zip", "zip_inventory": members, "attempt": 1}


def test_manifest(spark, tmp_path):
    manifest = {
        "generated_at_utc": "2026-01-01T00:00:00+00:00",
        "sources": {
            "roads": {"agency": "A", "official_page": "p", "discovery_policy": "d", "discovered": ["u1", "u2"],
                      "downloads": [download("a.zip", 10, ["x", "y"]), download("b.json", 5, [])], "preserved": [], "errors": []},
            "ports": {"agency": "B", "official_page": "p", "discovery_policy": "d", "discovered": [], "downloads": [],
                      "preserved": [], "errors": [{"stage": "page", "type": "E", "message": "m"}]},
        },
        "policy": {"max_candidates_per_source": 3},
    }
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=2), encoding="utf-8")
    sources = manifest_sources(read_documents(spark, str(tmp_path / "m.json")))
    flat = flatten_manifest(sources).collect()
    assert sorted((r["source_id"], r["path"] or "", r["bytes"] or 0, r["members"]) for r in flat) == [
        ("ports", "", 0, 0), ("roads", "raw/a.zip", 10, 2), ("roads", "raw/b.json", 5, 0),
    ]
    assert manifest_files(sources).count() == 2 and manifest_files(sources, "preserved").count() == 0
    assert [r["stage"] for r in manifest_errors(sources).collect()] == ["page"]
    assert manifest_links(sources).count() == 2


def test_catalog_documents(spark, tmp_path):
    catalog = {"sources": [{"source_id": "a", "expected_formats": ["shp"], "download_enabled": False, "http_status": 200},
                           {"source_id": "b", "direct_urls": ["u"], "status": "available"}]}
    (tmp_path / "c.json").write_text(json.dumps(catalog), encoding="utf-8")
    rows = {r["source_id"]: r for r in catalog_sources(read_documents(spark, str(tmp_path / "c.json"))).collect()}
    assert (rows["a"]["download_enabled"], rows["b"]["download_enabled"], rows["b"]["direct_urls"]) == (False, None, ["u"])


def test_any_number_of_stray_codes(spark):
    stray = {f"S{i}": "x" for i in range(10_001)}
    table, labels = payload_normalize(texts(spark, [{"A": "a"}, {"A": "1", **stray}]))
    assert (table.columns, table.collect(), labels) == (["a"], [("1",)], {"a": "a"})
    strict = payload_strict(texts(spark, [{"A": "a"}, {"A": "1", **stray}]))
    assert len(strict.columns) == 10_002 and strict.columns[0] == "a"


def test_headers_are_compared_by_their_entries(spark):
    table, _ = payload_normalize(texts(spark, [{"A": "a", "B": "b"}, {"A": "1", "B": "2"}], [{"B": "b", "A": "a"}, {"A": "3", "B": "4"}]))
    assert table.columns == ["a", "b"] and sorted(map(tuple, table.collect())) == [("1", "2"), ("3", "4")]


def test_many_equal_labels_get_names_of_their_own():
    names = list(safe_names([(f"C{i}", "v", "v", "c") for i in range(20_000)]).values())
    assert names[:3] == ["v", "v_2", "v_3"] and len(set(names)) == 20_000
