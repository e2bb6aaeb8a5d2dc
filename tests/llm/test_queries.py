"""The registered queries: SQL where there is some, and the pipeline."""

import __spark_entry__ as entry
import corpus_pipeline
import duckdb
import pytest

from ribeira.llm import queries
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, queries.QUERIES[name], queries.SQL[name], FOLDER) > 0


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_leaks_found_at_sf01(spark):
    folder = "/root/testdata/sf0.1"
    item, doc = (duckdb.sql(f"SELECT * FROM '{folder}/{t}.parquet'").fetchall() for t in ("benchmark", "documents"))
    want = {(d[0], i[0]) for d in doc for i in item if i[1].lower() in d[1].lower()}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op3_decontaminate"](spark, folder).collect()}
    assert got == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, FOLDER)
        assert docs.dtypes == before.dtypes
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0] and len(set(sizes)) >= 4
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == ids
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in ids) <= 2
