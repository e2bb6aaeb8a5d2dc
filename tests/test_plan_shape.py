"""What the physical plans must and must not contain."""

import re

import pytest

from workload import QUERIES

FOLDER = "/root/testdata/sf0.001"
# Archives and landed files are looked into with Python; nothing else is.
PYTHON = {"archive_inventory", "landed_file_check"}


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON:
        assert not re.search(r"InPandas|InArrow|ArrowEvalPython|BatchEvalPython", text)


def test_rank_limit_runs_before_the_shuffle(spark):
    text = plan(spark, "topk_links")
    final = text.index("row_number(), 3, Final")
    assert "Exchange" in text[final : text.index("row_number(), 3, Partial")]


@pytest.mark.parametrize("name", ["attribute_conflicts", "dissolve_sectors", "keyed_profile", "cumulative_access"])
def test_aggregations_do_not_expand_rows(spark, name):
    assert "Expand" not in plan(spark, name)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "prefix_filter")
    assert "StringStartsWith(o_orderpriority,1)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in text


def test_scoring_needs_no_join(spark):
    score = plan(spark, "link_score")
    assert score.count("Join") == plan(spark, "links_union").count("Join")
    assert score.count("Exchange") == plan(spark, "links_union").count("Exchange")


def test_extraction_needs_no_shuffle(spark):
    for name in ("extract_links", "normalize_text", "manifest_flatten", "landing_accepted"):
        exchanges = plan(spark, name).count("Exchange hashpartitioning")
        assert exchanges == 0 or name == "landing_accepted"


def test_manifest_texts_come_by_source(spark):
    """The parser pays for every id that is new to it, so line items are sorted by supplier, and dealt out evenly, before they become texts."""
    text = plan(spark, "manifest_flatten")
    sorts = re.findall(r"Sort \[([^\]]*)\], true", text[text.index("to_json") if "to_json" in text else text.index("StructsToJson") :])
    assert len(sorts) == 1 and re.findall(r"l_\w+", sorts[0]) == ["l_suppkey", "l_orderkey", "l_linenumber"]


@pytest.mark.parametrize("name", ["links_union", "rank_links"])
def test_page_texts_are_not_shuffled(spark, name):
    """Even without broadcasts, joins come after links have been taken out of the pages."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, FOLDER)
        executed = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    start = re.search(r"Generate explode\(.*html", executed).start()
    below = executed[start : executed.index("FileScan", start)]
    assert "Exchange" not in below and "Join" not in below


def test_scenarios_read_each_table_once(spark):
    """The flag of barred itineraries comes from the exchange that brings legs together, and no second scan."""
    text = plan(spark, "scenario_expand")
    assert text.count("FileScan") == 2 and "LeftAnti" not in text
