"""Checks, joins, dissolve and status on small tables."""

import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from ribeira.operators.dissolve import dissolve_parts, dissolve_sectors, multipart_stats
from ribeira.operators.joins import checksum_join, require_unique, right_only, validated_left_join
from ribeira.operators.quality import (
    ExpectationError,
    attribute_conflicts,
    breaks_identity,
    completeness_audit,
    duplicate_keys,
    expectations,
    identity_violations,
    keyed_profile,
    not_empty_rule,
    not_zero,
    raise_on,
    row_rules,
    unique_rule,
)

DEMOGRAPHY = "CD_setor STRING, V01006 DOUBLE, V01007 DOUBLE, V01008 DOUBLE"


def demography(spark, *rows):
    return spark.createDataFrame(list(rows), DEMOGRAPHY)


def identity_rule(df):
    broken = breaks_identity(F.col("V01006"), [F.col("V01007"), F.col("V01008")])
    return row_rules(df, {"total = male + female": broken})


def test_consistent_totals_pass(spark):
    df = demography(spark, ("150000000000001", 10.0, 4.0, 6.0))
    raise_on(identity_rule(df))
    assert completeness_audit(df, "CD_setor", "V01006", "V01008").first()["part_observed"] == 6


def test_inconsistent_totals_raise(spark):
    df = demography(spark, ("150000000000001", 10.0, 4.0, 5.0))
    assert identity_violations(df, "V01006", ["V01007", "V01008"]).first()["violations"] == 1
    with pytest.raises(ExpectationError, match="total = male"):
        raise_on(identity_rule(df))


def test_missing_female_is_counted(spark):
    df = demography(spark, ("150000000000001", None, None, None))
    audit = completeness_audit(df, "CD_setor", "V01006", "V01008").first()
    assert (audit["missing_part"], audit["part_observed"]) == (1, 0)
    assert identity_violations(df, "V01006", ["V01007", "V01008"]).first()["rows_checked"] == 0


def test_profile_agrees_with_the_single_checks(spark):
    df = demography(spark, ("1", 10.0, 4.0, 6.0), ("1", 10.0, 4.0, 5.0), ("2", None, 1.0, None), (None, 3.0, 1.0, 2.0))
    got = keyed_profile(df, "CD_setor", "V01006", ["V01007", "V01008"], "V01008").first()
    single = completeness_audit(df, "CD_setor", "V01006", "V01008").first()
    assert (got["rows"], got["unique_keys"], got["missing_total"], got["missing_part"], got["part_observed"]) == tuple(single)
    assert (got["repeated_keys"], got["identity_violations"]) == (1, 1)
    empty = keyed_profile(df.limit(0), "CD_setor", "V01006", ["V01007", "V01008"], "V01008").first()
    assert set(empty) == {0}


def test_duplicate_keys_count_null_as_a_key(spark):
    df = demography(spark, ("1", None, None, None), (None, None, None, None), (None, None, None, None))
    assert [tuple(r) for r in duplicate_keys(df, ["CD_setor"]).collect()] == [(None, 2)]


def test_expectation_set(spark):
    df = demography(spark, ("1", 1.0, 1.0, 0.0), ("1", 1.0, 1.0, 0.0))
    checks = expectations(not_empty_rule(df, "rows"), unique_rule(df, ["CD_setor"], "keys"), identity_rule(df))
    assert {r["rule"]: r["violations"] for r in checks.collect()} == {"rows": 0, "keys": 1, "total = male + female": 0}
    with pytest.raises(ExpectationError, match="keys: 1"):
        raise_on(checks)
    with pytest.raises(ExpectationError, match="rows: 1"):
        raise_on(not_empty_rule(df.limit(0), "rows"))


def test_not_zero_counts_null(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (None,)], "v DOUBLE")
    assert row_rules(df, {"zero": not_zero(F.col("v"))}).first()["violations"] == 2


FEATURES = "id BIGINT, CD_SETOR STRING, NM_MUN STRING, SITUACAO STRING, AREA_KM2 DOUBLE, geom BINARY"


def feature(key, part, name="A", situation="U", area=1.0, number=0):
    return (number, key, name, situation, area, bytearray(part, "ascii"))


def test_conflicts_see_null_as_a_value(spark):
    rows = [
        feature("1", "p"), feature("1", "q", name="B"), feature("2", "p", situation=None), feature("2", "q"),
        feature(None, "p"), feature(None, "q", area=2.0), feature("3", "p", area=float("nan")), feature("3", "q", area=None),
        feature("4", "p", area=float("nan")), feature("4", "q", area=float("nan")),
    ]
    df = spark.createDataFrame(rows, FEATURES)
    got = attribute_conflicts(df, "CD_SETOR", ["NM_MUN", "SITUACAO", "AREA_KM2"])
    assert {r["attribute"]: r["conflicting_keys"] for r in got.collect()} == {"NM_MUN": 1, "SITUACAO": 1, "AREA_KM2": 1}


def test_dissolve(spark):
    rows = [feature("1", "p", number=1), feature("1", "q", number=2), feature("1", "q", number=3), feature("2", "r"), feature(None, "s")]
    df = spark.createDataFrame(rows, FEATURES)
    sectors = dissolve_sectors(df, "CD_SETOR", ["NM_MUN", "SITUACAO"]).orderBy("CD_SETOR").collect()
    assert [(r["CD_SETOR"], r["n_features"], r["NM_MUN"]) for r in sectors] == [("1", 3, "A"), ("2", 1, "A")]
    parts = dissolve_parts(df, "CD_SETOR", "geom", ["NM_MUN"])
    assert sorted((r["CD_SETOR"], bytes(r["geom"])) for r in parts.collect()) == [("1", b"p"), ("1", b"q"), ("2", b"r")]
    assert multipart_stats(df, "CD_SETOR").first().asDict() == {
        "features": 5, "unique_keys": 2, "surplus_features": 3, "multipart_keys": 1, "max_parts": 3,
    }


def test_dissolve_of_one_hot_key(spark):
    """Most rows under one key, and most of them copies of one part: nothing is lost or gathered."""
    rows = spark.range(20000).select(
        F.when(F.col("id") < 15000, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"),
        F.when(F.col("id") < 8000, F.lit(0)).otherwise(F.col("id")).cast("string").cast("binary").alias("geom"),
    )
    parts = dissolve_parts(rows, "k", "geom")
    assert parts.count() == 7001 + 5000
    assert parts.filter("k = 'hot'").count() == 7001


def test_left_join_keys_differ_in_case_only(spark):
    left = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "c")], "CD_SETOR STRING, x STRING")
    right = spark.createDataFrame([("1", 5.0), ("9", 6.0)], "CD_setor STRING, V01008 DOUBLE")
    got = validated_left_join(left, right, "CD_SETOR", "CD_setor").orderBy("x").collect()
    assert [(r["x"], r["_merge"], r["V01008"]) for r in got] == [("a", "both", 5.0), ("b", "left_only", None), ("c", "left_only", None)]
    assert right_only(left, right, "CD_SETOR", "CD_setor").first()[0] == 1
    right = right.union(spark.createDataFrame([(None, 7.0)], right.schema))
    for match, value in ((False, None), (True, 7.0)):
        got = validated_left_join(left, right, "CD_SETOR", "CD_setor", null_keys_match=match)
        assert got.filter("x = 'c'").first()["V01008"] == value


@pytest.mark.parametrize("side", ["left", "right"])
def test_repeated_keys_raise(spark, side):
    once = spark.createDataFrame([("1", 1), (None, 1)], "k STRING, v INT")
    for key in ("2", None):
        twice = spark.createDataFrame([(key, 1), (key, 1)], "k STRING, w INT")
        pair = (twice, once) if side == "left" else (once, twice)
        df = validated_left_join(*pair, "k", "k")
        with pytest.raises(SparkRuntimeException, match=f"{side} key k is not unique: {key or 'null'}"):
            df.select("_merge").collect()
        with pytest.raises(SparkRuntimeException):
            df.count()
    assert validated_left_join(once, once, "k", "k").count() == 2
    require_unique(once, "k", "left")


def test_check_and_join_share_an_exchange(spark):
    """Whatever reads the join afterwards; and no job runs while it is built."""
    left, right = (spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias(v)) for v in ("v", "w"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = validated_left_join(left, right, "k", "k").select("_merge")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange hashpartitioning(") == 2 and plan.count("Window [") == 2 and plan.count("raise_error") >= 2


def test_declarations_that_repeat_raise(spark):
    declared = spark.createDataFrame([("a", "1"), ("a", "1")], "source_id STRING, sha256 STRING")
    observed = spark.createDataFrame([("a", "f1", "1")], "source_id STRING, file STRING, sha256 STRING")
    with pytest.raises(SparkRuntimeException, match="declared key source_id is not unique: a"):
        checksum_join(declared, observed, "source_id").collect()
    nulls = spark.createDataFrame([(None, "1"), (None, "2"), ("a", "1")], declared.schema)
    assert sorted(r["outcome"] for r in checksum_join(nulls, observed, "source_id").collect()) == ["match", "missing", "missing"]


NAN, NESTED = float("nan"), "k INT, m MAP<STRING, DOUBLE>, a ARRAY<ARRAY<INT>>, s STRUCT<x: DOUBLE, y: MAP<INT, STRING>>, t STRING"


def plain(value):
    """A value as something that can be compared: maps without an order, NaN as null, -0.0 as 0.0."""
    if isinstance(value, float):
        return None if value != value else value + 0.0
    if isinstance(value, dict):
        return ("map", *sorted((plain(k), str(plain(v))) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return ("list", *map(plain, value))
    return value


def test_conflicts_of_types_without_an_order(spark):
    draw = random.Random(2)
    maps = [{"a": 1.0, "b": NAN}, {"b": None, "a": 1.0}, {"b": NAN, "a": 1.0}, {"a": 1.0}, {}, None, {"a": NAN, "b": 1.0}, {"a": -0.0}, {"a": 0.0}]
    lists = [[[1], [2]], [[1, 2], []], [[1, 2]], [[None], [1]], [[1], [None]], [], None, [None, [1]], [[1], None], [[]]]
    structs = [(1.0, {1: "x", 2: "y"}), (1.0, {2: "y", 1: "x"}), (NAN, None), (None, None), None, (None, {}), (-0.0, {}), (0.0, {})]
    rows = []
    for k in range(400):
        pools = [draw.sample(p, draw.choice([1, 1, 2])) for p in (maps, lists, structs, ["", "x", None])]
        rows += [(k if k else None, *map(draw.choice, pools)) for _ in range(draw.randrange(1, 5))]
    df = spark.createDataFrame(rows, NESTED).repartition(7)
    got = {r["attribute"]: r["conflicting_keys"] for r in attribute_conflicts(df, "k", ["m", "a", "s", "t"]).collect()}
    want = {name: sum(len({plain(r[at]) for r in rows if r[0] == k}) > 1 for k in {r[0] for r in rows}) for at, name in enumerate("mast", 1)}
    assert got == want and all(20 < n < 380 for n in want.values())
    plan = attribute_conflicts(df, "k", ["m", "t"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    sectors = dissolve_sectors(df, "k", ["m", "a", "s", "t"]).collect()
    assert len(sectors) == 399
    for r in sectors:
        mine = [row for row in rows if row[0] == r["k"]]
        for at, name in enumerate("mast", 1):
            assert plain(r[name]) in {plain(row[at]) for row in mine}
            assert (r[name] is None) == all(row[at] is None for row in mine)


def test_checksums(spark):
    declared = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source_id STRING, sha256 STRING")
    observed = spark.createDataFrame(
        [("a", "f1", "1"), ("a", "f2", "x"), ("b", "f3", "2")], "source_id STRING, file STRING, sha256 STRING"
    )
    got = checksum_join(declared, observed, "source_id").collect()
    assert sorted((r["source_id"], r["file"] or "", r["outcome"]) for r in got) == [
        ("a", "f1", "match"), ("a", "f2", "mismatch"), ("b", "f3", "match"), ("c", "", "missing"),
    ]
