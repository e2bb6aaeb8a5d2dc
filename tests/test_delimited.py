"""Delimited text whose files differ in their headers."""

import pytest
from pyspark.sql import functions as F

from ribeira.sources.delimited import HeaderError, read_demography, scan_delimited


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_columns_are_found_by_name_in_every_file(spark, tmp_path):
    path = write(
        tmp_path,
        a="CD_setor;V01006;V01007\n1;9;4\n2;8;3\n",
        b="V01007;CD_setor;more;V01006\n40;10;x;90\n",
        c="﻿V01006;V01007;CD_setor\n900;400;100\n",
        d='"V01007";"V01006";"CD_setor"\n"4;0";"a ""b""";"é"\n',
        e=b"",
        f="CD_setor;V01006;V01007\n3;7;2\n",
    )
    got = scan_delimited(spark, path, ["CD_setor", "V01006", "V01007"])
    assert rows(got) == [("1", "9", "4"), ("10", "90", "40"), ("100", "900", "400"), ("2", "8", "3"), ("3", "7", "2"), ("é", 'a "b"', "4;0")]
    assert rows(scan_delimited(spark, [f"{path}/a.csv", f"{path}/b.csv"], ["V01007"])) == [("3",), ("4",), ("40",)]


def test_one_scan_per_header_and_filters_reach_it(spark, tmp_path):
    path = write(tmp_path, a="k;v;w\n15;1;2\n", b="w;v;k\n4;3;16\n", c="k;v;w\n17;5;6\n")
    df = scan_delimited(spark, path, ["k", "v"]).filter(F.col("k").startswith("15"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2 and plan.count("StringStartsWith(k,15)") == 2
    assert plan.count("ReadSchema: struct<k:string,v:string>") + plan.count("ReadSchema: struct<v:string,k:string>") == 2
    assert rows(df) == [("15", "1")]


def test_missing_and_repeated_names_raise(spark, tmp_path):
    path = write(tmp_path, a="k;v\n1;2\n", b="k;w\n1;2\n")
    with pytest.raises(HeaderError, match=r"b\.csv.*v"):
        scan_delimited(spark, path, ["k", "v"])
    assert rows(scan_delimited(spark, path, ["k"])) == [("1",), ("1",)]
    (tmp_path / "two").mkdir()
    twice = write(tmp_path / "two", a="k;v;v\n1;2;3\n")
    with pytest.raises(HeaderError, match="exactly one column v"):
        scan_delimited(spark, twice, ["k", "v"])
    (tmp_path / "none").mkdir()
    with pytest.raises(HeaderError, match="no file"):
        scan_delimited(spark, write(tmp_path / "none", a=b""), ["k"])


def test_names_that_differ_in_case_only(spark, tmp_path):
    path = write(tmp_path, a="CD_SETOR;CD_setor;\n1;2;3\n", b="CD_setor;CD_SETOR\n5;4\n")
    assert rows(scan_delimited(spark, path, ["CD_setor"])) == [("2",), ("5",)]
    assert rows(scan_delimited(spark, path, ["CD_SETOR"])) == [("1",), ("4",)]


def test_odd_rows_and_paths(spark, tmp_path):
    folder = tmp_path / "a [1] {x}"
    folder.mkdir()
    path = write(folder, **{"b c*": "k;v\n1\n;\n2;3;4\n", "only header": "v;k\n"}).replace("[", "\\[").replace("]", "\\]").replace("{", "\\{").replace("}", "\\}")
    assert sorted(scan_delimited(spark, path, ["k", "v"]).collect(), key=str) == [("1", None), ("2", "3"), (None, None)]


def test_demography_of_files_in_different_order(spark, tmp_path):
    path = write(tmp_path, a="CD_setor;V01006;V01007\n1501;9;4\n1401;1;1\n", b="V01007;V01006;CD_setor\nX;90;1502\n")
    got = read_demography(spark, path, "15", measures=["V01006", "V01007"])
    assert sorted(got.collect(), key=str) == [("1501", 9.0, 4.0), ("1502", 90.0, None)]
