"""Comparison of a Spark result with its SQL counterpart in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(shaped, key=repr)


def compare(spark, con, name, run, sql, folder):
    df = run(spark, folder)
    got = as_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = as_rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0], (name, got[0], want[0])
    assert len(got[1]) == len(want[1]), (name, len(got[1]), len(want[1]))
    different = [(a, b) for a, b in zip(got[1], want[1]) if repr(a) != repr(b)]
    assert not different, (name, len(different), different[:3])
    return len(got[1])
