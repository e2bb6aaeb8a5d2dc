"""Spectrum slicing and whitening, against numpy's eigensolver and exact sums."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ribeira.llm import whitening
from ribeira.llm.spectrum import Factors, Spectrum, leading
from ribeira.llm.whitening import fit, pack, unpack, whiten

DDL = "vec_id long, embedding array<float>"


def symmetric(n, seed, values=None):
    draw = np.random.default_rng(seed)
    q, _ = np.linalg.qr(draw.standard_normal((n, n)))
    values = draw.standard_normal(n) if values is None else np.array(values, float)
    return (q * values) @ q.T, np.sort(values)[::-1]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33, 64])
def test_factors_count_and_solve(n):
    a, values = symmetric(n, n)
    for shift in [*np.linspace(-2, 2, 9), 0.0]:
        b = a - shift * np.eye(n)
        made = Factors(b, 1e-300)
        assert made.above == (values > shift).sum()
        x = np.random.default_rng(1).standard_normal(n)
        assert np.allclose(b @ made.solve(x), x, atol=1e-6)
    swap = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert Factors(swap, 1e-300).above == 1 and np.allclose(Factors(swap, 1e-300).solve(np.array([2.0, 3.0])), [3, 2])


@pytest.mark.parametrize(
    "values",
    [[5, 4, 3, 2, 1], [3, 3, 3, 1, 0], [1, 1 - 1e-13, 0.5, 0.5 + 1e-9, 0], [1e6, 1, 1e-6, 1e-12, 0], [2] * 5, [0, 0, 0, 0, 0], list(range(40))],
)
def test_leading_pairs(values):
    a, want = symmetric(len(values), 3, values)
    got, vectors = leading(a, 16)
    count = min(16, int((want > 1e-13 * max(want[0], 1e-300)).sum()))
    assert min(16, int((want > 1e-11 * want[0]).sum())) <= len(got) <= count if want[0] else len(got) == 0
    assert np.allclose(got, want[: len(got)], rtol=0, atol=1e-13 * max(want[0], 1) * len(values))
    assert np.allclose(vectors @ vectors.T, np.eye(len(got)), atol=1e-12)
    assert np.abs(a @ vectors.T - vectors.T * got).max(initial=0) <= 1e-12 * max(want[0], 1)


def test_a_value_of_the_wrong_number_is_not_certified():
    a, values = symmetric(12, 5)
    spectrum = Spectrum(a)
    assert spectrum.certified(values[2], 3) and not spectrum.certified(values[2], 2) and not spectrum.certified(values[2], 4)


def slowly(rows, components=16):
    """Straight from the definition: exact fractions, then numpy's eigensolver."""
    left = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fits = list({tuple(x) for _, x in left})
    n, d = len(fits), len(fits[0])
    sums = [sum(x[j] for x in fits) for j in range(d)]
    centred = [[n * x[j] - sums[j] for j in range(d)] for x in fits]
    matrix = np.array([[float(Fraction(sum(c[i] * c[j] for c in centred), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    out = {}
    for at, (i, x) in enumerate(left):
        y = np.array([n * x[j] - sums[j] for j in range(d)], object)
        w = (y / n).astype(float) @ vectors[:, :k] / np.sqrt(values[:k])
        out[at] = (i, n, int((y**2).sum()), w, values[:k] / np.trace(matrix))
    return out, k


def by_row(df, k):
    rows = df.collect()
    found = {}
    for r in rows:
        found.setdefault((r.vec_id is None, r.vec_id), []).append(r)
    return rows, found


def agree(df, rows):
    want, k = slowly(rows)
    got, by_id = by_row(df, k)
    assert len(got) == len(want) * k
    for key, one in by_id.items():
        mine = [w for w in want.values() if (w[0] is None, w[0]) == key]
        assert sorted((r.n, r.deviation, r.component) for r in one) == sorted((w[1], w[2], c) for w in mine for c in range(1, k + 1))
    signs = {}
    for w in want.values():
        for c in range(k):
            values = [r.whitened for r in by_id[w[0] is None, w[0]] if r.component == c + 1]
            assert any(abs(abs(v) - abs(w[3][c])) < 1e-6 for v in values)
            near = min(values, key=lambda v: abs(abs(v) - abs(w[3][c])))
            if abs(w[3][c]) > 1e-3 and len(values) == 1:
                signs.setdefault(c, set()).add(near * w[3][c] > 0)
    assert all(len(s) == 1 for s in signs.values())
    explained = {(r.component, r.explained) for r in got}
    assert len(explained) == k and all(abs(e / next(iter(want.values()))[4][c - 1] - 1) < 1e-8 for c, e in explained)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def made(n, d, seed):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, 1 + 0.2 * j) + (10 if j == 1 else 0) for j in range(d)]) for i in range(n)]


def test_rows_against_brute_force(spark):
    good = made(200, 20, 1)
    odd = [(900, None), (901, [1.0] * 19 + [None]), (902, [float("nan")] * 20), (903, [float("inf")] + [0.0] * 19), (904, [])]
    rows = good + [(3, good[5][1]), (7, good[7][1]), (7, good[7][1]), (None, good[9][1])] + odd
    df = spark.createDataFrame(rows, DDL).repartition(5).withColumns({"component": F.lit(3), "n": F.lit("x"), "VECTOR": F.lit(1)})
    floats = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    agree(whiten(df, fit(df)), floats)
    other = df.union(spark.createDataFrame([(1000, [5.0])], DDL).selectExpr("*", "1", "'x'", "1"))
    agree(whiten(other, fit(other)), floats)  # another length than most


def test_fewer_components_than_dimensions(spark):
    draw = random.Random(2)
    rows = [(i, [float(a), float(b), float(a + b), 1.0]) for i, (a, b) in enumerate((draw.randrange(9), draw.randrange(9)) for _ in range(60))]
    df = spark.createDataFrame(rows, DDL)
    agree(whiten(df, fit(df)), rows)
    equal = spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], DDL)
    assert whiten(equal, fit(equal)).collect() == []
    nothing = spark.createDataFrame([(1, None)], DDL)
    assert fit(nothing) is None and whiten(nothing, None).collect() == [] and fit(nothing.limit(0)) is None
    assert whiten(nothing, None).dtypes == whiten(df, fit(df)).dtypes


def test_large_entries_stay_exact(spark):
    draw = random.Random(3)
    rows = [(i, [float(draw.randrange(-(2**33), 2**33)), float(draw.randrange(100)), float(draw.randrange(5))]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = fit(df, 2)
    got = {r.vec_id: r.deviation for r in whiten(df, model).collect()}
    want, _ = slowly(rows)
    assert got == {w[0]: w[2] if w[2] < 2**63 else None for w in want.values()}
    assert None in got.values() or max(got.values()) > 2**50
    assert whiten(spark.createDataFrame([(1, [1e300, 1.0, 2.0])], "vec_id long, embedding array<double>"), model).collect() == []


def test_packed_rows():
    z = np.array([[0, 127], [0, -128], [0, 128], [-32769, 1], [2**31, 0], [2**45, -(2**45)], [0, 127]])
    packed = pack(z)
    assert packed[0] == packed[6] and len(set(packed)) == 6 and [len(p) for p in packed] == [3, 3, 5, 9, 17, 17, 3]
    assert sorted(map(tuple, unpack(packed).tolist())) == sorted(map(tuple, z.tolist()))


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    agree(whitening.op11_whitening(spark, folder), rows)
