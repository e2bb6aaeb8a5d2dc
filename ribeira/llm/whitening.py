"""Whitening of embeddings: leading principal components of unit variance.

Entries are fixed-point numbers, x = floor(64 c) + 1000000, so that counts, sums and products are exact whatever the order of the rows. The
fit list, each distinct x vector once, is a table in the shared work folder. Sums over it give the centre; products of the
centred vectors give the covariance, summed exactly by tasks and then by Spark, with one row for each pair of dimensions on the driver. Its leading
eigenpairs are found by spectrum slicing (``spectrum.py``), and a last pass over the fit list measures how far the covariance of the
whitened vectors is from the identity.

The driver holds a few matrices of d × d for vectors of d entries, whatever the number of rows.

Defined cases: a vector that is null or empty, or has null or non-finite entries, or entries of ``LARGEST`` and more, is left out. So is one whose length isn't
the most frequent one in the fit list (the greatest of these). A null id stays null, repeated rows give repeated results. A deviation
beyond the range of a long is null. There are fewer components where the covariance has fewer eigenvalues above rounding, none
if all vectors are equal. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.llm.common import read
from ribeira.llm.spectrum import leading
from ribeira.session import materialize

SCALE = 64
OFFSET = 1_000_000
"""Added to every x. It cancels wherever vectors are centred, so z = x - OFFSET is what is stored and summed."""
LARGEST = 2.0**40
COMPONENTS = 16
ROWS = 2048
"""Vectors worked through at a time."""

FIT = pa.schema([("size", pa.int32()), ("vector", pa.binary())])
SUMS = pa.schema([("at", pa.int64()), ("value", pa.decimal128(38, 0))])
PRODUCTS = pa.schema([("at", pa.int64()), ("value", pa.float64())])
WHITENED = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
)


def fixed_point(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the rows whose vectors count, and their z as a matrix of longs."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        entries = values[offsets[rows][:, None] + np.arange(size)].astype(np.float64)
        good = (np.abs(entries) < LARGEST).all(1)  # false for NaN, which nulls have become
        yield rows[good], np.floor(SCALE * entries[good]).astype(np.int64)


def pack(z: np.ndarray) -> list[bytes]:
    """Each row as bytes, in the narrowest integers that hold it: equal rows, and no others, give equal bytes."""
    out: list[bytes] = [b""] * len(z)
    reach = np.maximum(z.max(1), ~z.min(1))
    widths = np.select([reach < 1 << 7, reach < 1 << 15, reach < 1 << 31], [1, 2, 4], 8)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        flat, step = z[rows].astype(f"<i{width}").tobytes(), width * z.shape[1]
        for at, row in enumerate(rows.tolist()):
            out[row] = bytes([width]) + flat[at * step : (at + 1) * step]
    return out


def unpack(vectors: list[bytes]) -> np.ndarray:
    by_width: dict[int, list[bytes]] = {}
    for v in vectors:
        by_width.setdefault(v[0], []).append(v[1:])
    return np.vstack([np.frombuffer(b"".join(rows), f"<i{width}").reshape(len(rows), -1).astype(np.int64) for width, rows in by_width.items()])


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield batch.slice(low, ROWS)


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        for _, z in fixed_point(pa.concat_arrays([batch.column(0)])):
            if len(z):
                yield pa.RecordBatch.from_arrays([pa.array([z.shape[1]] * len(z), pa.int32()), pa.array(pack(z), pa.binary())], schema=FIT)


def exact_products(y: np.ndarray) -> np.ndarray:
    """yᵀy of a matrix of longs in Python's integers, by floating point where no partial sum can be rounded."""
    reach = int(np.abs(y).max(initial=0))
    if reach * reach * len(y) < 1 << 53:
        y = y.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def _emit_exact(total: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    at, value = zip(*total)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([Decimal(int(v)) for v in value], pa.decimal128(38, 0))], schema=SUMS)


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, 0
    for batch in _slices(batches):
        if batch.num_rows:
            z = unpack(batch.column(0).to_pylist())
            n, total = n + len(z), total + z.sum(0).astype(object)
    if n:
        yield _emit_exact([(-1, n), *enumerate(total)])


def _products(centre: list[int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, middle = None, np.array(centre, np.int64)
        for batch in _slices(batches):
            if batch.num_rows:
                part = exact_products(unpack(batch.column(0).to_pylist()) - middle)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(middle))
            yield _emit_exact(zip((i * len(middle) + j).tolist(), total[i, j]))

    return run


@dataclass(frozen=True)
class Whitening:
    """n, the sums of z and the components; ``projection`` has a column for each of them, divided by the root of its eigenvalue."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def scaled(self, z: np.ndarray) -> np.ndarray:
        """n z - S, exact: longs where they fit, Python's integers otherwise."""
        centre = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        y = z - centre
        if self.n * (int(np.abs(y).max(initial=0)) + 1) < 1 << 62:
            return self.n * y - np.array(rest, np.int64)
        return self.n * y.astype(object) - np.array(rest, object)

    def whiten(self, scaled: np.ndarray) -> np.ndarray:
        return (scaled / self.n).astype(np.float64) @ self.projection

    @staticmethod
    def deviation(scaled: np.ndarray) -> list[int | None]:
        reach = max(-int(scaled.min(initial=0)), int(scaled.max(initial=0)))
        if reach * reach * scaled.shape[1] < 1 << 63:
            return (scaled * scaled).sum(1).tolist()
        return [d if d < 1 << 63 else None for d in (scaled.astype(object) ** 2).sum(1).tolist()]


def _spread(model: Whitening):
    """Sums and products of the whitened vectors of the fit list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.projection.shape[1]
        total, products, any_row = np.zeros(k), np.zeros((k, k)), False
        for batch in _slices(batches):
            if batch.num_rows:
                w = model.whiten(model.scaled(unpack(batch.column(0).to_pylist())))
                total, products, any_row = total + w.sum(0), products + w.T @ w, True
        if any_row:
            values = np.concatenate([total, products.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], schema=PRODUCTS)

    return run


def _whitened(model: Whitening):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, k = model.projection.shape
        for batch in _slices(batches):
            ids = batch.column(0)
            for rows, z in fixed_point(pa.concat_arrays([batch.column(1)])):
                if z.shape[1] == d and len(z):
                    scaled = model.scaled(z)
                    each = np.repeat(np.arange(len(z)), k)
                    columns = [
                        ids.take(pa.array(rows[each])), np.tile(np.arange(1, k + 1, dtype=np.int32), len(z)), np.full(len(each), model.n),
                        pa.array(model.deviation(scaled), pa.int64()).take(pa.array(each)), model.whiten(scaled).ravel(),
                        np.tile(model.explained, len(z)), np.full(len(each), model.identity_error),
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, WHITENED)], schema=WHITENED)

    return run


def _vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def covariance(n: int, sums: list[int], products: dict[int, int]) -> np.ndarray:
    """From exact sums, and products about ``sums // n``: each entry is the exact value's nearest double."""
    d = len(sums)
    rest = [s % n for s in sums]
    out = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = (n * products[i * d + j] - rest[i] * rest[j]) / (n * n)
    return out


def fit(embeddings: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct fixed-point vectors (four jobs over the list of these); None where there is no vector."""
    fits = materialize(_vectors(embeddings).select("embedding").mapInArrow(_packed, "size int, vector binary").distinct(), "fit-list")
    frequent = fits.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if frequent is None:
        return None
    d = frequent["size"]
    vectors = fits.where(F.col("size") == d).select("vector")

    def exact(function) -> dict[int, int]:
        return {r["at"]: int(r["value"]) for r in vectors.mapInArrow(function, "at long, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value")).collect()}

    found = exact(_sums)
    n, sums = found[-1], [found[i] for i in range(d)]
    matrix = covariance(n, sums, exact(_products([s // n for s in sums])))
    values, axes = leading(matrix, components)
    if not len(values):
        return Whitening(n, sums, np.zeros((d, 0)), values)
    model = Whitening(n, sums, axes.T / np.sqrt(values), values / np.trace(matrix))
    k = len(values)
    spread = np.zeros(k + k * k)
    for at, value in vectors.mapInArrow(_spread(model), "at long, value double").groupBy("at").agg(F.sum("value")).collect():
        spread[at] = value / n
    error = np.abs(spread[k:].reshape(k, k) - np.outer(spread[:k], spread[:k]) - np.eye(k)).max()
    return Whitening(n, sums, model.projection, model.explained, float(error))


def whiten(embeddings: DataFrame, model: Whitening | None) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector that counts and each component."""
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], ddl)
    return _vectors(embeddings).mapInArrow(_whitened(model), ddl)


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    return whiten(vectors, fit(vectors))
