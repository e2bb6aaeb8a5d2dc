"""Bounded training samples, and sums over ragged rows of feature numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribeira.llm.common import id_and_text
from ribeira.session import materialize


def remainder(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``. A null id gives null."""
    return F.crc32(F.col(doc_id).cast("long").cast("string")) % n


def sample(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct rows of ``ids``, the same ones on every run: those whose ids hash lowest."""
    return ids.distinct().orderBy(F.xxhash64("doc_id"), *ids.columns).limit(most)


def gather(docs: DataFrame, chosen: DataFrame, features, ddl: str) -> pa.Table:
    """The features of the chosen documents' texts on the driver: ``doc_id``, ``ddl`` and the columns of ``chosen``.

    The choice is written out first: its size is then known, and a small one is broadcast, so that no text is shuffled.
    """
    chosen, first = materialize(chosen, "chosen"), ddl.split()[0]
    texts = id_and_text(docs).join(chosen.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    return texts.mapInArrow(features, "doc_id long, " + ddl).join(chosen, "doc_id").orderBy("doc_id", first).toArrow()


class Ragged:
    """Rows of feature numbers with values, laid end to end."""

    def __init__(self, lists: pa.ChunkedArray, values: pa.ChunkedArray | None = None):
        lists = lists.combine_chunks()
        self.numbers = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy())
        self.rows = np.repeat(np.arange(len(sizes)), sizes)
        self.values = np.ones(len(self.numbers), np.float32) if values is None else values.combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.n = len(sizes)

    def keep(self, known: np.ndarray) -> None:
        """Leaves out the features that ``known`` (by feature) marks false."""
        mask = known[self.numbers]
        self.numbers, self.rows, self.values = self.numbers[mask], self.rows[mask], self.values[mask]

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * weights[self.numbers], self.n)

    def back(self, per_row: np.ndarray, size: int) -> np.ndarray:
        """The gradient by weight, given the gradient by row."""
        return np.bincount(self.numbers, self.values * per_row[self.rows], size)


class Adam:
    def __init__(self, size: int, rate: float):
        self.rate, self.m, self.v, self.t = rate, np.zeros(size), np.zeros(size), 0

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
