"""Document quality by ordinal regression on graded ratings.

A cumulative-link model: ``P(grade > k) = sigmoid(w . x - c_k)`` with one weight vector over hashed text features for all
grades and ordered cut points ``c_0 < c_1 < …``. It gives the expected grade and, for selection, the probability of at least a
chosen grade.

Features are means over a text's words: the lower-cased word, its shape (runs of capitals, small letters, digits and each
sign, as ``Aa!!``) and whether it repeats the word before, hashed into ``2 ** HASH_BITS`` numbers. Ratings are joined to the
texts; the training sample is bounded: ``RATED`` documents, those whose ids hash lowest.

Defined cases: a null or empty text has no features, so it gets what the cut points alone say. Ratings that repeat an id count with the
lowest grade; null ratings are left out. Without ratings, or with a single grade, every document has that grade (0 without any).
A null ``doc_id`` is scored, never learned from, and ``held_out`` is null. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.llm.common import Emitter, id_and_text, read, rows_of
from ribeira.llm.learning import Adam, Ragged, gather, remainder, sample, sigmoid
from ribeira.session import materialize

HASH_BITS = 18
RATED = 6000
ROUNDS = 150
REMEMBERED = 400_000
PIECE = 1 << 20
REPEAT = 0
"""The feature of a word that repeats the one before it."""
FEATURES = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.int32())), ("counts", pa.list_(pa.float32()))])
SHAPE = bytes.maketrans(
    bytes(range(256)),
    bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b > 127 else ord("0") if 48 <= b <= 57 else b for b in range(256)),
)
RUNS = re.compile(rb"([A-Za-z0-9])\1+|(.)\2{2,}", re.S)


def number(kind: bytes, what: bytes) -> int:
    return 1 + zlib.crc32(kind + what) % ((1 << HASH_BITS) - 1)


def numbers_of(word: bytes) -> tuple[int, int]:
    shape = RUNS.sub(lambda m: (m[1] or m[2] * 3), word.translate(SHAPE))
    return number(b"w", word.lower()), number(b"s", shape)


def chunks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in parts of about ``PIECE`` bytes that end between words."""
    if len(text) <= PIECE:
        yield text.split()
        return
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[at:end].split()
        at = end


class Reader:
    """Turns words into feature numbers and remembers them."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for word in set(words).difference(known):
            known[word] = numbers_of(word)
        return np.array(list(map(known.__getitem__, words)), np.int32).reshape(-1, 2)

    def parts(self, text: bytes) -> Iterator[tuple[np.ndarray, int]]:
        """For each part of a text: the numbers of its words, and how many words repeat the one before."""
        last = None
        for words in chunks(text):
            if words:
                numbers = self.numbers(words)
                repeats = int((numbers[1:, 0] == numbers[:-1, 0]).sum()) + (last == numbers[0, 0])
                last = numbers[-1, 0]
                yield numbers, repeats


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, out = Reader(), Emitter(FEATURES)
    for doc_id, text in rows_of(batches):
        total, words = np.zeros(1 << HASH_BITS, np.float32), 0
        for numbers, repeats in reader.parts(text):
            total += np.bincount(numbers.ravel(), minlength=len(total))
            total[REPEAT] += repeats
            words += len(numbers)
        met = np.flatnonzero(total)
        yield from out.add((doc_id, met.tolist(), (total[met] / max(words, 1)).tolist()), 8 * len(met))
    yield from out.flush()


def train(rows: Ragged, grades: np.ndarray, rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cut points of greatest likelihood. The gaps between cut points are exponentials, so their order holds."""
    top, size = int(grades.max()), 1 << HASH_BITS
    share = np.clip([(grades > k).mean() for k in range(top)], 1e-3, 1 - 1e-3)
    cuts = -np.log(share / (1 - share))
    free = np.append(cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2)))
    weights = np.zeros(size)
    adam, adam_cuts = Adam(size, rate), Adam(top, 0.05)
    balance = 1 / np.bincount(grades, minlength=top + 1)[grades]
    balance /= balance.sum()
    for _ in range(rounds):
        cuts = np.cumsum(np.append(free[:1], np.exp(free[1:])))
        z = rows.dot(weights)
        above = np.column_stack([np.ones(len(z)), sigmoid(z[:, None] - cuts), np.zeros(len(z))])  # P(grade >= k)
        every = np.arange(len(z))
        low, high = above[every, grades], above[every, grades + 1]
        chance = np.maximum(low - high, 1e-9)
        slope_low, slope_high = low * (1 - low), high * (1 - high)
        row = -balance * (slope_low - slope_high) / chance
        g_cuts = np.zeros(top)
        np.add.at(g_cuts, grades[grades > 0] - 1, (balance * slope_low / chance)[grades > 0])
        np.add.at(g_cuts, grades[grades < top], (-balance * slope_high / chance)[grades < top])
        g_free = np.array([g_cuts.sum(), *(g_cuts[k:].sum() * np.exp(free[k]) for k in range(1, top))])
        weights -= adam.step(rows.back(row, size) + decay * weights)
        free -= adam_cuts.step(g_free)
    return weights, np.cumsum(np.append(free[:1], np.exp(free[1:])))


def fit(docs: DataFrame, ratings: DataFrame, learn=None) -> tuple[np.ndarray, np.ndarray]:
    """A model from ``ratings(doc_id, grade)``, grades 0, 1, …, and the texts of ``docs``, where ``learn`` (a condition on doc_id) holds."""
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("doc_id is not null and grade >= 0")
    if learn is not None:
        rated = rated.where(learn)
    chosen = sample(rated.groupBy("doc_id").agg(F.min("grade").alias("grade")), RATED)
    found = gather(docs, chosen, _features, "features array<int>, counts array<float>")
    grades = found["grade"].to_numpy().astype(np.int64)
    if not len(grades) or grades.min() == grades.max():
        only = int(grades[0]) if len(grades) else 0
        return np.zeros(1 << HASH_BITS, np.float32), np.array([-50.0] * only + [50.0])
    weights, cuts = train(Ragged(found["features"], found["counts"]), grades)
    return weights.astype(np.float32), cuts


def _grades(model, least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = model.value
        reader, out = Reader(), Emitter(pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail", pa.float64())]))
        for doc_id, text in rows_of(batches):
            total, words = 0.0, 0
            for numbers, repeats in reader.parts(text):
                total += float(weights[numbers].sum(dtype=np.float64)) + float(weights[REPEAT]) * repeats
                words += len(numbers)
            above = sigmoid(total / max(words, 1) - cuts)
            yield from out.add((doc_id, float(above.sum()), float(above[least - 1]) if least <= len(above) else 0.0))
        yield from out.flush()

    return run


def grade(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], least: int = 1) -> DataFrame:
    """``doc_id, expected_grade, tail`` of every whole text; ``tail`` is the probability of grade ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return id_and_text(docs).mapInArrow(_grades(shared, least), "doc_id long, expected_grade double, tail double")


def ratings_of(labels: DataFrame) -> DataFrame:
    """Three grades: 0 low quality, 1 good but toxic, 2 good."""
    good, toxic = F.col("quality").cast("int"), F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    return labels.select("doc_id", F.when(good == 1, F.when(toxic == 1, 1).otherwise(2)).when(good == 0, 0).alias("grade"))


def keep_good(docs: DataFrame, ratings: DataFrame, least: int = 1, chance: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a grade of ``least`` or more at a probability of ``chance``, with all their columns.

    Rows that share an id stay or go together: they go if one of them is rejected.
    """
    verdict = materialize(grade(docs, fit(docs, ratings), least), "grades")
    rejected = verdict.where(F.col("tail") < chance).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(rejected, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")), "left_anti")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = fit(docs, ratings_of(read(spark, folder, "labels")), remainder(5) != 0)
    return grade(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "expected_grade", "tail", (F.col("tail") >= 0.5).alias("selected"))
