"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic documents and unlabelled text train a linear classifier over hashed parts of words. The risk is
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with logistic loss: toxic texts among the unlabelled ones are
corrected for by the class prior, and where the second part falls below zero, its own descent is undone, so that the
classifier cannot learn the positives by heart. The prior is the share of toxic ones among all labelled training rows.

A document's features come from its distinct lower-cased words: each word and its 4-byte pieces, hashed into
``2 ** HASH_BITS`` numbers, counted once per word. Only numbers that at least ``RARE`` toxic training documents have, and
``LIFT`` times as large a share of them as of the unlabelled ones, get weights. The training sample is bounded: ``POSITIVES`` toxic
and ``UNLABELLED`` other documents, those whose ids hash lowest. The prior counts all labels.

Defined cases: a null or empty text scores like any text without known words. Labels that repeat an id count as toxic if one of
them does. Without a single toxic training row every score is 0. A null ``doc_id`` is scored, never learned from, and ``held_out`` is
null. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.llm.common import Emitter, id_and_text, read, rows_of
from ribeira.llm.learning import Adam, Ragged, gather, remainder, sample, sigmoid

HASH_BITS = 18
POSITIVES = 2000
UNLABELLED = 6000
RARE = 5
LIFT = 2.0
ROUNDS = 150
REMEMBERED = 400_000
WORD = re.compile(rb"[a-z0-9'\x80-\xff]+")
FEATURES = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.int32())), ("counts", pa.list_(pa.float32()))])
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def parts(word: bytes) -> list[int]:
    """Numbers of the word and of its 4-byte pieces, borders included."""
    marked = b"^" + word + b"$"
    pieces = {marked, *(marked[i : i + 4] for i in range(len(marked) - 3))}
    return [zlib.crc32(p) >> (32 - HASH_BITS) for p in pieces]


def words(text: bytes) -> set[bytes]:
    return set(WORD.findall(text.lower()))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Emitter(FEATURES)
    for doc_id, text in rows_of(batches):
        met = Counter(n for word in words(text) for n in parts(word))
        yield from out.add((doc_id, list(met.keys()), list(map(float, met.values()))), 8 * len(met))
    yield from out.flush()


def train(positive: Ragged, unlabelled: Ragged, prior: float, rounds: int = ROUNDS, rate: float = 0.1, decay: float = 2e-6) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk."""
    size = 1 << HASH_BITS
    toxic, usual = (np.bincount(rows.numbers, minlength=size) for rows in (positive, unlabelled))
    telling = (toxic >= RARE) & (toxic / positive.n >= LIFT * usual / unlabelled.n)
    for rows in (positive, unlabelled):
        rows.keep(telling)
    weights, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    adam = Adam(size + 1, rate)
    for _ in range(rounds):
        p, u = positive.dot(weights) + bias, unlabelled.dot(weights) + bias
        # logistic loss: softplus(-z) for +, softplus(z) for -
        negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        g_plus = prior * (sigmoid(p) - 1) / positive.n
        g_u, g_p = sigmoid(u) / unlabelled.n, -prior * sigmoid(p) / positive.n
        if negative < 0:
            row_p, row_u = -g_p, -g_u
        else:
            row_p, row_u = g_plus + g_p, g_u
        gradient = positive.back(row_p, size) + unlabelled.back(row_u, size) + decay * weights
        step = adam.step(np.append(gradient, row_p.sum() + row_u.sum()))
        weights -= step[:-1]
        bias -= step[-1]
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, learn, prior: float | None = None) -> tuple[np.ndarray, float] | None:
    """A classifier from ``labels(doc_id, toxic)`` and the texts of ``docs``, both only where ``learn`` (a condition on doc_id) holds."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(learn)
    if prior is None:
        share = marks.where("toxic is not null").agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
        prior = min(max(share or 0.0, 1e-4), 0.9)
    toxic = sample(marks.where("toxic = 1").select("doc_id"), POSITIVES).withColumn("toxic", F.lit(1))
    others = sample(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(learn), UNLABELLED).withColumn("toxic", F.lit(0))
    found = gather(docs, toxic.union(others).groupBy("doc_id").agg(F.sum("toxic").alias("positive"), F.min("toxic").alias("only")), _features, "features array<int>, counts array<float>")
    positive = found.filter(pa.compute.equal(found["positive"], 1))
    unlabelled = found.filter(pa.compute.equal(found["only"], 0))
    if not positive.num_rows or not unlabelled.num_rows:
        return None
    weights, bias = train(*(Ragged(t["features"], t["counts"]) for t in (positive, unlabelled)), prior)
    return weights.astype(np.float32), bias


def _scores(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(SCORES)
        weights, bias = model.value or (None, 0.0)
        known: dict[bytes, float] = {}
        for doc_id, text in rows_of(batches):
            if weights is None:
                yield from out.add((doc_id, 0.0))
                continue
            mine = words(text)
            if len(known) >= REMEMBERED:
                known.clear()
            for word in mine.difference(known):
                known[word] = float(weights[parts(word)].sum())
            total = math.fsum(map(known.__getitem__, mine)) + bias  # exact, so that the order of a set doesn't matter
            yield from out.add((doc_id, float(sigmoid(np.float64(total)))))
        yield from out.flush()

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """``doc_id, score`` of every whole text. The model has a fixed size (1 MB)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return id_and_text(docs).mapInArrow(_scores(shared), "doc_id long, score double")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = fit(docs, read(spark, folder, "labels"), remainder(5) != 0)
    return score(docs, model).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
