"""Importance resampling towards a target distribution: documents drawn in the proportion in which they look like the target's texts.

Words and runs of words are hashed into buckets. The corpus' and the target's counts by bucket give every bucket a gain, the logarithm of the
two smoothed frequencies' quotient; a document's weight is the sum of the gains of its features. The weight plus Gumbel noise, made from a hash
of the id, is the score, and the documents of highest score are a sample drawn without replacement in proportion to exp(weight). Counts
and gains are arrays of ``BUCKETS`` numbers; scores are ranked by ``radix_rank``.

Defined cases: a null, empty or wordless text has no features and weight 0. A null id is hashed as the empty text and comes last among equal scores.
Long texts are worked through in slices of ``SLICE`` bytes that end between words. Rows that share an id are scored and ranked each for
themselves; where score and id are equal, in the order in which they were read. An empty table gives an empty result, an empty target all gains
by its smoothing alone. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.llm.common import Emitter, id_and_text, read, rows_of
from ribeira.llm.radix import radix_rank
from ribeira.session import materialize

BUCKETS = 10_000
LONGEST = 1
"""Words in the longest run that is a feature."""
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
SLICE = 1 << 20
REMEMBERED = 64 << 20
"""Bytes of features whose buckets a worker remembers."""

COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])

_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B))
_FOLD = bytes(b if b in _LETTERS or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def word_slices(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of those of about ``size`` bytes."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class Buckets(dict):
    """Feature -> bucket, remembered up to a number of bytes."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets, self.bytes = buckets, 0

    def __missing__(self, feature: bytes) -> int:
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        self.bytes += len(feature) + 120
        return bucket

    def trim(self) -> None:
        if self.bytes > REMEMBERED:
            self.clear()
            self.bytes = 0


def features(text: bytes, known: Buckets, longest: int, size: int = SLICE) -> Iterator[tuple[int, np.ndarray]]:
    """For each slice of a text: its number of words and the buckets of the runs that end in it."""
    tail: list[bytes] = []
    for words in word_slices(text, size):
        found = list(map(known.__getitem__, words))
        joined = tail + words
        for length in range(2, longest + 1):
            first = max(0, len(tail) - length + 1)
            found += [known[b" ".join(joined[at : at + length])] for at in range(first, len(joined) - length + 1)]
        tail = joined[max(0, len(joined) - longest + 1) :] if longest > 1 else []
        known.trim()
        yield len(words), np.array(found, np.int64)


def _counts(buckets: int, longest: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = Buckets(buckets), np.zeros(buckets, np.int64)
        for (text,) in rows_of(batches):
            for _, found in features(text, known, longest):
                np.add.at(sums, found, 1)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], schema=COUNTS)

    return run


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """The features of all texts by bucket: tasks add up their own, at most ``buckets`` rows reach the driver."""
    rows = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    sums = np.zeros(buckets, np.int64)
    for bucket, n in rows.mapInArrow(_counts(buckets, longest), "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        sums[bucket] = n
    return sums


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of target over corpus frequency of every bucket, one added to each count, rounded down."""
    size, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    quotients = [(t + 1) * float(all_corpus + size) / ((s + 1) * float(all_target + size)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(q)) for q in quotients], np.int64)


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """1000 times a Gumbel variate made from the id, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(gain: np.ndarray, longest: int, seed: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = Buckets(len(gain)), Emitter(SCORES)
        for doc_id, text in rows_of(batches):
            words = n = weight = 0
            for count, found in features(text, known, longest):
                words, n, weight = words + count, n + len(found), weight + int(gain[found].sum())
            yield from out.add((doc_id, words, n, weight, weight + noise(doc_id, seed)), 80)
        yield from out.flush()

    return run


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document; counts both tables first (two jobs)."""
    gain = gains(bucket_counts(docs, buckets=buckets, longest=longest), bucket_counts(target, buckets=buckets, longest=longest))
    return id_and_text(docs).mapInArrow(_scores(gain, longest, seed), "doc_id long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, longest: int = LONGEST, seed: str = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: of the documents with enough words, ``percent`` % are drawn and have a rank."""
    rows = materialize(scored(docs, target, buckets, longest, seed), "importance")
    enough = F.col("n_words") >= least_words
    drawn = percent * rows.where(enough).count() // 100
    ranked = radix_rank(rows.where(enough), [("score", False), ("doc_id", True)])
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).union(
        rows.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank"))
    )


def op13_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
