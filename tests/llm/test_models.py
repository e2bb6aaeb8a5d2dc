"""The trained operators: gradients, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ribeira.llm import language, quality, toxicity
from ribeira.llm.learning import Ragged, remainder

FOLDER = "/root/testdata/sf0.1"
ODD = [(-1, None), (-2, ""), (-3, " \n "), (-4, "1234 +-"), (-5, "word " * 300_000), (None, "some text"), (-6, "same"), (-6, "same")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def ragged(rows):
    return Ragged(pa.chunked_array([pa.array([list(r) for r in rows], pa.list_(pa.int32()))]))


def with_odd(spark, docs):
    return docs.select("doc_id", "text").limit(50).union(spark.createDataFrame(ODD, "doc_id long, text string")).withColumns({"score": F.lit("x"), "held_out": F.lit(1)})


def test_remainder_is_of_the_id_as_text(spark):
    rows = spark.createDataFrame([(7,), (-1,), (10**12,), (None,)], "doc_id long").select("doc_id", remainder(5).alias("r")).collect()
    assert [r.r for r in rows] == [zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows[:3]] + [None]


# Toxicity


def test_unlabelled_positives_do_not_hide_the_signal():
    draw = random.Random(1)
    common = lambda: {draw.randrange(100) for _ in range(20)}
    positive = [{*common(), 200 + draw.randrange(3)} for _ in range(300)]
    unlabelled = [common() | ({200 + draw.randrange(3)} if draw.random() < 0.2 else set()) for _ in range(2000)]
    weights, bias = toxicity.train(ragged(positive), ragged(unlabelled), 0.2)
    assert all(weights[f] + bias > 0 for f in (200, 201, 202)) and bias < 0


def test_toxicity_on_held_out_rows(spark, docs, labels):
    model = toxicity.fit(docs, labels, remainder(5) != 0)
    got = toxicity.score(docs, model).join(labels, "doc_id").where(remainder(5) == 0).select("score", "toxic").toPandas()
    hit = got.score >= 0.5
    assert hit[got.toxic == 1].mean() > 0.85 and hit[got.toxic == 0].mean() < 0.02
    odd = toxicity.score(with_odd(spark, docs), model).collect()
    assert len(odd) == 50 + len(ODD) and all(0 <= r.score <= 1 for r in odd)


def test_toxicity_without_labels(spark, docs, labels):
    none = toxicity.fit(docs.limit(50), labels.where("toxic = 7"), remainder(5) != 0)
    assert none is None and {r.score for r in toxicity.score(docs.limit(5), none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), none).collect() == []


# Quality


def test_cut_points_stay_in_order():
    draw = random.Random(2)
    grades = np.array([draw.choice([0, 0, 0, 1, 2, 3]) for _ in range(400)])
    rows = ragged([{1 + int(g), 9} for g in grades])
    weights, cuts = quality.train(rows, grades, rounds=200)
    assert (np.diff(cuts) > 0).all()
    above = 1 / (1 + np.exp(-(rows.dot(weights)[:, None] - cuts)))
    assert (above.sum(1).round() == grades).mean() > 0.95


def test_gradient_of_the_likelihood():
    rows, grades = ragged([{1, 2}, {2, 3}, {1, 3}]), np.array([0, 1, 2])
    before, cuts = quality.train(rows, grades, rounds=1, rate=0.01, decay=0)
    after, _ = quality.train(rows, grades, rounds=50, rate=0.01, decay=0)
    assert after[2] < after[1] < after[3]  # grades 0, 1, 2 have features 1+2, 2+3, 1+3
    assert abs(after).sum() > abs(before).sum() and len(cuts) == 2


def test_quality_on_held_out_rows(spark, docs, labels):
    model = quality.fit(docs, quality.ratings_of(labels), remainder(5) != 0)
    got = quality.grade(docs, model).join(labels, "doc_id").where(remainder(5) == 0).toPandas()
    good = got["tail"] >= 0.5
    assert good[got.quality == 1].mean() > 0.99 and good[got.quality == 0].mean() < 0.03
    odd = quality.grade(with_odd(spark, docs), model).collect()
    assert len(odd) == 50 + len(ODD) and all(0 <= r[2] <= 1 and 0 <= r.expected_grade <= 2 for r in odd)


def test_one_grade_or_none(spark, docs):
    for grades, want in (([], 0.0), ([(0, 1), (1, 1)], 1.0)):
        model = quality.fit(docs, spark.createDataFrame(grades, "doc_id long, grade int"))
        assert {round(r.expected_grade, 6) for r in quality.grade(docs.limit(3), model).collect()} == {want}


def test_rejected_rows_go(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER.removesuffix('1')}01/{t}.parquet") for t in ("documents", "labels"))
    rated = quality.ratings_of(labels)
    made = docs.join(labels.where("quality = 0").limit(20), "doc_id").select(*docs.columns).union(docs.limit(100))
    kept = quality.keep_good(made, rated)
    assert kept.columns == docs.columns and 60 < kept.count() < 101
    assert quality.keep_good(docs.limit(0), rated).collect() == []


# Language


def test_gradients_by_backpropagation_through_time():
    draw = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"], 3)
    codes, sizes, target = draw.integers(0, 256, (5, 7)), np.array([7, 7, 3, 5, 1]), np.array([0, 1, 2, 1, 0])

    def loss():
        chances = net.probabilities(net.forward(codes))[:, np.arange(5), target]
        return -(np.log(chances) * (np.arange(7)[:, None] < sizes)).sum() / sizes.sum()

    for values, slopes in zip([net.embed, net.loop, net.out, net.bias], net.gradients(codes, sizes, target)):
        for place in map(tuple, np.argwhere(slopes)[::17]):
            kept = values[place]
            values[place] = kept + 1e-5
            up = loss()
            values[place] = kept - 1e-5
            down = loss()
            values[place] = kept
            assert abs((up - down) / 2e-5 - slopes[place]) < 1e-7


def test_fast_layout_gives_the_same_probabilities():
    net, draw = language.Network(["a", "b"], 5), np.random.default_rng(1)
    texts = [bytes(draw.integers(1, 256, n, dtype=np.uint8)) for n in (1, 63, 64, 65, 400, 150_000)] + [b""]
    got = language.document_probabilities(texts, language.Labeller(net))
    for text, row in zip(texts[:-2], got):
        codes, sizes = language.segments(text)
        chances = net.probabilities(net.forward(codes)) * (np.arange(language.SEGMENT)[:, None] < sizes)[..., None]
        assert np.allclose(row, chances.sum((0, 1)) / len(text), atol=1e-5)
    assert got[-1].tolist() == [0, 0]


def test_language_on_held_out_rows(spark, docs):
    network = language.fit(docs, remainder(4) != 2)
    got = language.predict(docs, network).join(docs.select("doc_id", "lang"), "doc_id").where(remainder(4) == 2).toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.99
    odd = {(r.doc_id, r.lang_pred) for r in language.predict(with_odd(spark, docs), network).collect()}
    assert {(-1, "und"), (-2, "und"), (-3, "und"), (-4, "und"), (-5, "en")} <= odd


def test_language_without_training_rows(spark, docs):
    network = language.fit(docs.withColumn("lang", F.lit(None).cast("string")), remainder(4) != 2)
    assert {r.lang_pred for r in language.predict(docs.limit(5), network).collect()} == {"und"}
    assert language.predict(docs.limit(0), network).collect() == []
