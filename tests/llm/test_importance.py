"""Importance resampling and its radix sort, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ribeira.llm import importance
from ribeira.llm.importance import bucket_counts, resample, word_slices
from ribeira.llm.radix import radix_rank

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, longest):
    words = WORD.findall((text or "").translate(UPPER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def slowly(docs, target, percent=10, least=20, buckets=10_000, longest=1):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, text in table for f in runs(text, longest)[1]) for table in (docs, target))
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        words, found = runs(text, longest)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((words, doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1]))
    drawn = [(*r[1:], rank) for rank, r in enumerate(able[: percent * len(able) // 100], 1)]
    return sorted(drawn + [(*r[1:], None) for r in able[len(drawn) :]] + [(*r[1:], None) for r in rows if r[0] < least], key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(n, seed=4):
    draw = random.Random(seed)
    words = [*"the of and to in a is that it was for on are as with his they I at be THIS have from".split(), "é", "naïve", "x1", "Ünder", "日本"]
    return [(i * 7 - 300, " ".join(draw.choice(words) + draw.choice(["", ",", ".", " -", "\n"]) for _ in range(draw.randrange(0, 90)))) for i in range(n)]


def test_rows_against_brute_force(documents, spark):
    docs = made(400) + [(9001, None), (9002, ""), (9003, " \n "), (9004, "word " * 30_000), (None, "some text " * 20), (9005, "same " * 25), (9005, "same " * 25)]
    target = [(1, "the naïve x1 x1 日本 was that"), (2, None), (3, "of of of")]
    table = spark.createDataFrame(target, "item_id long, text string")
    assert collected(resample(documents(docs, extra=True), table)) == slowly(docs, target)
    assert collected(resample(documents(docs), table, percent=50, least_words=3, buckets=97, longest=3)) == slowly(docs, target, 50, 3, 97, 3)
    assert collected(resample(documents(docs), table.limit(0), percent=100)) == slowly(docs, [], 100)


def test_no_documents(documents, spark):
    target = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resample(documents([]), target).collect() == []
    assert collected(resample(documents([(1, "too short")]), target)) == slowly([(1, "too short")], [(1, "a b")])


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs, target = ([tuple(r)[:2] for r in spark.read.parquet(f"{folder}/{t}.parquet").collect()] for t in ("documents", "benchmark"))
    assert collected(importance.op13_resample(spark, folder)) == slowly(docs, target)


def test_slices_end_between_words():
    text = " ".join(str(n) for n in range(5000)).encode()
    parts = list(word_slices(text, 100))
    assert len(parts) > 100 and [w for p in parts for w in p] == text.split()
    assert [w for p in word_slices(b"A" * 5000, 100) for w in p] == [b"a" * 5000] and list(word_slices(b"", 5)) == []
    known = importance.Buckets(50)
    whole, cut = (Counter(b for _, found in importance.features(text, known, 3, size) for b in found.tolist()) for size in (1 << 20, 64))
    assert whole == cut and whole.total() == 3 * 5000 - 3


def test_memory_of_features_is_bounded(monkeypatch):
    monkeypatch.setattr(importance, "REMEMBERED", 10_000)
    known = importance.Buckets(10)
    for n in range(50):
        list(importance.features(" ".join(f"{n}x{i}" for i in range(50)).encode(), known, 1))
        assert known.bytes <= 10_000


def test_counts_by_bucket(documents):
    docs = made(100)
    want = Counter(zlib.crc32(f.encode()) % 64 for _, t in docs for f in runs(t, 2)[1])
    assert bucket_counts(documents(docs), buckets=64, longest=2).tolist() == [want[b] for b in range(64)]


@pytest.mark.parametrize("bits, block", [(1, 3), (4, 16), (11, 1 << 14)])
def test_radix_ranks(spark, bits, block):
    draw = random.Random(bits)
    low, high = -(2**63), 2**63 - 1
    wide = [draw.choice([low, high, 0, -1, None, draw.randrange(low, high)]) for _ in range(60)] if bits > 1 else [draw.choice([None, 3, 9]) for _ in range(60)]
    rows = [(draw.randrange(3), w, i) for i, w in enumerate(wide)]
    df = spark.createDataFrame(rows, "a long, b long, id long").repartition(3).cache()
    got = sorted(radix_rank(df, [("a", False), ("b", True), ("id", True)], bits, block).collect(), key=lambda r: r.rank)
    want = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    assert [tuple(r)[:3] for r in got] == want and [r["rank"] for r in got] == list(range(1, 61))


def test_equal_keys_and_blocks(spark):
    rows = spark.range(1000).selectExpr("id div 400 AS k", "id").cache()
    got = radix_rank(rows, [("k", True)], block=64).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 1001))
    assert np.all(np.diff([r.k for r in sorted(got, key=lambda r: r["rank"])]) >= 0)
    assert radix_rank(rows.limit(0), [("k", True)]).collect() == []
