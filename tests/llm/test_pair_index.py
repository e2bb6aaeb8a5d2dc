"""BPE by the pair occurrence index: the same ids as the tokenizers library, round trips, odd rows."""

import copy
import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ribeira.llm import pair_index
from ribeira.llm.pair_index import VOCABULARY, Known, PairIndex, decode, encode, pair_index_digests

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def bpe():
    return PairIndex.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    draw = random.Random(5)
    kinds = [(32, 127), (32, 0x3000), (0x4E00, 0x9FFF), (0x1F300, 0x1F700), (32, 33), (10, 11), (97, 99)]
    mixed = ["".join(chr(draw.randrange(*draw.choice(kinds))) for _ in range(200)) for _ in range(80)]
    special = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|><|endoftext|", "x  <|endoftext|>  y"]
    odd = ["", " ", "a" * 3000, "ab" * 900, " " * 900, "é" * 600, "the\u0085x   y", "The  end.\n\n", "don't DON'T we'll", "a\x1c b\x1fc", "�", "0x1234567890"]
    return mixed + special + odd


def ids_of(bpe, text):
    pieces = list(bpe.pieces(text))
    return np.frombuffer(b"".join(map(Known(bpe).learn(set(pieces)).__getitem__, pieces)), "<u4").tolist()


def test_same_ids_as_the_library(bpe, library):
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(bpe, text) == want, text[:60]
        assert bpe.decode(want).decode() == library.decode(want, skip_special_tokens=False)


def test_pieces_of_every_character(bpe, library):
    """Also of those that the library's Unicode version doesn't know."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(every), 3000):
        text = "".join(f"a{c}b 1{c}2 -{c}- " for c in every[low : low + 3000])
        want = ["".join(text[a:b]) for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert list(bpe.pieces(text)) == want, hex(low)


def test_overlapping_pairs_are_merged_from_the_left(bpe, library):
    for n in range(1, 40):
        for unit in ("a", "ab", "aab", "-", "=", "\n", "0"):
            assert ids_of(bpe, unit * n) == library.encode(unit * n, add_special_tokens=False).ids


def test_one_index_over_many_pieces(bpe):
    draw = random.Random(1)
    pieces = ["".join(draw.choice("aeinrst ") for _ in range(draw.randrange(1, 30))) for _ in range(3000)]
    assert bpe.merge([p.encode() for p in pieces]) == [bpe.merge([p.encode()])[0] for p in pieces]


def test_vocabularies_that_the_order_does_not_fit_are_refused():
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    late = copy.deepcopy(spec)
    late["model"]["merges"][0], late["model"]["merges"][-1] = late["model"]["merges"][-1], late["model"]["merges"][0]
    with pytest.raises(ValueError, match="does not come after"):
        PairIndex(late)
    with pytest.raises(ValueError, match="plain byte-level"):
        PairIndex(spec | {"normalizer": {"type": "Lowercase"}})


def test_memory_is_bounded_by_bytes(bpe):
    known = Known(bpe, limit=100_000)
    for i in range(200):
        known.learn({f"{i}" * 400})
        assert known.bytes < 100_000 + 200 + 8 * 400 * 3


def digests(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out)


def test_digests_of_whole_texts(documents, library, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None), (3, "again"), (901, "word é<|endoftext|> " * 60_000), (902, "ab" * 400_000), (7, "same"), (7, "same")]
    got = sorted(tuple(r) for r in pair_index_digests(documents(rows, extra=True)).collect())
    assert got == digests(library, rows)
    assert pair_index_digests(documents([])).collect() == []
    assert [tuple(r) for r in pair_index_digests(documents([(None, "a b")])).collect()] == [(None, *digests(library, [(0, "a b")])[0][1:])]


def test_round_trip(documents, spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(500, "long text " * 70_000)]
    assert sorted(tuple(r) for r in decode(encode(documents(rows))).collect()) == rows
    odd = spark.createDataFrame([(1, [64, None, 999_999, 50256]), (2, None), (3, []), (4, [188, 222])], "doc_id long, ids array<int>")
    assert sorted(tuple(r) for r in decode(odd).collect())[:3] == [(1, "a<|endoftext|>"), (2, ""), (3, "")]


def test_whole_table_as_the_library_has_it(spark, library):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in pair_index.op12_bpe(spark, folder).collect()) == digests(library, rows)
