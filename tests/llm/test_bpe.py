import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ribeira.llm.bpe import VOCABULARY, ByteBPE, decode, encode, token_digests


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE.load(public_tokenizers.path(VOCABULARY))


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def texts():
    draw = random.Random(3)
    kinds = [(32, 127), (32, 0x3000), (0x4E00, 0x9FFF), (0x1F300, 0x1F700), (32, 33), (10, 11)]
    mixed = ["".join(chr(draw.randrange(*draw.choice(kinds))) for _ in range(200)) for _ in range(60)]
    return [*mixed, "", " ", "a" * 2000, "abc" * 700, " " * 900, "é" * 600, "<|endoftext|>", "the\u0085x   y", "The  end.\n\n"]


def test_same_ids_as_the_library(bpe, library):
    for text in texts():
        assert bpe.encode(text) == library.encode_ordinary(text), text[:50]
        assert bpe.decode(bpe.encode(text)) == text.encode()


def test_long_text_in_parts(bpe, library):
    text = "Some words and 123 numbers, repeated. " * 20_000
    assert bpe.encode(text) == library.encode_ordinary(text)


def test_digests_of_whole_texts(documents, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None), (3, "again"), (901, "word " * 150_000)]
    want = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = sorted(tuple(r) for r in token_digests(documents(rows, extra=True)).collect())
    assert got == sorted(want)
    assert token_digests(documents([])).collect() == []


def test_round_trip(documents):
    rows = [(i, t) for i, t in enumerate(texts())]
    assert sorted(tuple(r) for r in decode(encode(documents(rows))).collect()) == rows
