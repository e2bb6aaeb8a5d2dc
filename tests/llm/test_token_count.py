import random
import tracemalloc

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, normalizers

from ribeira.llm.token_count import UNKNOWN_PENALTY, VOCABULARY, Counter, token_counts, vocabulary


def library(scores):
    least = min(scores.values())
    pieces = [("<unk>", least), *scores.items(), *((f"<0x{b:02X}>", least) for b in range(256))]
    made = Tokenizer(models.Unigram(pieces, 0, True))
    made.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return made


def texts():
    draw = random.Random(4)
    kinds = [(32, 127), (32, 0x3000), (0x4E00, 0x9FFF), (0x1F300, 0x1F700), (32, 33)]
    mixed = ["".join(chr(draw.randrange(*draw.choice(kinds))) for _ in range(150)) for _ in range(80)]
    return [*mixed, "", " ", "  a  b   c", "the" * 400, "x" * 500, "▁▁a b", "Hello world, hello.\nNew line"]


@pytest.fixture(scope="module")
def scores():
    return vocabulary(public_tokenizers.path(VOCABULARY))


def test_same_counts_as_the_library(scores):
    counter, want = Counter(scores), library(scores)
    for text in texts():
        assert counter.count(text)[0] == len(want.encode(text, add_special_tokens=False).ids), text


def test_ties_take_the_longest_last_piece():
    scores = {"▁": 0.0, "a": -1.0, "b": -1.0, "ab": -2.0, "c": -1.0, "bc": -2.0, "abc": -3.0}
    counter, want = Counter(scores), library(scores)
    for text in ("ab", "abc", "aabbcc", "abcabc"):
        assert counter.count(text) == (len(want.encode(text, add_special_tokens=False).ids), -float(len(text)))


def plain(scores, text):
    """The best path by a whole table, later starts only where they are strictly better."""
    unknown = min(scores.values()) - UNKNOWN_PENALTY
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        ways = [(best[a][0] + scores[text[a:end]], best[a][1] + 1) for a in range(end) if text[a:end] in scores]
        if text[end - 1] not in scores:
            ways.append((best[end - 1][0] + unknown, best[end - 1][1] + len(text[end - 1].encode())))
        best.append(max(ways, key=lambda way: way[0]))
    return best[-1][::-1]


@pytest.mark.parametrize("seed", range(8))
def test_runs_longer_than_the_ring_against_a_whole_table(seed):
    draw = random.Random(seed)
    made = {"".join(draw.choice("abc▁") for _ in range(draw.randrange(1, 8))): float(-draw.randrange(9)) for _ in range(25)}
    counter = Counter(made)
    for size in (1, 7, 8, 9, 16, 17, 150):
        text = "".join(draw.choice("abcdé▁") for _ in range(size))
        assert counter.viterbi(text) == plain(made, text)


def test_unbroken_text_takes_little_memory(scores):
    counter, text = Counter(scores), "".join(random.Random(1).choices("abcdefghij", k=1_000_000))
    tracemalloc.start()
    counter.viterbi(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6_000_000


def test_pieces_across_blanks_are_not_cut():
    scores = {"▁": -1.0, "a": -1.0, "a▁b": -0.5, "b": -1.0}
    counter = Counter(scores)
    assert counter.count("a b") == (2, -1.5)


def test_whole_texts(documents, scores):
    counter = Counter(scores)
    rows = [(i, t) for i, t in enumerate(texts())] + [(500, None), (2, "again"), (501, "word " * 100_000)]
    got = sorted(tuple(r) for r in token_counts(documents(rows, extra=True)).collect())
    assert got == sorted((d, *counter.count(t or "")) for d, t in rows)
    assert token_counts(documents([])).collect() == []
