import hashlib
import multiprocessing
import random
import resource

import pyarrow as pa
import pytest

from ribeira.llm import substring_dedup as S


def brute(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        mark = bytearray(len(text))
        for s in range(len(text) - 99):
            window = text[s : s + 100]
            if window in seen:
                mark[s : s + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, m in zip(text, mark) if not m)
        spans = sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))
        out[doc_id] = (doc_id, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def table(batches, schema):
    made = pa.Table.from_batches(list(batches), schema=schema)
    return list(zip(*(c.to_pylist() for c in made.columns))) if made.num_rows else []


def steps(rows, size):
    """The job's steps on three splits, with sorted lists in place of shuffles."""

    def batches(rs, *fields):
        schema = pa.schema(list(fields))
        for i in range(0, len(rs), size):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rs[i : i + size]), schema)], schema=schema)

    doc, text, numbers = ("doc", pa.int64()), ("text", pa.binary()), pa.list_(pa.int64())
    splits = [rows[i::3] for i in range(3)]
    found = sorted((r for s in splits for r in table(S._anchors(batches(s, doc, text)), S.ANCHORS)), key=lambda r: r[0])
    places, spans = {}, {}
    for d, x in table(S._repeated(batches(found, *S.ANCHORS)), S.FLAGGED):
        places.setdefault(d, []).append(x)
    flagged = [[(d, t, places[d]) for d, t in s if d in places] for s in splits]
    suffixes = [r for s in flagged for r in table(S._suffixes(batches(s, doc, text, ("places", numbers))), S.SUFFIXES)]
    suffixes.sort(key=lambda r: (r[0], r[1], r[2] or b"", r[3], r[4]))
    for d, x in table(S._settle(batches(suffixes, *S.SUFFIXES)), S.SPANS):
        spans.setdefault(d, []).append(x)
    last = [(d, t, spans.get(d)) for d, t in rows]
    return {r[0]: r for r in table(S._digests(batches(last, doc, text, ("spans", numbers))), S.RESULT)}


@pytest.mark.parametrize("seed", range(12))
def test_steps_against_brute_force(monkeypatch, seed):
    draw = random.Random(seed)
    monkeypatch.setattr(S, "HOT", draw.choice([2, 3, 5, 5000]))
    monkeypatch.setattr(S, "PART", draw.choice([500, 3000, 1 << 20]))
    monkeypatch.setattr(S, "STRETCH", draw.choice([200, 1000, 1 << 19]))
    monkeypatch.setattr(S, "PIECE", draw.choice([150, 400, 1 << 22]))
    monkeypatch.setattr(S, "BLOCK", draw.choice([8, 64, 1024]))
    monkeypatch.setattr(S, "PERIOD", draw.choice([1, 7, 256]))
    monkeypatch.setattr(S, "MANY", draw.choice([1, 20, 300_000]))
    alphabet = [b"ab", b"abcdefgh", bytes(range(256)), b"a"][seed % 4]
    blob = lambda n: bytes(draw.choice(alphabet) for _ in range(n))
    passages = [blob(draw.randrange(90, 400)) for _ in range(4)]
    part = lambda: draw.choice([blob(draw.randrange(150)), draw.choice(passages), draw.choice(passages)[draw.randrange(60) :], b"xyz" * draw.randrange(60)])
    rows = [(7 * d, b"".join(part() for _ in range(draw.randrange(6)))) for d in range(draw.randrange(1, 40))]
    draw.shuffle(rows)
    assert steps(rows, draw.choice([1, 3, 50])) == brute(rows)


def test_whole_job(documents):
    passage = "".join(chr(97 + i * 7 % 26) for i in range(130))
    rows = [
        (5, "x" * 99), (6, "y" * 100), (7, "z" * 250), (1, f"first {passage} end"), (2, f"é{passage}ü"), (3, f"{passage[:100]}|{passage[30:]}"),
        (4, passage[:99]), (8, None), (9, ""), (10, f"long {passage} " * 3000), (None, passage),
    ]
    want = brute([(S.LAST if d is None else d, (t or "").encode()) for d, t in rows])
    want = sorted(((None if d == S.LAST else d, *w[1:]) for d, w in want.items()), key=repr)
    assert sorted((tuple(r) for r in S.repeats(documents(rows, extra=True)).collect()), key=repr) == want
    kept = {r.doc_id: bytes(r.text) for r in S.remove_repeats(documents(rows)).collect()}
    assert {d: hashlib.sha256(t).hexdigest() for d, t in kept.items()} == {w[0]: w[4] for w in want}


def test_repeated_ids_count_as_one_document(documents):
    draw = random.Random(8)
    text = "".join(draw.choice("abcdefgh") for _ in range(180))
    got = S.repeats(documents([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 180)]


def test_empty_table(documents):
    assert S.repeats(documents([])).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_periodic_texts_against_brute_force(monkeypatch, seed):
    draw = random.Random(seed)
    monkeypatch.setattr(S, "BLOCK", draw.choice([16, 128, 1024]))
    monkeypatch.setattr(S, "PIECE", draw.choice([300, 2000, 1 << 20]))
    units = [b"a", b"ab", b"a" * 60 + b"b", bytes(draw.randrange(97, 110) for _ in range(30)), bytes(draw.randrange(256) for _ in range(130))]
    text = lambda: b"".join(draw.choice(units) * draw.randrange(1, 60) + draw.choice([b"", b"x", b"#-#"]) for _ in range(draw.randrange(1, 5)))
    rows = [(d, text()) for d in range(8)]
    assert steps(rows, 2) == brute(rows)
    # texts that are not read again lie between them
    rows += [(d, bytes(draw.randrange(256) for _ in range(draw.randrange(100, 900)))) for d in range(8, 40)]
    draw.shuffle(rows)
    assert steps(rows, 2) == brute(rows)


def test_what_is_periodic_depends_on_the_text_alone():
    draw = random.Random(3)
    text = (b"ab" * 300 + b"cdefgh" * 80 + b"x" * 700) * 3
    spans = lambda found, of: [(int(a), int(b)) for f in found for i, a, b in zip(*f[5:]) if i == of]
    alone = spans(S.anchors([(1, text)]), 0)
    assert alone
    for n in (100, 130, 777, 2000):
        assert spans(S.anchors([(0, bytes(draw.randrange(256) for _ in range(n))), (1, text), (2, b"a" * 500)]), 1) == alone


def test_anchors_of_periodic_text_are_few():
    for unit in (b"a", b"ab", bytes(range(30)), b"a" * 60 + b"b", bytes(range(200))):
        text = unit * (1_000_000 // len(unit))
        assert sum(len(found[0]) for found in S.anchors([(1, text)])) < len(text) / 20


def _long_periodic(unit, size, pipe):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rows = [(1, (unit * (size // len(unit) + 1))[:size])]
    pipe.send((steps(rows, 1)[1][:4], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10))


@pytest.mark.parametrize("unit", [b"a", b"ab", bytes(range(65, 95))])
def test_memory_of_a_long_periodic_text(unit):
    """All windows but those of the first period go; the row and its copies are 32 MB each."""
    size = 32 << 20
    here, there = multiprocessing.get_context("spawn").Pipe()
    child = multiprocessing.get_context("spawn").Process(target=_long_periodic, args=(unit, size, there))
    child.start()
    result, grown = here.recv()
    child.join()
    assert result == (1, size, size - len(unit), 1)
    assert grown < 600
