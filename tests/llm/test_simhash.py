import random
import re

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from ribeira.llm import simhash
from ribeira.llm.graph import components
from ribeira.llm.simhash import allocate, allocate_recall, correlated_parts, drop_near, drop_similar, fingerprint, links, near_duplicates, spanning_edges


def slow_fingerprint(text, width=3):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def all_links(values, distance=3):
    u = np.array(values, np.uint64)
    return [(values[i], values[j]) for i in range(len(u)) for j in (np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= distance) + i + 1).tolist()]


def clustered(seed, clusters, size):
    draw, out = random.Random(seed), set()
    for _ in range(clusters):
        v = draw.getrandbits(64)
        for _ in range(draw.randrange(1, size)):
            out.add(v)
            for _ in range(draw.randrange(1, 4)):
                v ^= 1 << draw.randrange(64)
    hot = draw.getrandbits(64)
    out |= {hot ^ sum(1 << draw.randrange(20) for _ in range(draw.randrange(1, 4))) for _ in range(300)}
    return sorted(v % 2**64 for v in out)


TEXTS = ["", None, "One two", "ONE two", "a b c", "É é a", " \t\n", "word " * 5000, "a b c\u0085d e", "x y z " * 300_000]


def test_fingerprints():
    for text in TEXTS[:-1]:
        assert fingerprint((text or "").encode()) % 2**64 == slow_fingerprint(text), text


def test_long_texts_are_read_in_parts(monkeypatch):
    text = " ".join(str(i % 977) for i in range(60_000)).encode()
    want = fingerprint(text)
    monkeypatch.setattr(simhash, "LONG_TEXT", 1000)
    assert fingerprint(text) == want


@pytest.mark.parametrize("thresholds", [None, [1, 1], [2, 0], [0, 1, 0], [0, 0, 0, 0], [3, -1]])
def test_links_connect_what_is_connected(spark, monkeypatch, thresholds):
    values = clustered(1, 40, 6)
    if thresholds:
        m = len(thresholds)
        monkeypatch.setattr(simhash, "plan", lambda *_: ([list(range(i * 64 // m, (i + 1) * 64 // m)) for i in range(m)], thresholds))
    if thresholds == [3, -1]:
        monkeypatch.setattr(simhash, "plan", lambda *_: ([list(range(8)), list(range(8, 64))], [2, 0]))
    prints = spark.createDataFrame([(v - (v >> 63 << 64),) for v in values], "fp long")
    got = [(a % 2**64, b % 2**64) for a, b in links(prints, block=50).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    assert roots(values, got) == roots(values, all_links(values))


def test_forest_is_small():
    values = np.array(clustered(2, 1, 3), np.uint64)
    edges = spanning_edges(values, np.ones(len(values), bool), 3)
    assert len(edges) < len(values)


def test_thresholds_cost_least():
    cost, chosen = allocate([[0, 5, 9, 20], [0, 1, 50, 60], [0, 7, 8, 90]], 1)
    assert sum(chosen) == 1 and cost == min(
        a + b + c for i, a in enumerate([0, 5, 9, 20]) for j, b in enumerate([0, 1, 50, 60]) for k, c in enumerate([0, 7, 8, 90]) if i + j + k - 3 == 1
    )


def test_correlated_bits_go_together():
    draw = np.random.default_rng(1)
    bits = draw.integers(0, 2, (2000, 64)).astype(float)
    bits[:, 40] = bits[:, 3]
    bits[:, 50] = 1 - bits[:, 3]
    parts = correlated_parts(bits.T @ bits, len(bits), 4)
    assert sorted(sum(parts, [])) == list(range(64))
    assert any({3, 40, 50} <= set(p) for p in parts)


def test_components_of_documents(documents):
    draw = random.Random(5)
    base = [draw.choice(["alpha", "beta", "gamma", "delta"]) + str(draw.randrange(500)) for _ in range(900)]
    rows = [(i, t) for i, t in enumerate(TEXTS[:-1], start=50)]
    for i in range(25):
        words = list(base)
        for _ in range(i // 5):
            words[draw.randrange(900)] = f"new{i}"
        rows.append((200 - i, " ".join(words)))
    rows += [(None, TEXTS[4]), (175, rows[-1][1]), (175, rows[-1][1]), (None, "only here and nowhere else")]
    prints = {d: slow_fingerprint(t) for d, t in rows if d is not None}
    values = sorted({slow_fingerprint(t) for _, t in rows})
    found = roots(values, all_links(values))
    least = {}
    for d, v in prints.items():
        least[found[v]] = min(least.get(found[v], d), d)
    want = sorted(((d, slow_fingerprint(t), least.get(found[slow_fingerprint(t)])) for d, t in rows), key=repr)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in near_duplicates(documents(rows, extra=True)).collect()), key=repr)
    assert got == want
    kept = [(r.doc_id, r.text) for r in drop_near(documents(rows, extra=True)).collect()]
    assert sorted((d for d, _ in kept), key=repr) == sorted({w[2] for w in want}, key=repr)
    assert (None, "only here and nowhere else") in kept


def test_similar_texts_go(documents):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows, groups = [], 40
    for g in range(groups):
        base = [word() for _ in range(300)]
        rows.append((1000 * g, " ".join(base)))
        for c in range(1, 4):
            words = list(base)
            for _ in range(4):  # 20 of some 300 shingles
                words[draw.randrange(300)] = word()
            rows.append((1000 * g + c, " ".join(words)))
        rows.append((1000 * g + 500, " ".join([word() for _ in range(150)] + base[:150])))
    rows += [(None, "alone without an id"), (-5, rows[0][1]), (-5, rows[0][1])]
    kept = [r.doc_id for r in drop_similar(documents(rows, extra=True)).collect()]
    want = {None, -5, *(1000 * g for g in range(1, groups)), *(1000 * g + 500 for g in range(groups))}
    assert want <= set(kept) and len(kept) == len(set(kept)) and len(set(kept) - want) <= 1


def test_thresholds_reach_the_recall():
    costs, gains = [[0, 2, 9], [0, 3, 6], [0, 100, 200]], [[0, 0.5, 1.2], [0, 0.5, 1.2], [0, 0.5, 1.2]]
    assert allocate_recall(costs, gains, 1.0) == [0, 0, -1]
    assert allocate_recall(costs, gains, 1.6) == [0, 1, -1]
    assert allocate_recall(costs, gains, 99) == [1, 1, 1]


def test_empty_table(documents):
    for drop in (near_duplicates, drop_near, drop_similar):
        assert drop(documents([])).collect() == []


def test_components_of_long_chains(spark):
    draw = random.Random(6)
    nodes = draw.sample(range(10_000), 400)
    edges = [(a, b) for a, b in zip(nodes[:300], nodes[1:300])] + [(nodes[300], n) for n in nodes[300:]] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({n for e in edges for n in e}, edges)
    want.pop(7, None) if 7 not in nodes else None
    assert got == want


def jaccard(a, b, width=5):
    a, b = ({tuple(t.split()[i : i + width]) for i in range(len(t.split()) - width + 1)} for t in (a, b))
    return len(a & b) / len(a | b)


def pairs_around(draw, n, words=204):
    """Pairs of texts, ids 2k and 2k + 1, whose similarities lie closely around 0.8, half of them below."""
    rows = []
    for k in range(n):
        base = [f"w{k}x{i}" for i in range(words)]
        other = list(base)
        other[-(21 + k % 4) :] = [f"v{k}x{i}" for i in range(21 + k % 4)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    draw.shuffle(rows)
    return rows


def test_links_by_exact_similarity(documents):
    rows = pairs_around(random.Random(3), 200)
    text = dict(rows)
    similar = {k for k in range(200) if jaccard(text[2 * k], text[2 * k + 1]) >= 0.8}
    assert 0 < len(similar) < 200 and all(0.77 < jaccard(text[2 * k], text[2 * k + 1]) < 0.83 for k in range(200))
    kept = {r.doc_id for r in drop_similar(documents(rows), recall=0.999999).collect()}
    assert {k for k in range(200) if 2 * k + 1 not in kept} == similar and all(2 * k in kept for k in range(200))


def test_spanning_forest_of_sets():
    draw = np.random.default_rng(2)
    sets = [np.sort(draw.choice(44, 39, replace=False)).astype(np.uint64) for _ in range(120)]
    for mine in (None, draw.integers(0, 2, 120).astype(bool)):
        want = [(i, j) for i in range(120) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) and (mine is None or mine[i] != mine[j])]
        got = simhash.similar_edges(sets, 0.8, mine)
        assert want and set(map(frozenset, got)) <= set(map(frozenset, want)) and roots(range(120), got) == roots(range(120), want)


def test_bands_do_not_depend_on_the_number_of_texts(documents):
    assert simhash.bands_for(0.8, 0.9999) == 24 and simhash.bands_for(1, 0.9999) == 1
    rows = [r for r in pairs_around(random.Random(4), 1200) if r[0] // 2 % 4 == 0]  # of each four pairs the most similar
    text = dict(rows)
    assert all(0.8 <= jaccard(text[d], text[d + 1]) < 0.81 for d in text if d % 2 == 0)
    assert sorted(r.doc_id for r in drop_similar(documents(rows)).collect()) == sorted(d for d in text if d % 2 == 0)


def test_the_pipeline_links_by_fingerprints_and_by_sets(documents):
    """A refrain settles the fingerprint of texts whose sets of shingles differ; both kinds of links make one chain."""
    refrain = [f"r{i}" for i in range(21)] * 60
    tails = {d: [f"t{d}x{i}" for i in range(60)] for d in (10, 20)}
    rows = [(d, " ".join(refrain + tail)) for d, tail in tails.items()]
    base = [f"b{i}" for i in range(300)]
    rows += [(50, " ".join(base)), (51, " ".join(base[:-25] + [f"c{i}" for i in range(25)])), (60, "alone"), (61, "ALONE")]
    text, bits = dict(rows), {d: slow_fingerprint(t) for d, t in rows}
    assert jaccard(text[10], text[20]) < 0.5 and (bits[10] ^ bits[20]).bit_count() <= 3
    assert jaccard(text[50], text[51]) > 0.8 and (bits[50] ^ bits[51]).bit_count() > 3
    rows.append((5, " ".join(refrain + tails[20][:58] + ["new", "end"])))
    assert jaccard(rows[-1][1], text[20]) >= 0.8
    kept = corpus_pipeline.drop_near_copies(None, documents(rows), "").collect()
    assert sorted(r.doc_id for r in kept) == [5, 50, 60]
    assert {r.doc_id for r in drop_near(documents(rows)).collect()} >= {50, 51}
