"""SimHash near-duplicates, found by the general pigeonhole principle.

A fingerprint has 64 bits, each set where over half of the hashes of the text's word shingles have it. Two fingerprints
link when at most ``distance`` bits differ. If the bits are dealt into parts with thresholds ``t_i`` that add up to
``distance - parts + 1`` (-1 leaves a part out), then linked fingerprints differ in at most ``t_i`` bits of some part ``i``.

1. Counts over all distinct fingerprints give every pair of bits its correlation; correlated bits go into one part, as such
   a part is unselective anyway, and the others stay selective.
2. The number of fingerprints per key of each part, again over all of them, gives the candidates at threshold 0; wider ones
   are estimated from it by the bits' own distributions. Dynamic programming deals the thresholds out so that probes and
   candidates together are fewest, for each number of parts; the cheapest plan is used.
3. Every fingerprint is listed under its key in each part, and probes the keys within the part's threshold. What meets under
   a key is compared by numpy, and only the edges of a spanning forest leave the task: a group of n fingerprints gives under n rows.
   Keys with over ``BLOCK`` rows are split into blocks, and pairs of blocks go to different tasks.
4. Components come from these edges (``graph.components``).

Equal fingerprints are one node throughout, so exact copies are never compared with each other.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and links like any other. Fewer words than a
shingle make one shingle. A null ``doc_id`` takes part, but names a component only where there is no other id. Of rows that repeat
id and text, ``drop_near`` leaves one. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.llm.common import Emitter, id_and_text, read, rows_of
from ribeira.llm.graph import components
from ribeira.session import materialize

BITS = 64
SEED = 42
BLOCK = 4096
LONG_TEXT = 4 << 20
MINORITY = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

PRINTS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("fp", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
PAIRS = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("n", pa.int64())])


def bit_counts(words: list[bytes], width: int) -> tuple[np.ndarray, int]:
    """How often each bit is set in the hashes of the words' shingles, highest bit first, and how many shingles there are."""
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    data = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
    columns = np.frombuffer(data, np.uint8).reshape(-1, 8)
    per_byte = np.bincount((columns + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    return (per_byte @ MINORITY).ravel(), len(columns)


def fingerprint(text: bytes, width: int = 3) -> int:
    """The fingerprint as a signed 64-bit number."""
    text = text.lower()  # of bytes: A-Z only
    total, n = np.zeros(BITS, np.int64), 0
    if len(text) < LONG_TEXT:
        parts: Iterable[list[bytes]] = [text.split()]
    else:
        found = (m.group() for m in WORD.finditer(text))
        parts = iter(lambda: list(islice(found, 100_000)), [])
    carried: list[bytes] = []
    for part in parts:
        words = carried + part
        if len(words) >= width:
            counts, more = bit_counts(words, width)
            total, n = total + counts, n + more
            carried = words[len(words) - width + 1 :]
        else:
            carried = words
    if not n and carried:
        total, n = bit_counts([b" ".join(carried)], 1)
    return int(np.packbits(2 * total > n).view(">i8")[0]) if n else 0


def _prints(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(PRINTS)
        for doc_id, text, mark in rows_of(batches):
            yield from out.add((doc_id, mark, fingerprint(text, width)))
        yield from out.flush()

    return run


def _bits(values: np.ndarray) -> np.ndarray:
    """n x 64 matrix of bits, bit 0 (the lowest) first."""
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _cooccurrence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many fingerprints of the split have bits i and j both set; (64, 64) counts them all."""
    total, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        bits = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
        for low in range(0, len(bits), 1 << 16):
            part = bits[low : low + (1 << 16)]
            total += part.T @ part
        n += len(bits)
    i, j = np.indices(total.shape).reshape(2, -1)
    columns = [np.append(i, BITS), np.append(j, BITS), np.append(total.ravel().astype(np.int64), n)]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=PAIRS)


def correlated_parts(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Deals the bits into ``parts`` of near-equal width: each takes a free bit and then those most correlated with what it has."""
    share = together / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    link = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        seed = max(free, key=lambda b: (link[b, free].sum(), -b))
        mine = [seed]
        free.remove(seed)
        while len(mine) < size:
            nearest = max(free, key=lambda b: (link[b, mine].sum(), -b))
            mine.append(nearest)
            free.remove(nearest)
        out.append(sorted(mine))
    return out


def within(differ: np.ndarray, most: int) -> np.ndarray:
    """Probabilities that at most 0, 1, … ``most`` of independent bits differ."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for d in differ:
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return np.cumsum(chance)


def ball(width: int, radius: int) -> int:
    sizes, term = 0, 1
    for k in range(radius + 1):
        sizes += term
        term = term * (width - k) // (k + 1)
    return sizes


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of -1 and more that add up to ``total`` at least cost; ``costs[i][t + 1]`` is the cost of threshold t in part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for index, more in enumerate(row):
                key = spent + index
                if key not in step or cost + more < step[key][0]:
                    step[key] = (cost + more, [*chosen, index - 1])
        best = step
    return best[total + len(costs)]


def key_of(part: list[int]):
    """The part's bits of column ``fp``, packed in their order."""
    key = F.lit(0).cast("long")
    for place, bit in enumerate(part):
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", bit).bitwiseAND(1), place))
    return key


def plan(prints: DataFrame, distance: int) -> tuple[list[list[int]], list[int]]:
    """The parts and thresholds of least estimated cost for ``prints(fp)``."""
    counts = prints.select("fp").mapInArrow(_cooccurrence, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    together, n = np.zeros((BITS, BITS)), 0
    for i, j, k in counts:
        if i == BITS:
            n = k
        else:
            together[i, j] = k
    p = np.diag(together) / max(n, 1)
    differ = 2 * p * (1 - p)
    options = {m: correlated_parts(together, n, m) for m in range(2, distance + 2)}
    listed = [(m, k, part) for m, parts in options.items() for k, part in enumerate(parts)]
    keys = prints.select(F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), key_of(part).alias("key")) for m, k, part in listed))).alias("x"))
    met = keys.groupBy("x.m", "x.k", "x.key").count().groupBy("m", "k").agg(F.sum(F.expr("count * (count - 1.0D) / 2")).alias("pairs")).collect()
    pairs = {(m, k): float(x) for m, k, x in met}
    best = None
    for m, parts in options.items():
        costs = []
        for k, part in enumerate(parts):
            chances = within(differ[part], distance)
            row = [0.0]
            for t in range(distance + 1):
                candidates = pairs.get((m, k), 0.0) * chances[t] / max(chances[0], 1e-300)
                row.append(40.0 * n * ball(len(part), t) + candidates)
            costs.append(row)
        cost, thresholds = allocate(costs, distance - m + 1)
        if best is None or cost < best[0]:
            best = (cost, parts, thresholds)
    return best[1], best[2]


def spanning_edges(values: np.ndarray, listed: np.ndarray, distance: int, mine: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the rows of ``values`` (uint64, one or more words each), one end at least ``listed``.

    Rows with ``mine`` are compared with the others only (two blocks), without it all with all.
    """
    out: list[tuple[int, int]] = []
    values = values.reshape(len(values), -1)
    if len(values) <= 48:
        near = np.bitwise_count(values[:, None] ^ values).sum(-1) <= distance
        near &= listed[:, None] | listed
        if mine is not None:
            near &= mine[:, None] != mine
        a, b = np.nonzero(np.triu(near, 1))
        root = list(range(len(values)))
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = i, j
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((i, j))
        return out
    left = np.arange(len(values))
    waiting: list[int] = []
    while len(left) or waiting:
        if not waiting:
            waiting.append(int(left[0]))
            left = left[1:]
        node = waiting.pop()
        near = np.bitwise_count(values[left] ^ values[node]).sum(-1) <= distance
        if not listed[node]:
            near &= listed[left]
        if mine is not None:
            near &= mine[left] != mine[node]
        if near.any():
            found = left[near]
            out.extend((node, other) for other in found.tolist())
            waiting.extend(found.tolist())
            left = left[~near]
    return out


def _verify(distance: int):
    """Rows ``part, key, low, high, block, listed, node, fp`` in the order of the first four: the links under every key."""

    def edges(group: list[tuple]) -> list[tuple[int, int]]:
        low, high = group[0][2], group[0][3]
        values = np.frombuffer(b"".join(r[7] for r in group), np.uint64).reshape(len(group), -1)
        mine = None if low == high else np.array([r[4] == low for r in group])
        found = spanning_edges(values, np.array([r[5] for r in group], bool), distance, mine)
        return [(group[i][6], group[j][6]) for i, j in found]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, group, at = Emitter(EDGES), [], None
        for row in rows_of(batches):
            if row[:4] != at:
                if len(group) > 1:
                    for edge in edges(group):
                        yield from out.add(edge, 16)
                group, at = [], row[:4]
            group.append(row)
        if len(group) > 1:
            for edge in edges(group):
                yield from out.add(edge, 16)
        yield from out.flush()

    return run


def meet(rows: DataFrame, distance: int, block: int) -> DataFrame:
    """``a, b``: spanning links among the ``rows(part, key, listed, node, fp)`` under each key."""
    sizes = materialize(
        rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.max("listed").alias("met")).where(F.col("met") & (F.col("n") > 1))
        .select("part", "key", F.ceil(F.col("n") / block).cast("long").alias("blocks")), "simhash-keys",
    )
    blocks = rows.join(sizes, ["part", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    cells = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("part", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "listed", "node", "fp")
    dealt = cells.repartition("part", "key", "low", "high").sortWithinPartitions("part", "key", "low", "high")
    return dealt.mapInArrow(_verify(distance), "a long, b long")


def links(prints: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """``a, b``: links among distinct ``prints(fp)`` that connect whatever is connected."""
    parts, thresholds = plan(prints, distance)
    used = [(k, part, t) for k, (part, t) in enumerate(zip(parts, thresholds)) if t >= 0]
    keys = F.array(*(F.struct(F.lit(k).alias("part"), key_of(part).alias("key")) for k, part, _ in used))
    flips = {k: [sum(1 << f for f in some) for r in range(t + 1) for some in combinations(range(len(part)), r)] for k, part, t in used}
    masks = F.create_map(*(x for k, flip in flips.items() for x in (F.lit(k), F.array(*(F.lit(m).cast("long") for m in flip)))))
    rows = prints.select("fp", F.explode(keys).alias("e")).select("fp", "e.part", "e.key", F.explode(masks[F.col("e.part")]).alias("mask"))
    rows = rows.select(
        "part", F.col("key").bitwiseXOR(F.col("mask")).alias("key"), (F.col("mask") == 0).alias("listed"), F.col("fp").alias("node"), F.to_binary(F.lpad(F.hex("fp"), 16, "0"), F.lit("hex")).alias("fp")
    )
    return meet(rows, distance, block)


def mark_of(text):
    return F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b"")))


def own_name():
    """Orders rows by id, null last, and text; the least of a group names it."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``mark``, a hash of the text: id and mark tell rows apart, but for those that repeat both."""
    return id_and_text(docs).withColumn("mark", mark_of(F.col("text")))


def grouped(docs: DataFrame, distance: int, width: int) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, mark, fp`` and ``name``, the id and mark of the row that names its component."""
    prints = materialize(marked(docs).mapInArrow(_prints(width), "doc_id long, mark long, fp long"), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(own_name()).alias("rep")), "nodes")
    member = components(links(nodes.select("fp"), distance))
    mapped = nodes.join(member, nodes.fp == member.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    names = mapped.groupBy("root").agg(F.min("rep").alias("name"))
    names = mapped.join(names, "root").select(F.col("fp").alias("_fp"), "name")
    return prints.join(names, prints.fp == F.col("_fp")).select("doc_id", "mark", "fp", "name")


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` (signed) and ``component_id``."""
    return grouped(docs, distance, width).select("doc_id", "fp", F.col("name.doc_id").alias("component_id"))


def drop_near(docs: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """The rows of ``docs`` that name their component, with all their columns; of rows that repeat id and text, one."""
    own = F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("mark") == F.col("name.mark"))
    stay = materialize(grouped(docs, distance, width).where(own).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")), "near")
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), mark_of(docs["text"]).alias("mark"))
    kept = rows.join(stay.distinct(), rows.doc_id.eqNullSafe(F.col("_id")) & (rows.mark == F.col("_mark")), "left_semi")
    if not stay.groupBy("_id", "_mark").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "mark"])
    return kept.select("row.*")


# Similar texts: long fingerprints


LONG_WORDS = 8
BLOCK_SHINGLES = 1 << 19
DEVIATIONS = 7
"""By how much the bits of candidates may differ beyond their mean: small sets have more of them (0.19 for 4 shingles of 5, 4.3 deviations off)."""
BAND = 5
UNITS = 100
"""Of logarithmic gain, for the dynamic programme."""


def long_fingerprint(text: bytes, width: int, words: int = LONG_WORDS) -> bytes:
    """``64 * words`` bits by the rule of ``fingerprint``; each word has hashes of its own, mixed from the shingles' XXH64."""
    shingled = text.lower().split()
    if not shingled:
        return bytes(8 * words)
    width = min(width, len(shingled))
    totals, n = np.zeros((words, BITS), np.int64), len(shingled) - width + 1
    for low in range(0, n, 100_000):
        shingles = map(b" ".join, zip(*(shingled[low + i : min(low + 100_000, n) + i] for i in range(width))))
        base = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), ">u8").astype(np.uint64)
        for word in range(words):
            h = (base ^ (base >> np.uint64(29 + word))) * np.uint64(0x9E3779B97F4A7C15 + 2 * word * 0x1000193)
            h ^= h >> np.uint64(32)
            columns = h.view(np.uint8).reshape(-1, 8)
            per_byte = np.bincount((columns + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
            totals[word] += (per_byte @ MINORITY).ravel()
    return np.packbits(2 * totals > n, axis=1).tobytes()


def differing(similarity: float) -> float:
    """The chance that a bit differs between texts whose shingle sets have this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def allocate_recall(costs: list[list[float]], gains: list[list[float]], target: float) -> list[int]:
    """Thresholds of -1 and more at least cost whose gains add up to ``target``; all of the most gainful where they cannot."""
    goal = min(int(np.ceil(target * UNITS)), sum(int(max(g) * UNITS) for g in gains))
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row, gain in zip(costs, gains):
        step: dict[int, tuple[float, list[int]]] = {}
        for had, (cost, chosen) in best.items():
            for index, (more, g) in enumerate(zip(row, gain)):
                key = min(goal, had + int(g * UNITS))
                if key not in step or cost + more < step[key][0]:
                    step[key] = (cost + more, [*chosen, index - 1])
        best = step
    return best[goal][1]


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order; fewer words than a shingle make one, and so do none."""
    words = text.lower().split()
    width = max(1, min(width, len(words)))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if words else [b""]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), ">u8").astype(np.uint64))


def bands_for(similarity: float, recall: float) -> int:
    """How many bands of ``BAND`` least hashes a pair of this similarity needs to agree in one of them with the chance of ``recall``."""
    return max(1, int(np.ceil(np.log1p(-recall) / np.log1p(-min(similarity**BAND, 1 - 1e-12)))))


def band_keys(hashes: np.ndarray, bands: int) -> np.ndarray:
    """A key per band, from the least of the hashes under each of ``BAND`` permutations."""
    factors = np.random.default_rng(SEED).integers(1, 1 << 63, bands * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(factors), ~np.uint64(0))
    for low in range(0, len(hashes), 256):
        np.minimum(least, (hashes[low : low + 256, None] * factors).min(0), out=least)
    least ^= least >> np.uint64(29)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for row in least.reshape(bands, BAND).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def _long_prints(width: int, bands: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("fp", pa.binary()), ("keys", pa.list_(pa.int64()))]))
        for doc_id, text, mark in rows_of(batches):
            yield from out.add((doc_id, mark, long_fingerprint(text, width), band_keys(shingle_set(text, width), bands)), 100 + 8 * bands)
        yield from out.flush()

    return run


def _sets(width: int):
    """Rows ``text, root, mark``: the shingle set instead of the text, and its size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(pa.schema([("root", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("hashes", pa.binary())]))
        for text, root, mark in rows_of(batches):
            hashes = shingle_set(text, width)
            yield from out.add((root, mark, len(hashes), hashes.tobytes()), 8 * len(hashes) + 32)
        yield from out.flush()

    return run


def similar_edges(sets: list[np.ndarray], similarity: float, mine: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``sets`` (distinct numbers, none empty) whose Jaccard similarity is ``similarity`` or more.

    Sets with ``mine`` are compared with the others only, without it all with all.
    """
    sizes = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    has = np.zeros(len(names), bool)
    left, out, waiting = np.arange(len(sets)), [], []
    while len(left) or waiting:
        if not waiting:
            waiting.append(int(left[0]))
            flat, left = flat[sizes[left[0]] :], left[1:]
        if not len(left):
            break
        node = waiting.pop()
        has[own[node]] = True
        shared = np.add.reduceat(has[flat], np.append(0, np.cumsum(sizes[left])[:-1]), dtype=np.int64)
        has[own[node]] = False
        near = shared / (sizes[left] + sizes[node] - shared) >= similarity
        if mine is not None:
            near &= mine[left] != mine[node]
        if near.any():
            found = left[near].tolist()
            out.extend((node, other) for other in found)
            waiting.extend(found)
            flat, left = flat[np.repeat(~near, sizes[left])], left[~near]
    return out


def _verify_sets(similarity: float):
    """Rows ``root, low, high, block, node, hashes`` in the order of the first three: the similar pairs in every cell."""

    def edges(group: list[tuple]) -> list[tuple[int, int]]:
        low, high = group[0][1], group[0][2]
        mine = None if low == high else np.array([r[3] == low for r in group])
        found = similar_edges([np.frombuffer(r[5], np.uint64) for r in group], similarity, mine)
        return [(group[i][4], group[j][4]) for i, j in found]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, group, at = Emitter(EDGES), [], None
        for row in rows_of(batches):
            if row[:3] != at:
                if len(group) > 1:
                    for edge in edges(group):
                        yield from out.add(edge, 16)
                group, at = [], row[:3]
            group.append(row)
        if len(group) > 1:
            for edge in edges(group):
                yield from out.add(edge, 16)
        yield from out.flush()

    return run


def exact_links(docs: DataFrame, texts: DataFrame, candidates: DataFrame, similarity: float, width: int, block: int = BLOCK_SHINGLES) -> DataFrame:
    """``a, b``: links among ``texts(mark, rep)`` that connect whatever is linked by ``candidates(a, b)`` and similar.

    The shingle sets of a component of candidates meet and are compared exactly, all with all, but for those that are connected already.
    Components with over ``block`` shingles are split into blocks, and pairs of blocks go to different tasks.
    """
    member = components(candidates).join(texts.select(F.col("mark").alias("node"), "rep"), "node")
    wanted = member.select("root", F.col("node").alias("_mark"), F.col("rep.doc_id").alias("_id"))
    rows = marked(docs)
    rows = rows.join(wanted, rows.doc_id.eqNullSafe(F.col("_id")) & (rows.mark == F.col("_mark"))).select("text", "root", "mark")
    sets = materialize(rows.mapInArrow(_sets(width), "root long, node long, size long, hashes binary"), "shingle-sets")
    blocks = sets.groupBy("root").agg(F.ceil(F.sum("size") / block).cast("long").alias("blocks"))
    cells = sets.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "hashes")
    dealt = cells.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    return dealt.mapInArrow(_verify_sets(similarity), "a long, b long")


def similar_links(nodes: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """``a, b``: candidates among ``nodes(node, fp, keys)`` that connect texts of this similarity.

    What agrees in a key is compared by fingerprint, and is a candidate up to ``DEVIATIONS`` standard deviations beyond the bits that the
    similarity lets differ.
    """
    rows = nodes.select(F.posexplode("keys").alias("part", "key"), F.lit(True).alias("listed"), "node", "fp")
    bits, p = LONG_WORDS * BITS, differing(similarity)
    return meet(rows, int(bits * p + DEVIATIONS * np.sqrt(bits * p * (1 - p))), block)


def fingerprint_links(docs: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """``a, b``: the marks of texts and of those that name their components by fingerprint, as ``near_duplicates`` finds them."""
    return grouped(docs, distance, width).select(F.col("mark").alias("a"), F.col("name.mark").alias("b")).where("a <> b").distinct()


def drop_similar(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.9999, distance: int | None = None) -> DataFrame:
    """The rows of ``docs`` that name their group, with all their columns: groups are linked by this Jaccard similarity or more of
    their sets of shingles. Agreeing bands of least hashes give candidates, so many that a pair of just this similarity is one with
    the chance of ``recall``, whatever else is in the table; links are kept by the sets themselves. With a ``distance``, texts whose
    fingerprints differ in that many bits at most are linked too, all of them, by the general pigeonhole principle.
    """
    prints = materialize(marked(docs).mapInArrow(_long_prints(width, bands_for(similarity, recall)), "doc_id long, mark long, fp binary, keys array<long>"), "long-prints")
    texts = materialize(prints.groupBy("mark").agg(F.min(own_name()).alias("rep"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "texts")
    candidates = similar_links(texts.select(F.col("mark").alias("node"), "fp", "keys"), similarity)
    linked = exact_links(docs, texts, candidates, similarity, width)
    if distance is not None:
        linked = linked.union(fingerprint_links(docs, distance))
    member = components(linked)
    mapped = texts.join(member, texts.mark == member.node, "left").select("mark", "rep", F.coalesce("root", "mark").alias("root"))
    stay = materialize(mapped.groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("rep.doc_id").alias("_id"), F.col("rep.mark").alias("_mark")), "near")
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), mark_of(docs["text"]).alias("mark"))
    kept = rows.join(stay, rows.doc_id.eqNullSafe(F.col("_id")) & (rows.mark == F.col("_mark")), "left_semi")
    if not prints.groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "mark"])
    return kept.select("row.*")


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
