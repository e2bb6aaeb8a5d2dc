"""Removal of repeated passages: a depth-limited radix sort of suffixes.

A byte goes if a window of ``WINDOW`` bytes covers it whose content also starts earlier (in a document of smaller id, or earlier in the
same one). Suffixes matter only through their first ``WINDOW`` bytes. They are sorted by digits from the most significant one, and only
equal groups go on to the next digit; what is still together at the end is exactly the repeated windows, and all but the first go.

* The first digit is a window's anchor: the ``GRAM`` bytes in it whose hash is least (leftmost), and their place in the window. Equal
  windows have equal anchors, and neighbouring windows mostly share one, so that a document has about one anchor in
  ``(WINDOW - GRAM) / 2`` bytes. Only anchors that occur twice go on (``repeated_anchors``).
* For these, the text around an anchor, which holds all its windows, is dealt out by the anchor's hash. Occurrences in equal
  surroundings are settled as a whole. Of the others, the suffixes are sorted by digits of eight bytes (``radix_groups``).
* Where anchors are dense, as in text that repeats after a few bytes, windows that equal one at most ``PERIOD`` bytes before them in
  their text are settled at once, and only the others have anchors (``periodic``).
* Whatever a task finds more than once in its own part of the corpus it settles there; one row stands for it in the shuffle. An
  anchor with over ``HOT`` occurrences is not gathered: its windows are dealt out singly, by their own content.

Everything works on UTF-8 bytes, and removed runs may cut a character.

Defined cases: a null text is empty, texts of fewer than ``WINDOW`` bytes lose nothing. A null ``doc_id`` counts as larger than all others.
Rows that share a ``doc_id`` count as one document at the same places: none of them is the earlier one, and what goes from
one goes from all. An empty table gives an empty result; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.llm.common import Emitter, id_and_text, read, rows_of, text_groups

WINDOW = 100
GRAM = 24
HOT = 5000
PART = 8 << 20
"""Bytes of text in which a task looks for repetitions of its own."""
STRETCH = 1 << 19
PIECE = 1 << 20
PERIOD = 256
BLOCK = 1024
"""Windows among which over one anchor in eight is dense."""
MANY = 300_000
"""Anchors, windows or spans that a task holds before it passes them on."""
LAST = 2**63 - 1
PLACE_BITS = np.uint64(24)

ANCHORS = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("doc", pa.int64()), ("p", pa.int64()), ("more", pa.binary())])
FLAGGED = pa.schema([("doc", pa.int64()), ("place", pa.int64())])
SUFFIXES = pa.schema([("k", pa.int64()), ("off", pa.int64()), ("ctx", pa.binary()), ("doc", pa.int64()), ("p", pa.int64())])
SPANS = pa.schema([("doc", pa.int64()), ("span", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


# Anchors


def gram_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` bytes, put together from those of runs whose sizes are powers of two."""
    power = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    size, done, whole = 1, 0, None
    while True:
        if width & size:
            whole, done = (power, size) if whole is None else (joined_hashes(whole, power, done), done + size)
        if done == width:
            return whole * np.uint64(0xBF58476D1CE4E5B9)
        power = joined_hashes(power, power, size)
        size *= 2


def joined_hashes(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of ``size`` bytes, each with the run behind it."""
    n = len(right) - size
    h = left[:n] * np.uint64(0xD6E8FEB86659FD93) + right[size:]
    return h ^ (h >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size, least = 1, values
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - size : width - size + len(values) - width + 1])


def stretches(texts: list[tuple[int, bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Texts laid end to end in stretches of bounded length: ``(index, place in the text, size)`` of each piece, and the bytes.

    Pieces of a long text overlap by a window less one byte.
    """
    pieces, joined, total = [], [], 0
    for index, (_, text) in enumerate(texts):
        for at in range(0, max(len(text) - WINDOW + 1, 0), PIECE):
            piece = text[at : at + PIECE + WINDOW - 1]
            pieces.append((index, at, len(piece)))
            joined.append(piece)
            total += len(piece)
            if total >= STRETCH:
                yield pieces, b"".join(joined)
                pieces, joined, total = [], [], 0
    if pieces:
        yield pieces, b"".join(joined)


def periodic(codes: np.ndarray, where: np.ndarray, real: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks windows that equal one at most ``PERIOD`` bytes before them in the same piece, in blocks with dense anchors.

    ``where`` has the anchor of every window, ``real`` marks those within a piece. Blocks are counted from the start of a piece, so that
    what is marked depends on the piece alone, whatever lies beside it.
    """
    found = np.zeros(len(where), bool)
    fresh = np.r_[True, where[1:] != where[:-1]]
    fresh[begins] = True
    counts = -(-(ends - begins - WINDOW + 1) // BLOCK)
    owner = np.repeat(np.arange(len(begins)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = begins[owner] + inside * BLOCK
    dense = np.flatnonzero(np.add.reduceat(fresh & real, starts, dtype=np.int64) > BLOCK // 8)
    if not len(dense):
        return found
    first = np.r_[True, (np.diff(dense) != 1) | (np.diff(owner[dense]) != 0)]
    last = np.r_[first[1:], True]
    for piece, low, high in zip(owner[dense[first]].tolist(), starts[dense[first]].tolist(), (starts[dense[last]] + BLOCK).tolist()):
        high = min(high, int(ends[piece]) - WINDOW + 1)
        for step in range(1, PERIOD + 1):
            start, stop = max(low, int(begins[piece]) + step), high + WINDOW - 1
            if start >= high or 16 * np.count_nonzero(found[low:high]) >= 15 * (high - low):
                break
            other = np.flatnonzero(codes[start:stop] != codes[start - step : stop - step])
            at, till = np.r_[0, other + 1], np.r_[other, stop - start] - WINDOW
            runs = np.flatnonzero(till >= at)
            for a, b in zip((start + at[runs]).tolist(), (start + till[runs] + 1).tolist()):
                found[a:b] = True
    return found


def anchors(texts: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each stretch: text index, anchor hash, anchor place, and first and last start of the windows that it serves; then text index,
    start and end of the spans that are settled for being periodic."""
    for pieces, data in stretches(texts):
        codes = np.frombuffer(data, np.uint8)
        hashes = gram_hashes(codes, GRAM)
        mixed = (hashes >> PLACE_BITS << PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        least = sliding_least(mixed, WINDOW - GRAM + 1)
        where = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        del mixed, least
        sizes = np.array([size for _, _, size in pieces])
        ends = np.cumsum(sizes)
        real = np.ones(len(where), bool)
        for end in ends[:-1]:
            real[max(end - WINDOW + 1, 0) : end] = False
        settled = periodic(codes, where, real, ends - sizes, ends)
        shifts = np.array([at for _, at, _ in pieces]) - (ends - sizes)
        indices = np.array([i for i, _, _ in pieces])
        edges = np.flatnonzero(np.diff(np.r_[False, settled, False]))
        low, till = edges[::2], edges[1::2] + WINDOW - 1
        piece = np.searchsorted(ends, low, side="right")
        spans = indices[piece], low + shifts[piece], till + shifts[piece]
        starts = np.flatnonzero(real & ~settled)
        served = where[starts]
        first = np.flatnonzero(np.r_[True, (served[1:] != served[:-1]) | (np.diff(starts) != 1)])
        last = np.r_[first[1:] - 1, len(starts) - 1]
        p, low, high = served[first], starts[first], starts[last]
        piece = np.searchsorted(ends, low, side="right")
        shift = shifts[piece]
        yield indices[piece], hashes[p].view(np.int64), p + shift, low + shift, high + shift, *spans


def parts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    yield from text_groups(batches, PART)


def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Rows ``doc, text, numbers``, the numbers as an array; null is empty."""
    for batch in batches:
        lists = batch.column(2)
        for at in range(batch.num_rows):
            numbers = lists[at].values
            yield batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), np.zeros(0, np.int64) if numbers is None else numbers.to_numpy(zero_copy_only=False)


def _anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per anchor hash and part of the corpus, with all its occurrences there.

    A text with periodic spans also has a row of its own, at place -1 and counted twice, so that it is read again.
    """
    for part in parts_of(batches):
        ids = np.array([row[0] for row in part], np.int64)
        found, held = [], 0
        for stretch in anchors([row[:2] for row in part]):
            found.append(stretch)
            held += len(stretch[0])
            if held >= MANY:
                yield from _gathered(found, ids)
                found, held = [], 0
        if found:
            yield from _gathered(found, ids)


def _gathered(found: list[tuple[np.ndarray, ...]], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    index, k, p = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.argsort(k, kind="stable")
    k, doc, p = k[order], ids[index[order]], p[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    count = np.diff(np.r_[first, len(k)])
    more: list[bytes | None] = [None] * len(first)
    for i in np.flatnonzero(count > 1).tolist():
        rest = slice(first[i] + 1, first[i] + count[i])
        more[i] = np.column_stack([doc[rest], p[rest]]).tobytes()
    again = np.unique(ids[np.concatenate([f[5] for f in found])])
    own = np.array([signed(xxhash.xxh64_intdigest(b"%d" % d)) for d in again.tolist()], np.int64)
    columns = [
        np.r_[k[first], own], np.r_[count, np.full(len(own), 2)], np.r_[doc[first], again], np.r_[p[first], np.full(len(own), -1)],
        more + [None] * len(own),
    ]
    for low in range(0, len(columns[0]), 50_000):
        cut = slice(low, low + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(c[cut], f.type) for c, f in zip(columns, ANCHORS)], schema=ANCHORS)


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of ``k``: the occurrences of anchors that occur more than once; the last bit of ``place`` marks hot ones."""

    def pack(doc: np.ndarray, p: np.ndarray, more: list, hot: np.ndarray) -> pa.RecordBatch:
        others = [np.frombuffer(m, np.int64).reshape(-1, 2) for m in more if m is not None]
        flags = np.repeat(hot[[m is not None for m in more]], [len(o) for o in others]) if others else np.zeros(0, bool)
        pairs = np.concatenate([np.column_stack([doc, p]), *others])
        place = pairs[:, 1] * 2 + np.r_[hot, flags]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(place)], schema=FLAGGED)

    held: list[tuple] = []  # the rows of the last key, which may go on in the next batch
    hot_key = None

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        n = sum(r[1] for r in rows)
        if n > 1:
            yield pack(np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), [r[4] for r in rows], np.full(len(rows), n > HOT))

    for batch in batches:
        k, n, doc, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        more = batch.column(4)
        low = 0
        if held or hot_key is not None:
            same = held[0][0] if held else hot_key
            low = int(np.searchsorted(k, same, side="right"))
            rows = list(zip(k[:low].tolist(), n[:low].tolist(), doc[:low].tolist(), p[:low].tolist(), more.slice(0, low).to_pylist()))
            if hot_key is not None and rows:
                yield pack(doc[:low], p[:low], [r[4] for r in rows], np.ones(low, bool))
            else:
                held += rows
                if sum(r[1] for r in held) > HOT:
                    yield from settle(held)
                    held, hot_key = [], same
            if low == len(k):
                continue
            yield from settle(held)
            held, hot_key = [], None
        end = low + int(np.searchsorted(k[low:], k[-1], side="left"))
        if end > low:
            first = low + np.flatnonzero(np.r_[True, k[low + 1 : end] != k[low : end - 1]])
            total = np.add.reduceat(n[:end], first)
            size = np.diff(np.r_[first, end])
            keep = np.repeat(total > 1, size)
            hot = np.repeat(total > HOT, size)[keep]
            chosen = low + np.flatnonzero(keep)
            if len(chosen):
                yield pack(doc[chosen], p[chosen], more.take(pa.array(chosen)).to_pylist(), hot)
        held = list(zip(k[end:].tolist(), n[end:].tolist(), doc[end:].tolist(), p[end:].tolist(), more.slice(end).to_pylist()))
    yield from settle(held)


# Suffixes


def _suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``doc, text, places``: the surroundings of repeated anchors, each once per part of the corpus; hot ones window by window.

    ``off`` is the anchor's place in ``ctx``, -1 for a single window, and -2 less its length for a span from ``p`` on that is settled.
    """
    out = Emitter(SUFFIXES)
    known: dict[tuple, tuple] = {}
    windows: dict[bytes, tuple] = {}
    settled: list[tuple[int, int, int]] = []

    def first(seen: dict, key, doc: int, p: int, low: int, till: int) -> None:
        """Keeps the earliest occurrence, and settles the others."""
        had = seen.setdefault(key, (doc, p, low, till))
        if (doc, p) < had[:2]:
            seen[key] = (doc, p, low, till)
            settled.append((had[0], had[2], had[3]))
        elif (doc, p) > had[:2]:
            settled.append((doc, low, till))

    def pass_windows() -> Iterator[pa.RecordBatch]:
        for ctx, (doc, p, _, _) in windows.items():
            yield from out.add((signed(xxhash.xxh64_intdigest(ctx)), -1, ctx, doc, p), 160)
        windows.clear()

    def pass_settled() -> Iterator[pa.RecordBatch]:
        for doc, low, till in joined_spans(settled):
            yield from out.add((signed(xxhash.xxh64_intdigest(b"%d %d" % (doc, low))), -2 - (till - low), None, doc, low), 60)
        settled.clear()

    def pass_known() -> Iterator[pa.RecordBatch]:
        for (k, off, ctx, hot), (doc, p, low, _) in known.items():
            if hot:
                for t in range(len(ctx) - WINDOW + 1):
                    first(windows, ctx[t : t + WINDOW], doc, low + t, low + t, low + t + WINDOW)
                if len(windows) >= MANY:
                    yield from pass_windows()
            else:
                yield from out.add((k, off, ctx, doc, p), len(ctx) + 60)
        known.clear()
        yield from pass_windows()

    for part in text_groups(batches, PART, numbered):
        flags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for index, k, p, low, high, *spans in anchors([row[:2] for row in part]):
            settled.extend((part[i][0], a, b) for i, a, b in zip(*(x.tolist() for x in spans)))
            for i in np.unique(index).tolist():
                doc, text, places = part[i]
                if i not in flags:
                    flags = {i: np.divmod(np.sort(places), 2)}
                repeated, hot = flags[i]
                mine = np.arange(*np.searchsorted(index, [i, i + 1]))
                at = np.minimum(np.searchsorted(repeated, p[mine]), len(repeated) - 1)
                same = repeated[at] == p[mine]
                for j, h in zip(mine[same].tolist(), hot[at[same]].tolist()):
                    a, b, q = int(low[j]), int(high[j]) + WINDOW, int(p[j])
                    first(known, (int(k[j]), q - a, text[a:b], h), doc, q, a, b)
            if len(known) >= MANY:
                yield from pass_known()
            if len(settled) >= MANY:
                yield from pass_settled()
        yield from pass_known()
        yield from pass_settled()
    yield from out.flush()


def signed(x: int) -> int:
    return x - (x >> 63 << 64)


def joined_spans(spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Spans of each document joined where they touch."""
    now = None
    for doc, low, till in sorted(spans):
        if now is not None and now[0] == doc and low <= now[2]:
            now[2] = max(now[2], till)
        else:
            if now is not None:
                yield tuple(now)
            now = [doc, low, till]
    if now is not None:
        yield tuple(now)


def radix_groups(data: bytes, at: np.ndarray, group: np.ndarray, width: int = WINDOW) -> Iterator[np.ndarray]:
    """Sorts the suffixes at ``at`` by ``width`` bytes, given their first digit ``group``: index arrays whose suffixes are all equal,
    each in the order in which the suffixes were given."""
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    words = np.lib.stride_tricks.as_strided(padded[: (len(padded) // 8) * 8].view("<u8"), (len(padded) - 7,), (1,))
    active = np.arange(len(at))
    digits = [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]
    for depth in [None, *digits]:
        if depth is None:
            order = np.argsort(group, kind="stable")
            active, group = active[order], group[order]
            fresh = np.r_[True, group[1:] != group[:-1]]
        else:
            digit = words[at[active] + depth]
            order = np.lexsort((digit, group))
            active, group, digit = active[order], group[order], digit[order]
            fresh = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]
        together = ~fresh | ~np.r_[fresh[1:], True]  # equal to a neighbour
        group = np.cumsum(fresh)[together]
        active = active[together]
        if not len(active):
            return
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    yield from np.split(active, first[1:])


def settle_suffixes(contexts: list[tuple]) -> list[tuple[int, int, int]]:
    """Spans of windows that also start earlier, for contexts ``(k, off, ctx, doc, p)`` of distinct content."""
    contexts = sorted(contexts, key=lambda c: c[3:5])
    lengths = np.array([len(c[2]) for c in contexts])
    counts = lengths - WINDOW + 1
    owner = np.repeat(np.arange(len(contexts)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    base = np.cumsum(lengths) - lengths
    keys = np.unique(np.array([c[0] for c in contexts], np.int64), return_inverse=True)[1]
    group = keys[owner] * WINDOW + np.array([c[1] for c in contexts])[owner] - inside
    spans = []
    for equal in radix_groups(b"".join(c[2] for c in contexts), base[owner] + inside, group):
        head = contexts[owner[equal[0]]]
        for i in equal[1:].tolist():
            _, off, _, doc, p = contexts[owner[i]]
            if (doc, p) != head[3:5]:
                low = p - off + int(inside[i])
                spans.append((doc, low, low + WINDOW))
    return spans


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order ``k, off, ctx, doc, p``: the spans that go, packed as start * 2**31 + length."""
    out = Emitter(SPANS)
    spans: list[tuple[int, int, int]] = []
    waiting: list[tuple] = []
    key: list[tuple] = []
    last, suffixes, owner = None, 0, None

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal waiting, suffixes
        if waiting and (final or suffixes > 300_000):
            spans.extend(settle_suffixes(waiting))
            waiting, suffixes = [], 0
        if final or len(spans) > 100_000:
            for doc, low, till in joined_spans(spans):
                yield from out.add((doc, low << 31 | till - low), 16)
            spans.clear()

    for k, off, ctx, doc, p in rows_of(batches):
        if off < -1:
            spans.append((doc, p, p - 2 - off))
        elif off == -1:
            if owner is None or owner[:2] != (k, ctx):
                owner = (k, ctx, doc, p)
            elif (doc, p) > owner[2:]:
                spans.append((doc, p, p + WINDOW))
        else:
            if not key or key[0][0] != k:
                if len(key) > 1:
                    waiting += key
                    suffixes += sum(len(c[2]) - WINDOW + 1 for c in key)
                yield from flush(False)
                key, last = [], None
            if last is not None and last[1:3] == (off, ctx):
                if (doc, p) > last[3:5]:
                    spans.append((doc, p - off, p - off + len(ctx)))
            else:
                last = (k, off, ctx, doc, p)
                key.append(last)
    if len(key) > 1:
        waiting += key
    yield from flush(True)
    yield from out.flush()


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes, list[tuple[int, int]]]]:
    for doc, text, packed in numbered(batches):
        packed = np.sort(packed)
        low = packed >> 31
        till = np.minimum(np.maximum.accumulate(low + (packed & (1 << 31) - 1)), len(text))
        low, till = low[low < len(text)], till[low < len(text)]
        fresh = np.flatnonzero(np.r_[True, low[1:] > till[:-1]]) if len(low) else np.zeros(0, np.int64)
        cut = list(zip(low[fresh].tolist(), till[np.r_[fresh[1:], len(low)] - 1].tolist())) if len(low) else []
        yield None if doc == LAST else doc, text, cut


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(till for _, till in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(low for low, _ in spans), len(text)]))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Emitter(RESULT)
    for doc, text, spans in _kept(batches):
        kept = without(text, spans)
        yield from out.add((doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()), 120)
    yield from out.flush()


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Emitter(pa.schema([("doc_id", pa.int64()), ("text", pa.binary())]))
    for doc, text, spans in _kept(batches):
        yield from out.add((doc, without(text, spans)), len(text))
    yield from out.flush()


def keyed(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text")


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """``doc, places`` of the anchors that occur more than once in the corpus."""
    rows = keyed(docs).mapInArrow(_anchors, _ddl(ANCHORS)).repartition("k").sortWithinPartitions("k")
    return rows.mapInArrow(_repeated, _ddl(FLAGGED)).groupBy("doc").agg(F.collect_list("place").alias("places"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc, spans``: the byte runs that go, in no order and possibly touching."""
    rows = keyed(docs).join(repeated_anchors(docs), "doc").select("doc", "text", "places").mapInArrow(_suffixes, _ddl(SUFFIXES))
    dealt = rows.repartition("k").sortWithinPartitions("k", "off", "ctx", "doc", "p")
    return dealt.mapInArrow(_settle, _ddl(SPANS)).groupBy("doc").agg(F.collect_list("span").alias("spans"))


def _cut(docs: DataFrame) -> DataFrame:
    return keyed(docs).join(repeated_spans(docs), "doc", "left").select("doc", "text", "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: the bytes that stay, as binary."""
    return _cut(docs).mapInArrow(_texts, "doc_id long, text binary")


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    return _cut(docs).mapInArrow(_digests, _ddl(RESULT))


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats(read(spark, folder, "documents"))
