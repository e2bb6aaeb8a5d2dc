"""Byte-level BPE by an index of pair occurrences: texts to ids and back.

A text is cut at its special tokens and by the tokenizer's pattern; the pieces are merged apart from each other. The distinct new pieces
of a group of documents are laid end to end, and an index maps each mergeable pair to all its places among them. The ranks that have places
are worked off in ascending order: all places of a rank are merged, leftmost first, and the pairs that a merge forms with its two neighbours
join the lists of their own ranks. A place whose pair has meanwhile changed is passed over. Every merge is so done once for all documents
of the group, at a cost that doesn't depend on the length of the piece around it.

This gives the ids of the usual rule (merge the leftmost pair of least rank, one at a time) because a pair that a merge forms always has
a higher rank than the merge itself; ``PairIndex`` checks that of its vocabulary and refuses any other.

A worker remembers pieces it has met, up to ``REMEMBERED`` bytes and one group of documents; this changes no result.

Defined cases: a null or empty text has no ids. Bytes that are no UTF-8 count as replacement characters. Text over ``LONG_TEXT`` characters
is worked through in parts of ``PART`` pieces. Repeated rows give repeated results, a null id stays null. An empty table gives an empty
result; other columns are not read. In decoding, ids outside the vocabulary and null ids add nothing.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.llm.common import Emitter, id_and_text, read, text_groups

VOCABULARY = "byte_bpe_50k.json"
REMEMBERED = 48 << 20
"""Bytes of pieces, ids and dictionary entries that a worker keeps."""
ENTRY = 200
"""About what the dictionary, the text and the ids of a piece take besides their characters."""
LONG_TEXT = 1 << 19
PART = 50_000

DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def byte_characters() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


@functools.cache
def newer_characters() -> str:
    """Characters that ``regex`` has as letters or numbers while the tokenizers library doesn't, as its Unicode version is older.

    Worked out once on the driver and sent along with the tasks.
    """
    try:
        from tokenizers.pre_tokenizers import ByteLevel
    except ImportError:
        return ""
    known = regex.compile(r"[\p{L}\p{N}]")
    every = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    every = [c for c in every if known.match(c)]
    cut = ByteLevel(add_prefix_space=False, use_regex=True)
    newer = []
    for low in range(0, len(every), 4096):
        part = every[low : low + 4096]
        ends = {span for _, span in cut.pre_tokenize_str("".join(f"-{c}\n" for c in part))}
        newer += [c for at, c in enumerate(part) if (3 * at, 3 * at + 2) in ends]
    return "".join(newer)


def runs(numbers: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    for at, n in enumerate(numbers):
        if not at or numbers[at - 1] != n - 1:
            first = n
        if at + 1 == len(numbers) or numbers[at + 1] != n + 1:
            yield first, n


class PairIndex:
    """A byte-level BPE vocabulary in the tokenizers library's format."""

    def __init__(self, spec: dict, pattern: str = public_tokenizers.PATTERN, newer: str | None = None):
        model, cutter, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        usual = (
            model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and spec.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
            and not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in added)
        )
        if not usual:
            raise ValueError("only plain byte-level BPE vocabularies without a normalizer are read")
        characters = byte_characters()
        back = {c: b for b, c in enumerate(characters)}
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[c] for c in characters], np.int32)
        self.tokens = {i: bytes(map(back.__getitem__, t)) for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in added}
        self.tokens.update((i, t.encode()) for t, i in self.added.items())
        self.size = max(self.tokens) + 1
        parts = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = [vocab[a] for a, _ in parts]
        self.right = [vocab[b] for _, b in parts]
        self.made = [vocab[a + b] for a, b in parts]
        self.ranks = {a * self.size + b: rank for rank, (a, b) in enumerate(zip(self.left, self.right))}
        made_at = {int(i): -1 for i in self.byte_ids}
        for rank, (a, b, made) in enumerate(zip(self.left, self.right, self.made)):
            if made in made_at or not (made_at.get(a, rank) < rank and made_at.get(b, rank) < rank):
                raise ValueError(f"merge {rank} does not come after those that make its parts, or makes a token a second time")
            made_at[made] = rank
        self.byte_ranks = np.full((256, 256), -1, np.int32)
        byte_of = {int(i): b for b, i in enumerate(self.byte_ids)}
        for rank, (a, b) in enumerate(zip(self.left, self.right)):
            if a in byte_of and b in byte_of:
                self.byte_ranks[byte_of[a], byte_of[b]] = rank
        self.pattern = regex.compile(pattern)
        self.newer = frozenset(newer_characters() if newer is None else newer)
        no = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs(sorted(map(ord, self.newer)))) + "]" if self.newer else "(?!)"
        exact = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:{no}|[^\s\p{{L}}\p{{N}}])")
        exact = exact.replace(r"?\p{L}+", rf"?(?:(?!{no})\p{{L}})+").replace(r"?\p{N}+", rf"?(?:(?!{no})\p{{N}})+")
        self.exact_pattern = regex.compile(exact)
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    @classmethod
    def load(cls, path: str, newer: str | None = None) -> PairIndex:
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file), newer=newer)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece (not empty) as little-endian unsigned 32-bit integers."""
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        starts = ends - [len(p) for p in pieces]
        ranks = self.byte_ranks[flat[:-1], flat[1:]]
        ranks[ends[:-1] - 1] = -1
        after, before = np.arange(1, len(flat) + 1, dtype=np.int32), np.arange(-1, len(flat) - 1, dtype=np.int32)
        after[ends - 1], before[starts] = -1, -1
        ids, after, before = (array("i", x.tobytes()) for x in (self.byte_ids[flat], after, before))
        places = np.flatnonzero(ranks >= 0)
        order = places[np.argsort(ranks[places], kind="stable")].astype(np.int32)
        found, first = np.unique(ranks[order], return_index=True)
        index = {rank: array("i", part.tobytes()) for rank, part in zip(found.tolist(), np.split(order, first[1:]))}
        heap = list(index)
        heapq.heapify(heap)
        rank_of, size = self.ranks.get, self.size
        while heap:
            rank = heapq.heappop(heap)
            left, right, made = self.left[rank], self.right[rank], self.made[rank]
            at = index.pop(rank)
            for p in sorted(at) if left == right else at:
                q = after[p]
                if ids[p] != left or q < 0 or ids[q] != right:
                    continue
                ids[p], ids[q] = made, -1
                after[p] = follower = after[q]
                if follower >= 0:
                    before[follower] = p
                    new = rank_of(made * size + ids[follower])
                    if new is not None:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = array("i", (p,))
                            heapq.heappush(heap, new)
                o = before[p]
                if o >= 0:
                    new = rank_of(ids[o] * size + made)
                    if new is not None:
                        if new in index:
                            index[new].append(o)
                        else:
                            index[new] = array("i", (o,))
                            heapq.heappush(heap, new)
        ids = np.frombuffer(ids, np.int32)
        alive = ids >= 0
        out = ids[alive].astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(alive)[ends - 1]).tolist()]
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]

    def pieces(self, text: str) -> Iterator[str]:
        """The pieces in order; a special token is a piece of its own."""
        pattern = self.pattern if text.isascii() or self.newer.isdisjoint(text) else self.exact_pattern
        if self.special is None or not self.special.search(text):
            return iter(pattern.findall(text)) if len(text) < LONG_TEXT else (m.group() for m in pattern.finditer(text))
        return self._with_special(text, pattern)

    def _with_special(self, text: str, pattern) -> Iterator[str]:
        at = 0
        for match in self.special.finditer(text):
            yield from (m.group() for m in pattern.finditer(text[at : match.start()]))
            yield match.group()
            at = match.end()
        yield from (m.group() for m in pattern.finditer(text[at:]))

    def decode(self, ids: Iterable[int | None]) -> bytes:
        return b"".join([self.tokens.get(i, b"") for i in ids])


class Known:
    """Pieces and their ids, kept up to a number of bytes."""

    def __init__(self, bpe: PairIndex, limit: int = REMEMBERED):
        self.bpe, self.limit, self.bytes = bpe, limit, 0
        self.ids: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """A dictionary that has all of ``pieces``."""
        if self.bytes > self.limit:
            self.ids, self.bytes = {}, 0
        new = list(pieces - self.ids.keys())
        plain = [p for p in new if p not in self.bpe.added]
        self.ids.update(zip(plain, self.bpe.merge([p.encode("utf-8", "replace") for p in plain]) if plain else []))
        if len(plain) < len(new):
            self.ids.update((p, np.array([self.bpe.added[p]], "<u4").tobytes()) for p in new if p in self.bpe.added)
        self.bytes += sum(ENTRY + 4 * len(p) for p in new)
        return self.ids


@functools.cache
def loaded(path: str, newer: str) -> PairIndex:
    return PairIndex.load(path, newer)


def encoded(batches: Iterable[pa.RecordBatch], bpe: PairIndex) -> Iterator[tuple[int, Iterator[bytes]]]:
    """``doc_id`` and its ids, in parts: one for most texts, one per ``PART`` pieces for a long one."""
    known = Known(bpe)

    def in_parts(text: str) -> Iterator[bytes]:
        pieces = bpe.pieces(text)
        while part := list(islice(pieces, PART)):
            yield b"".join(map(known.learn(set(part)).__getitem__, part))

    for group in text_groups(batches):
        texts = [(doc_id, text.decode("utf-8", "replace")) for doc_id, text in group]
        short = [(doc_id, list(bpe.pieces(t))) for doc_id, t in texts if len(t) < LONG_TEXT]
        ids = known.learn(set().union(*(p for _, p in short)))
        for doc_id, pieces in short:
            yield doc_id, iter((b"".join(map(ids.__getitem__, pieces)),))
        for doc_id, text in texts:
            if len(text) >= LONG_TEXT:
                yield doc_id, in_parts(text)


def _digests(path: str):
    newer = newer_characters()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, out = loaded(path, newer), Emitter(DIGESTS)
        for doc_id, parts in encoded(batches, bpe):
            n, ids_sha, text_sha, text = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
            for part in parts:
                n += len(part) // 4
                ids_sha.update(part)
                text_sha.update(text.decode(bpe.decode(np.frombuffer(part, "<u4").tolist())).encode())
            text_sha.update(text.decode(b"", True).encode())
            yield from out.add((doc_id, n, ids_sha.hexdigest(), text_sha.hexdigest()), 200)
        yield from out.flush()

    return run


def _ids(path: str):
    newer = newer_characters()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, out = loaded(path, newer), Emitter(IDS)
        for doc_id, parts in encoded(batches, bpe):
            ids = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
            yield from out.add((doc_id, ids), 4 * len(ids) + 16)
        yield from out.flush()

    return run


def _texts(path: str):
    newer = newer_characters()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, out = loaded(path, newer), Emitter(TEXTS)
        for batch in batches:
            for at in range(batch.num_rows):
                text = bpe.decode(batch.column(1)[at].as_py() or []).decode("utf-8", "replace")
                yield from out.add((batch.column(0)[at].as_py(), text), len(text) + 16)
        yield from out.flush()

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text."""
    return id_and_text(docs).mapInArrow(_ids(path or public_tokenizers.path(VOCABULARY)), "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; special tokens are kept, bytes that are no UTF-8 become replacement characters."""
    rows = ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_texts(path or public_tokenizers.path(VOCABULARY)), "doc_id long, text string")


def pair_index_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ids, and the text decoded from them, stay inside the task."""
    return id_and_text(docs).mapInArrow(
        _digests(path or public_tokenizers.path(VOCABULARY)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op12_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return pair_index_digests(read(spark, folder, "documents"))
