"""Byte-level BPE with numpy matrices: texts to ids and back.

A text is cut by the tokenizer's pattern, and every piece is merged for itself. Distinct pieces of a
group of documents are put side by side by length into matrices, one row per piece. Each round merges, in
every row, the leftmost pair of least rank: the pair's rank is looked up in an open-addressing hash table, the
row loses one column, and only the two pairs beside the new token are looked up again. Rows without a
mergeable pair leave the matrix. Pieces of over ``LONG`` bytes are merged one by one with a heap, by the same rule.

A worker remembers pieces it has met, up to ``REMEMBERED``; this changes no result.

Defined cases: a null or empty text has no ids. Long texts are worked through in parts of ``PART`` pieces. Repeated rows
give repeated results. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.llm.common import Emitter, id_and_text, read, text_groups

NONE = np.int32(2**31 - 1)
LONG = 256
REMEMBERED = 250_000
PART = 200_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


class PairTable:
    """(left id, right id) -> rank of the joined token, in arrays with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(8, int(len(rank) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        keys = self.key(left, right)
        slots, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            at = slots[todo]
            free = self.keys[at] == np.uint64(2**64 - 1)
            placed = todo[free]
            _, first = np.unique(slots[placed], return_index=True)
            won = placed[first]
            self.keys[slots[won]], self.ranks[slots[won]] = keys[won], rank[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            todo = todo[rest[todo]]
            slots[todo] = (slots[todo] + 1) & self.mask

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, ``NONE`` where there is no such pair. Ids below zero are padding and never found."""
        keys = self.key(left, right).ravel()
        slots = self.slot(keys)
        met = self.keys[slots]
        out = np.where(met == keys, self.ranks[slots], NONE)
        todo = np.flatnonzero((met != keys) & (met != np.uint64(2**64 - 1)))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & self.mask
            met = self.keys[slots[todo]]
            out[todo] = np.where(met == keys[todo], self.ranks[slots[todo]], NONE)
            todo = todo[(met != keys[todo]) & (met != np.uint64(2**64 - 1))]
        return out.reshape(left.shape)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        triples = [
            (ranks[token[:cut]], ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        self.pairs = PairTable(*(np.array(c, np.int64) for c in zip(*triples)))

    @classmethod
    def load(cls, path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}, pattern)

    def merge_rows(self, tokens: np.ndarray) -> list[list[int]]:
        """Merges each row of an int32 matrix that is padded with -1 at the right."""
        done: list[list[int]] = [[] for _ in tokens]
        rows = np.arange(len(tokens))
        rank = self.pair_ranks(tokens[:, :-1], tokens[:, 1:])
        while True:
            if tokens.shape[1] > 1:
                at = rank.argmin(1)
                best = rank[np.arange(len(rows)), at]
                live = best != NONE
            else:
                live = np.zeros(len(rows), bool)
            if not live.all():
                for row, ids in zip(rows[~live].tolist(), tokens[~live].tolist()):
                    done[row] = [i for i in ids if i >= 0]
                if not live.any():
                    return done
                rows, tokens, rank, at, best = rows[live], tokens[live], rank[live], at[live], best[live]
            every = np.arange(len(rows))
            tokens[every, at] = best
            width = tokens.shape[1]
            keep = np.ones((len(rows), width), bool)
            keep[every, at + 1] = False
            tokens = tokens[keep].reshape(len(rows), width - 1)
            keep = np.ones((len(rows), width - 1), bool)
            keep[every, at] = False
            rank = rank[keep].reshape(len(rows), width - 2)
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.pair_ranks(tokens[before, at[before] - 1], tokens[before, at[before]])
            after = np.flatnonzero(at < width - 2)
            rank[after, at[after]] = self.pair_ranks(tokens[after, at[after]], tokens[after, at[after] + 1])

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(right < 0, NONE, self.pairs.find(left, right))

    def merge_long(self, piece: bytes) -> list[int]:
        """One long piece: linked tokens, and a heap of (rank, position) whose stale entries are passed over."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        first = self.pair_ranks(ids[:-1], ids[1:])
        ends = [(i, i + 1) for i in range(len(piece))]
        ids = ids.tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(int(r), i, i + 1, i + 2) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        stop = [end for _, end in ends]
        gone = bytearray(len(ids))

        def push(i: int, j: int) -> None:
            rank = self.ranks.get(piece[i : stop[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, j, stop[j]))

        while heap:
            rank, i, j, end = heapq.heappop(heap)
            if gone[i] or after[i] != j or j >= len(ids) or stop[j] != end:
                continue
            ids[i], stop[i], gone[j] = rank, end, 1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [token for token, lost in zip(ids, gone) if not lost]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in pieces]
        by_width: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[at] = [whole]
            elif len(piece) > LONG:
                out[at] = self.merge_long(piece)
            elif piece:
                by_width.setdefault(-(-len(piece) // 4) * 4, []).append(at)
        for width, places in by_width.items():
            for low in range(0, len(places), 8192):
                part = places[low : low + 8192]
                flat = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
                sizes = np.array([len(pieces[i]) for i in part])
                tokens = np.where(np.arange(width) < sizes[:, None], self.byte_ids[flat], np.int32(-1))
                for i, ids in zip(part, self.merge_rows(tokens)):
                    out[i] = ids
        return out

    def split(self, text: str) -> Iterator[list[str]]:
        if len(text) < 1 << 19:
            yield self.pattern.findall(text)
        else:
            found = (m.group() for m in self.pattern.finditer(text))
            while part := list(islice(found, PART)):
                yield part

    def encode(self, text: str) -> list[int]:
        return [i for part in self.split(text) for ids in self.encode_pieces([p.encode() for p in part]) for i in ids]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE.load(path, pattern)
    return _LOADED[path, pattern]


class Memory:
    """Pieces already encoded: piece -> what ``shape`` makes of its ids."""

    def __init__(self, bpe: ByteBPE, shape, limit: int = REMEMBERED):
        self.bpe, self.shape, self.limit, self.known = bpe, shape, limit, {}

    def learn(self, parts: Iterable[list[str]]) -> None:
        new: set[str] = set().union(*parts)
        if len(self.known) + len(new) > self.limit:
            self.known = {}
        new -= self.known.keys()
        pieces = list(new)
        for piece, ids in zip(pieces, self.bpe.encode_pieces([p.encode() for p in pieces])):
            self.known[piece] = self.shape(ids)


def _walk(batches, bpe: ByteBPE, memory: Memory, start, step, end, schema: pa.Schema, weigh):
    """Per document: ``start()``, ``step(state, entries)`` for each part of its pieces, ``end(doc_id, state)`` as a row."""
    out = Emitter(schema)
    for group in text_groups(batches):
        texts = [(doc_id, text.decode("utf-8", "replace")) for doc_id, text in group]
        small = [next(bpe.split(t), []) if len(t) < 1 << 19 else None for _, t in texts]
        memory.learn(p for p in small if p is not None)
        for (doc_id, text), pieces in zip(texts, small):
            state = start()
            for part in bpe.split(text) if pieces is None else [pieces]:
                if pieces is None:
                    memory.learn([part])
                step(state, list(map(memory.known.__getitem__, part)))
            if pieces is None:
                memory.learn(p for p in small if p is not None)  # a long text may have pushed the others out
            row = end(doc_id, state)
            yield from out.add(row, weigh(row))
    yield from out.flush()


def digests(path: str, pattern: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        memory = Memory(bpe, lambda ids: (len(ids), ",".join(map(str, ids)), bpe.decode(ids)))

        def step(state, entries):
            if entries:
                if state[0]:
                    state[1].update(b",")
                state[0] += sum([e[0] for e in entries])
                state[1].update(",".join([e[1] for e in entries]).encode())
                state[2].update(b"".join([e[2] for e in entries]))

        yield from _walk(
            batches, bpe, memory, lambda: [0, hashlib.sha256(), hashlib.sha256()], step,
            lambda doc_id, s: (doc_id, s[0], s[1].hexdigest(), s[2].hexdigest()), DIGESTS, lambda row: 160,
        )

    return run


def ids_of(path: str, pattern: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)

        def step(state, entries):
            for ids in entries:
                state.extend(ids)

        yield from _walk(batches, bpe, Memory(bpe, list), list, step, lambda doc_id, s: (doc_id, s), IDS, lambda row: 4 * len(row[1]) + 16)

    return run


def texts_of(path: str, pattern: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, out = loaded(path, pattern), Emitter(TEXTS)
        for batch in batches:
            for at in range(batch.num_rows):
                doc_id, ids = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                text = bpe.decode(ids or []).decode("utf-8", "replace")
                yield from out.add((doc_id, text), len(text) + 16)
        yield from out.flush()

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text."""
    return id_and_text(docs).mapInArrow(ids_of(path or public_tokenizers.path(VOCABULARY), pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; bytes that are no UTF-8 become replacement characters."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(texts_of(path or public_tokenizers.path(VOCABULARY), pattern), "doc_id long, text string")


def token_digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ids and the bytes decoded from them stay inside the task."""
    return id_and_text(docs).mapInArrow(
        digests(path or public_tokenizers.path(VOCABULARY), pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(read(spark, folder, "documents"))
