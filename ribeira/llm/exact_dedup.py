"""Exact duplicates by Patricia tries.

Texts are equal when they are the same bytes once every character of ``[\\x20\\x09-\\x0D]`` is gone. Full
byte strings go into compressed radix tries, first one per input split, then one per partition of
(length, SHA-256); a terminal node keeps how many rows ended there and which of them stays. So a text
that a third of all rows share crosses the shuffle once per input split.

A trie holds a bounded number of bytes. Beyond that, its heaviest subtree leaves it: in the first round its
entries go straight on to the shuffle, in the second to a file of the task, which is worked through
afterwards in the same way.

Defined cases: a null text is empty; empty texts are equal to each other. Of equal texts the row with the most
code points in the original text stays, then the smallest ``doc_id``; a null ``doc_id`` comes last. Rows of a group that agree with
the one that stays in ``doc_id`` and code points are all marked as kept by ``exact_dedup``; ``drop_exact`` leaves one row of each group,
of such rows that of the least text, then of the least hash of the other columns. Columns other than ``doc_id`` and ``text`` are not read otherwise. Tries compare whole
texts; only the way back from a text to its rows trusts that two texts of one length never share their SHA-256.
"""

from __future__ import annotations

import hashlib
import pickle
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ribeira.llm.common import Emitter, id_and_text, read, rows_of
from ribeira.session import materialize

WHITE = b" \t\n\x0b\x0c\r"
TRIE_BYTES = 96 << 20

ENTRIES = pa.schema([
    ("n_bytes", pa.int64()), ("sha", pa.binary()), ("text", pa.binary()), ("size", pa.int64()),
    ("chars", pa.int64()), ("keep_id", pa.int64()), ("copies", pa.int64()),
])
OWNERS = pa.schema([
    ("n_bytes", pa.int64()), ("sha", pa.binary()), ("size", pa.int64()), ("keep_chars", pa.int64()), ("keep_id", pa.int64()), ("copies", pa.int64()),
])
KEYS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("chars", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


class Owner:
    """What a terminal node knows: rows, the best of them, and how often the best one is there."""

    __slots__ = ("size", "chars", "doc_id", "copies")

    def __init__(self, size: int, chars: int, doc_id: int | None, copies: int = 1):
        self.size, self.chars, self.doc_id, self.copies = size, chars, doc_id, copies

    def rank(self) -> tuple:
        return (-self.chars, self.doc_id is None, self.doc_id or 0)

    def merge(self, other: Owner) -> None:
        self.size += other.size
        mine, theirs = self.rank(), other.rank()
        if theirs < mine:
            self.chars, self.doc_id, self.copies = other.chars, other.doc_id, other.copies
        elif theirs == mine:
            self.copies += other.copies


class Node:
    __slots__ = ("label", "kids", "owner", "file")

    def __init__(self, label: bytes, owner: Owner | None = None):
        self.label, self.kids, self.owner, self.file = label, {}, owner, None


def shared_prefix(label: bytes, data: bytes, at: int) -> int:
    """How many leading bytes of ``label`` are found in ``data`` from ``at`` on."""
    if data.startswith(label, at):
        return len(label)
    low, high = 0, min(len(label), len(data) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[:middle] == data[at : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """A compressed radix trie over bytes that holds about ``limit`` bytes of labels."""

    def __init__(self, limit: int = TRIE_BYTES, folder: str | None = None):
        self.root, self.limit, self.bytes, self.folder = Node(b""), limit, 0, folder

    def insert(self, data: bytes, owner: Owner) -> None:
        node, at = self.root, 0
        while True:
            if node.file is not None:
                pickle.dump((data, owner.size, owner.chars, owner.doc_id, owner.copies), node.file)
                return
            if at == len(data):
                if node.owner is None:
                    node.owner = owner
                else:
                    node.owner.merge(owner)
                return
            kid = node.kids.get(data[at])
            if kid is None:
                node.kids[data[at]] = Node(data[at:], owner)
                self.bytes += len(data) - at + 200
                return
            same = shared_prefix(kid.label, data, at)
            if same < len(kid.label):
                upper = Node(kid.label[:same])
                kid.label = kid.label[same:]
                upper.kids[kid.label[0]] = kid
                node.kids[data[at]] = kid = upper
                self.bytes += 200
            node, at = kid, at + same

    def full(self) -> bool:
        return self.bytes > self.limit

    @staticmethod
    def entries(top: Node, prefix: bytes) -> Iterator[tuple[bytes, Owner]]:
        stack = [(top, prefix)]
        while stack:
            node, path = stack.pop()
            path += node.label
            if node.owner is not None:
                yield path, node.owner
            stack.extend((kid, path) for kid in node.kids.values())

    @staticmethod
    def files(top: Node) -> list:
        """The files of subtrees spilled before."""
        found, stack = [], [top]
        while stack:
            node = stack.pop()
            if node.file is not None:
                found.append(node.file)
            stack.extend(node.kids.values())
        return found

    @staticmethod
    def weight(top: Node) -> int:
        total, stack = 0, [top]
        while stack:
            node = stack.pop()
            total += len(node.label) + 200
            stack.extend(node.kids.values())
        return total

    def heaviest(self) -> tuple[Node, int, bytes] | None:
        """Below the first branching, the parent and first byte of the heaviest subtree, and the path to it."""
        node, path = self.root, b""
        while len(node.kids) == 1 and node.owner is None:
            (kid,) = node.kids.values()
            if kid.file is not None or not kid.kids:
                break
            node, path = kid, path + kid.label
        weights = {first: self.weight(kid) for first, kid in node.kids.items() if kid.file is None}
        if not weights:
            return None
        return node, max(weights, key=weights.get), path

    def evict(self) -> Iterator[tuple[bytes, Owner]]:
        """Takes the heaviest subtree out and gives its entries."""
        parent, first, path = self.heaviest()
        top = parent.kids.pop(first)
        self.bytes -= self.weight(top)
        return self.entries(top, path)

    def spill(self) -> None:
        """Moves the heaviest subtree into a file; what belongs there later is appended to it."""
        found = self.heaviest()
        if found is None:
            self.limit *= 2  # a single text is longer than the limit
            return
        parent, first, path = found
        top = parent.kids[first]
        out = tempfile.TemporaryFile(dir=self.folder)
        for data, o in self.entries(top, path):
            pickle.dump((data, o.size, o.chars, o.doc_id, o.copies), out)
        for file in self.files(top):
            file.seek(0)
            shutil.copyfileobj(file, out)
            file.close()
        self.bytes -= self.weight(top) - 200
        mark = Node(top.label)
        mark.file = out
        parent.kids[first] = mark

    def add(self, data: bytes, owner: Owner) -> None:
        self.insert(data, owner)
        while self.full():
            self.spill()

    def settle(self) -> Iterator[tuple[bytes, Owner]]:
        """All entries: those in memory, then each spilled subtree, worked through as a trie of its own."""
        files = self.files(self.root)
        yield from self.entries(self.root, b"")
        self.root = Node(b"")
        for file in files:
            file.seek(0)
            inner = PatriciaTrie(self.limit, self.folder)
            while True:
                try:
                    data, *rest = pickle.load(file)
                except EOFError:
                    break
                inner.add(data, Owner(*rest))
            file.close()
            yield from inner.settle()


def local_tries(limit: int):
    """First round: the texts of an input split, each once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, trie = Emitter(ENTRIES), PatriciaTrie(limit)

        def entry(data: bytes, o: Owner):
            return out.add((len(data), hashlib.sha256(data).digest(), data, o.size, o.chars, o.doc_id, o.copies), len(data) + 100)

        for doc_id, text in rows_of(batches):
            chars = len(text.decode("utf-8", "replace"))
            trie.insert(text.translate(None, WHITE), Owner(1, chars, doc_id))
            while trie.full():
                for data, owner in trie.evict():
                    yield from entry(data, owner)
        for data, owner in trie.settle():
            yield from entry(data, owner)
        yield from out.flush()

    return run


def partition_tries(limit: int):
    """Second round: all entries of a partition of (length, hash)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, trie = Emitter(OWNERS), PatriciaTrie(limit)
        for _, _, text, size, chars, keep_id, copies in rows_of(batches):
            trie.add(text, Owner(size, chars, keep_id, copies))
        for data, o in trie.settle():
            yield from out.add((len(data), hashlib.sha256(data).digest(), o.size, o.chars, o.doc_id, o.copies))
        yield from out.flush()

    return run


def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Emitter(KEYS)
    for doc_id, text in rows_of(batches):
        data = text.translate(None, WHITE)
        yield from out.add((doc_id, len(data), hashlib.sha256(data).digest(), len(text.decode("utf-8", "replace"))))
    yield from out.flush()


def owners(docs: DataFrame, limit: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: ``n_bytes, sha, size, keep_chars, keep_id, copies`` (rows equal to the one that stays, itself included)."""
    entries = id_and_text(docs).mapInArrow(local_tries(limit), _ddl(ENTRIES))
    found = entries.repartition("n_bytes", "sha").mapInArrow(partition_tries(limit), _ddl(OWNERS))
    return found


def exact_dedup(docs: DataFrame, limit: int = TRIE_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    mine = id_and_text(docs).mapInArrow(keys, _ddl(KEYS))
    theirs = owners(docs, limit).withColumnsRenamed({"n_bytes": "o_bytes", "sha": "o_sha"})
    joined = mine.join(theirs, (mine.sha == theirs.o_sha) & (mine.n_bytes == theirs.o_bytes))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return joined.select(
        "doc_id", "keep_id", F.col("size").alias("group_size"), stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "copies",
    )


def drop_exact(docs: DataFrame, limit: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    same_id = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    mine = exact_dedup(docs, limit).where(same_id).groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    verdict = materialize(mine.agg(F.count(F.lit(1)).alias("rows")), "exact")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    stripped = F.regexp_replace(text, "[\\x20\\x09-\\x0D]", "")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.sha2(stripped, 256).alias("sha"))
    kept = keyed.join(verdict.drop("rows"), keyed.doc_id.eqNullSafe(F.col("_id")) & (keyed.sha == F.col("_sha")), "left_semi")
    if not verdict.where("rows > 1").isEmpty():  # rows of a group that share the id of the one that stays
        text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
        order = [F.length(text).desc(), text, F.xxhash64(F.to_json("row"))]
        place = F.row_number().over(Window.partitionBy("doc_id", "sha").orderBy(*order))
        kept = kept.withColumn("place", place).where("place = 1")
    return kept.select("row.*")


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(read(spark, folder, "documents")).drop("copies")


OP5_SQL = """
WITH base AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
           sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
    FROM documents
), ranked AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM base
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""
