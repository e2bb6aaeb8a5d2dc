"""WARC archives of web pages, and their index in global order.

``write_archives`` turns pages into WARC 1.1 records and lets Spark's text writer put them into files: a record is
one value, and the writer's line separator is the blank line pair that ends every record. So archives lie wherever Spark can
write, and a lost executor costs its tasks only. Of equal payloads, the one with the largest ``page_id`` is written
whole as ``response``; the others are ``revisit`` records that name it and keep the HTTP header only.

``read_archives`` takes every archive apart by the lengths in its headers, checks each payload against its digest, and
gives one capture run per archive, sorted by URL key, timestamp and page. ``merge_runs`` deals these runs out by key
range and merges the pieces of each range with a loser tree, outside memory: every run's piece lies in a temporary file
of the task, and only a few blocks of each are held, fewer the more runs there are. ``(index_part, index_pos)`` is the global order.

Defined cases: a null payload is empty; a null or empty URL gives an empty target and the first key. A null ``page_id``
revisits the largest page of equal payload, and is a response where that has none. Rows that repeat the largest ``page_id``
are all responses. Control characters and blanks in URLs are percent-encoded. An empty table gives no records. Columns other
than ``page_id``, ``url``, ``html`` (and a named date column) are not read.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import re
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ribeira.llm.common import Emitter, read
from ribeira.session import materialize, work_dir

ARCHIVE_BYTES = 32 << 20
"""Aimed-at size of an archive; a reader holds one archive at a time."""
BLOCK_ROWS = 128
BLOCKS = 16
"""Blocks of a run that a merge holds at most."""
HELD_ROWS = 500_000
"""Rows of all runs that a merge holds, where one block of each is no more than that."""
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"

CAPTURES = pa.schema([
    ("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
    ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("seq", pa.int64()),
])
CAPTURES_DDL = (
    "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, url string, archive string, offset long, length long, seq long"
)
INDEX = pa.schema([*CAPTURES, ("index_part", pa.int64()), ("index_pos", pa.int64())])
INDEX_DDL = CAPTURES_DDL + ", index_part long, index_pos long"
PAYLOAD_DDL = "page_id long, url string, captured_at string, payload binary"


def base32(hexadecimal: Column) -> Column:
    """Base32 of a hexadecimal text whose length is a multiple of five."""
    letters = []
    for at in range(0, 40, 5):
        value = F.conv(F.substring(hexadecimal, at + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def decide(pages: DataFrame, least: int, captured_at: Column) -> DataFrame:
    """Pages with payload digest, and ``refers_to`` where the page is a revisit."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), captured_at.cast("string").alias("captured_at"),
    ).withColumn("same", F.sha2("html", 256))
    repeated = (
        rows.where(F.octet_length("html") >= least).groupBy(F.col("same").alias("o_same"))
        .agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1 and owner is not null").drop("n")
    )
    owners = materialize(repeated, "payload-owners")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return (
        rows.join(owners, rows.same == owners.o_same, "left")
        .withColumn("refers_to", F.when(revisit, F.col("owner"))).drop("same", "o_same", "owner")
    )


def records(decided: DataFrame) -> DataFrame:
    """One column ``record``: the WARC record of each page without its closing blank lines."""
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    target = F.col("url")
    for code in (*range(33), 127):
        target = F.replace(target, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.coalesce(F.col("captured_at"), F.lit("1970-01-01T00:00:00Z"))),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.sha1("html"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return decided.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block).alias("record"))


def write_archives(pages: DataFrame, path: str, least: int = 0, captured_at: Column | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes the archives below ``path``. Payloads under ``least`` bytes are never revisits."""
    total = pages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("size")).first()
    most = max(1, int(archive_bytes * total.n / (1 + (total.size or 0) + 600 * total.n)))
    date = F.lit("2024-01-01T00:00:00Z") if captured_at is None else captured_at
    records(decide(pages, least, date)).write.option("lineSep", END).option("maxRecordsPerFile", most).text(path)


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """Offset, length, headers and block of each record. The block is a view."""
    view, at = memoryview(content), 0
    while at < len(content):
        cut = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:cut].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"no WARC record at offset {at}")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        start, size = cut + 4, int(headers["content-length"])
        if content[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at offset {at} doesn't end where its length says")
        yield at, start + size + 4 - at, headers, view[start : start + size]
        at = start + size + 4


def page_of(record_id: str | None) -> int | None:
    name = (record_id or "").rpartition(":")[2].rstrip(">")
    return int(name) if name not in ("", "none") else None


def url_key(url: str) -> str:
    """Sort-friendly key: host labels from the right, then path and query; scheme, fragment and default port are left out."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://+", "", url).partition("#")[0]
    host, path = re.match(r"([^/?]*)(.*)", rest, re.S).groups()
    host, port = re.match(r"(.*?)(:\d*)?$", host.rpartition("@")[2].lower(), re.S).groups()
    port = "" if port in (None, ":", ":80", ":443") else port
    return ",".join(reversed(host.split("."))) + port + ")" + (path or "/") if host else ""


def http_parts(block: memoryview) -> tuple[int, memoryview]:
    raw = bytes(block[:4096])
    cut = raw.index(b"\r\n\r\n")
    return int(re.search(rb"Content-Length: (\d+)", raw[:cut])[1]), block[cut + 4 :]


def _captures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Emitter(CAPTURES)
    for batch in batches:
        for i in range(batch.num_rows):
            archive, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            run = []
            for offset, length, headers, block in parse(content):
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                size, payload = http_parts(block)
                if headers["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"{archive}: the payload at offset {offset} doesn't have its digest")
                url = headers.get("warc-target-uri", "")
                run.append((
                    url_key(url), headers["warc-date"], page_of(headers["warc-record-id"]), size, digest,
                    headers["warc-type"], page_of(headers.get("warc-refers-to")), url, archive, offset, length,
                ))
            run.sort(key=order)
            for seq, row in enumerate(run):
                yield from out.add((*row, seq), 300)
    yield from out.flush()


def order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives below ``path``, one sorted run per archive."""
    return _files(spark, path).mapInArrow(_captures, CAPTURES_DDL)


def _payloads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Emitter(pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("captured_at", pa.string()), ("payload", pa.binary())]))
    for batch in batches:
        for i in range(batch.num_rows):
            for _, _, headers, block in parse(batch.column(1)[i].as_py()):
                if headers["warc-type"] == "response":
                    body = bytes(http_parts(block)[1])
                    yield from out.add((page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-date"], body), len(body) + 200)
    yield from out.flush()


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, captured_at, payload`` of all response records."""
    return _files(spark, path).mapInArrow(_payloads, PAYLOAD_DDL)


class Run:
    """A sorted run in a file, read ``blocks`` blocks at a time."""

    def __init__(self, file, places: list[tuple[int, int]], blocks: int = 1):
        self.file, self.places, self.blocks, self.next, self.block, self.at = file, places, blocks, 0, [], 0

    def head(self) -> tuple | None:
        if self.at == len(self.block):
            if self.next >= len(self.places):
                return None
            self.block, self.at = [], 0
            for start, size in self.places[self.next : self.next + self.blocks]:
                self.file.seek(start)
                self.block += pickle.loads(self.file.read(size))
            self.next += self.blocks
        return self.block[self.at]


def loser_tree(runs: list[Run], key=order) -> Iterator[tuple]:
    """Merges sorted runs. Each inner node keeps the loser of its match; after a row goes out, only the winner's path is played again."""
    k = len(runs)
    if not k:
        return
    heads: list = [run.head() for run in runs]
    keys: list = [None if h is None else key(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        return keys[b] is None or keys[a] is not None and (keys[a], a) < (keys[b], b)

    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    winner = winners[1] if k > 1 else 0
    while heads[winner] is not None:
        yield heads[winner]
        runs[winner].at += 1
        heads[winner] = runs[winner].head()
        keys[winner] = None if heads[winner] is None else key(heads[winner])
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a key range, run after run, in global order."""
    part, out = TaskContext.get().partitionId(), Emitter(INDEX)
    with tempfile.TemporaryFile() as file:
        places: dict[str, list[tuple[int, int]]] = {}
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            low = 0
            while low < len(rows):
                high = low
                while high < len(rows) and high - low < BLOCK_ROWS and rows[high][8] == rows[low][8]:
                    high += 1
                data = pickle.dumps(rows[low:high])
                places.setdefault(rows[low][8], []).append((file.seek(0, 2), len(data)))
                file.write(data)
                low = high
        blocks = min(BLOCKS, max(1, HELD_ROWS // (BLOCK_ROWS * max(1, len(places)))))
        for pos, row in enumerate(loser_tree([Run(file, p, blocks) for p in places.values()])):
            yield from out.add((*row, part, pos), 300)
    yield from out.flush()


def merge_runs(captures: DataFrame) -> DataFrame:
    """Captures with ``index_part`` and ``index_pos``. Ranges end inside a URL's history if that is long."""
    ranges = captures.repartitionByRange("url_key", "captured_at", F.asc_nulls_first("page_id"), "archive", "offset")
    return ranges.sortWithinPartitions("archive", "seq").mapInArrow(_merge, INDEX_DDL)


def capture_time(page_id: Column) -> Column:
    """A second of the year 2024 that depends on the page, in any session's time zone; null for a null page."""
    second = F.pmod(F.pmod(page_id, F.lit(366 * 86400)) * 7919, F.lit(366 * 86400)).cast("int")
    of_day = second % 86400
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(second / 86400).cast("int")).cast("string")
    time = F.format_string("%sT%02d:%02d:%02dZ", day, F.floor(of_day / 3600), F.floor(of_day % 3600 / 60), of_day % 60)
    return F.when(page_id.isNotNull(), time)


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages have no date of their own, so each is captured at a time that its id gives."""
    path = work_dir(spark, "warc")
    write_archives(read(spark, folder, "pages"), path, captured_at=capture_time(F.col("page_id")))
    index = merge_runs(materialize(read_archives(spark, path), "captures"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH base AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), digits AS (
    SELECT page_id, html, list_aggregate(list_transform(range(40), lambda i: substr(
        '0000000100100011010001010110011110001001101010111100110111101111',
        1 + 4 * (strpos('0123456789abcdef', substr(hex, i + 1, 1)) - 1), 4)), 'string_agg', '') AS bits
    FROM base
), owned AS (
    SELECT *, max(page_id) OVER (PARTITION BY html) AS owner FROM digits
)
SELECT page_id, strlen(html) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
           + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
           + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM owned
"""
