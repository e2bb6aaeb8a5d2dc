import base64
import hashlib
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ribeira.llm import warc
from ribeira.llm.warc import Run, capture_time, loser_tree, merge_runs, parse, read_archives, read_payloads, url_key, write_archives

PAGES = [
    (1, "http://b.example/x#f", "<p>same</p>"), (2, "https://A.example:443/y?q=1", "<p>same</p>"), (3, None, None), (4, "", ""),
    (5, "http://a.example/a b\r\nWARC-Type: fake", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n"), (6, "http://u@a.example", "é\r\n" * 50_000),
    (7, "http://b.example/x", "<p>same</p>"), (7, "http://b.example/x", "<p>same</p>"), (None, "http://c.example/", "<p>same</p>"), (None, "http://d.example/", "alone"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "z", "z") for p in PAGES], "page_id long, url string, html string, refers_to string, record string").repartition(3)


@pytest.fixture
def archives(spark, pages, tmp_path):
    write_archives(pages, f"file://{tmp_path}/w", archive_bytes=2000)
    return f"file://{tmp_path}/w"


def test_records_come_back(spark, archives):
    rows = read_archives(spark, archives).collect()
    want = []
    owner = {}
    for page_id, _, html in PAGES:
        if page_id is not None:
            owner[html or ""] = max(owner.get(html or "", 0), page_id)
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        first = owner.get(html or "")
        revisit = first is not None and first != page_id
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page_id, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_payloads_come_back(spark, archives):
    got = {bytes(r.payload) for r in read_payloads(spark, archives).collect()}
    assert got == {(html or "").encode() for _, _, html in PAGES}


def test_smallest_payload_of_a_revisit(spark, pages, tmp_path):
    write_archives(pages, f"file://{tmp_path}/v", least=1)
    types = {(r.page_id, r.record_type) for r in read_archives(spark, f"file://{tmp_path}/v").collect()}
    assert {(3, "response"), (4, "response"), (1, "revisit")} <= types


def test_index_is_in_global_order(spark, archives):
    rows = merge_runs(read_archives(spark, archives)).orderBy("index_part", "index_pos").collect()
    keys = [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0) for r in rows]
    assert len(rows) == len(PAGES) and keys == sorted(keys)
    assert len({r.archive for r in rows}) > 1


def test_histories_of_urls_come_in_order_of_time(spark, tmp_path):
    """Thirty URLs captured many times each, over many archives, merged in small key ranges."""
    rows = [(i, f"http://h{i * 7 % 3}.example/{i * 11 % 10}", f"text {i % 40}") for i in range(900)] + [(None, "http://h0.example/0", "none")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    write_archives(pages, f"file://{tmp_path}/t", captured_at=capture_time(F.col("page_id")), archive_bytes=50_000)
    got = merge_runs(read_archives(spark, f"file://{tmp_path}/t")).orderBy("index_part", "index_pos").collect()

    def second(page_id):
        return datetime(2024, 1, 1) + timedelta(seconds=page_id * 7919 % (366 * 86400))

    times = {p: "1970-01-01T00:00:00Z" if p is None else second(p).strftime("%Y-%m-%dT%H:%M:%SZ") for p, _, _ in rows}
    want = sorted((url_key(u), times[p], p is not None, p or 0) for p, u, _ in rows)
    assert [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0) for r in got] == want
    assert len({r.archive for r in got}) > 4 and len({r.captured_at for r in got}) > 800


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_runs_are_read_some_blocks_at_a_time(tmp_path, blocks):
    with open(tmp_path / "runs", "w+b") as file:
        runs, want = [], []
        for i in range(5):
            rows, places = sorted((i * 7 + j * 3) % 50 for j in range(i * 9)), []
            for low in range(0, len(rows), 4):
                data = warc.pickle.dumps(rows[low : low + 4])
                places.append((file.seek(0, 2), len(data)))
                file.write(data)
            runs.append(Run(file, places, blocks))
            want += rows
        assert list(loser_tree(runs, key=lambda x: x)) == sorted(want)


def test_records_stand_where_the_index_says(spark, archives):
    for r in read_archives(spark, archives).collect():
        with open(r.archive.removeprefix("file:"), "rb") as file:
            file.seek(r.offset)
            (found,) = parse(file.read(r.length))
        assert found[2]["warc-type"] == r.record_type


def test_empty_table(spark, tmp_path):
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert os.path.isdir(tmp_path / "e") and merge_runs(read_archives(spark, f"file://{tmp_path}/e")).collect() == []


def test_broken_archives_raise():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [bytes(block) for *_, block in parse(good * 2)] == [b"ab", b"ab"]
    for bad in (good[:-2], b"x" + good, good.replace(b"2", b"1")):
        with pytest.raises(ValueError):
            list(parse(bad))


def test_keys_of_urls():
    assert url_key("https://WWW.Example.com:443/a/B?q#f") == "com,example,www)/a/B?q"
    assert url_key("http://example.com") == "com,example)/"
    assert url_key("example.com:8080/x") == "com,example:8080)/x"
    assert url_key("") == ""


def test_loser_tree_merges_any_number_of_runs():
    class Memory(Run):
        def __init__(self, rows):
            super().__init__(None, [])
            self.block = rows

    for k in range(8):
        runs = [sorted((i * 7 + j * 3) % 11 for j in range(i)) for i in range(k)]
        assert list(loser_tree([Memory(r) for r in runs], key=lambda x: x)) == sorted(x for r in runs for x in r)
