"""Archives written and read back; magic and whole records inside payloads; splits of any size."""

import base64
import hashlib
import uuid

import pytest

from dosewise.llm import warc
from dosewise.llm.common import read
from dosewise.llm.queries import op5_warc
from dosewise.plans.session import shared_dir

COLS = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]


def brute(rows, least=0):
    first = {}
    for p, _, html in rows:
        b = (html or "").encode()
        if len(b) >= least:
            first[b] = min(first.get(b, 1 << 62), 1 << 62 if p is None else p)
    out = []
    for p, url, html in rows:
        b = (html or "").encode()
        again = len(b) >= least and first[b] < (1 << 62 if p is None else p)
        out.append((p, (url or "").replace("\r", " ").replace("\n", " "), "revisit" if again else "response", first[b] if again else None, len(b),
                    base64.b32encode(hashlib.sha1(b).digest()).decode(), None if again else b))
    return sorted(out, key=str)


def round_trip(spark, pages, least=0, files=None):
    path = f"{shared_dir(spark, 'llm')}/test-{uuid.uuid4().hex}"
    warc.write_archives(pages if files is None else pages.coalesce(files), path, least)
    out = warc.read_archives(spark, path).select(*COLS, "digest_ok").collect()
    assert all(r["digest_ok"] is not False for r in out)
    return sorted((tuple(None if r[c] is None else bytes(r[c]) if c == "payload" else r[c] for c in COLS) for r in out), key=str)


@pytest.fixture()
def small_splits(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_round_trip_of_the_corpus(spark, sf):
    pages = read(spark, sf, "pages")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert round_trip(spark, pages) == brute(rows)
    got = sorted((tuple(r) for r in op5_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == sorted(((r[0], r[4], r[5], r[2], r[3]) for r in brute(rows)), key=str)


def decoys():
    whole = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n"
    rows = [
        (1, "http://a", "plain"), (2, None, None), (3, "u\r\nWARC-Type: x", ""), (None, "n", "plain"), (4, "d", "plain"), (4, "d", "plain"), (1, "http://a", "plain"),
        (5, "m", "WARC/1.1\r\n"), (6, "w", whole), (7, "w", "x" + whole * 40 + "tail"), (8, "h", whole[:-30]), (9, "e", "\r\n\r\n" * 9 + "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n"),
        (10, "é", "über ☃ \U0001f600 \x00 " * 50), (11, "s", "WARC/1.1\r\n" * 60), (12, "neg", "WARC/1.1\r\nContent-Length: -5\r\n\r\nzz"), (None, None, "only null"), (13, "w", whole),
    ]
    return rows + [(100 + i, f"http://p/{i}", f"body {i % 7} " * (i % 5)) for i in range(60)]


SCHEMA = "page_id bigint, url string, html string, record_type string, k int"


@pytest.mark.parametrize("size", [97, 400, 1 << 20])
def test_magic_inside_payloads_is_rejected(spark, small_splits, size):
    pages = spark.createDataFrame([(*r, "x", 1) for r in decoys()], SCHEMA)
    if size < 1000:
        pages = pages.coalesce(1)
    path = f"{shared_dir(spark, 'llm')}/test-{uuid.uuid4().hex}"
    warc.write_archives(pages, path)
    small_splits(size)
    out = warc.read_archives(spark, path).select(*COLS).collect()
    assert sorted((tuple(None if r[c] is None else bytes(r[c]) if c == "payload" else r[c] for c in COLS) for r in out), key=str) == brute(decoys())


@pytest.mark.parametrize("before, after", [(400, 1 << 20), (1 << 20, 400)])
def test_splits_may_change_after_the_archives_are_verified(spark, small_splits, before, after):
    path = f"{shared_dir(spark, 'llm')}/test-{uuid.uuid4().hex}"
    warc.write_archives(spark.createDataFrame([(*r, "x", 1) for r in decoys()], SCHEMA).coalesce(1), path)
    small_splits(before)
    found = warc.read_archives(spark, path).select(*COLS)
    small_splits(after)
    out = found.collect()
    assert sorted((tuple(None if r[c] is None else bytes(r[c]) if c == "payload" else r[c] for c in COLS) for r in out), key=str) == brute(decoys())


def test_content_length_is_read_at_a_line_start(spark):
    rows = [(1, "http://a", "one"), (2, "http://b/?q=Content-Length:4&content-length: 7", "two"), (3, "content-length:", "three")] + [(10 + i, "u", f"later {i}") for i in range(5)]
    assert round_trip(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string"), files=1) == brute(rows)
    foreign = "".join(f"WARC/1.1\r\nX-Orig-Content-Length: 99\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\ncontent-length: 4\r\n\r\nbody\r\n\r\n" for i in range(3))
    path = f"{shared_dir(spark, 'llm')}/test-{uuid.uuid4().hex}"
    spark.createDataFrame([(foreign,)], "text string").write.option("lineSep", "\n").text(path)
    assert sorted((r["page_id"], bytes(r["payload"])) for r in warc.read_archives(spark, path).collect()) == [(i, b"body") for i in range(3)]


def test_small_payloads_need_not_be_revisits(spark):
    pages = spark.createDataFrame([(*r, "x", 1) for r in decoys()], SCHEMA)
    assert round_trip(spark, pages, least=30) == brute(decoys(), 30)


def test_no_pages(spark):
    assert round_trip(spark, spark.createDataFrame([], SCHEMA)) == []


def test_pointer_jumping_reaches_the_chain_and_nothing_else(spark):
    edges = [("a", i, i + 3) for i in range(0, 300, 3)] + [("a", i, i + 2) for i in range(1, 50, 3)] + [("b", 0, 500)]
    got = warc.reached(spark.createDataFrame(edges, "file string, at bigint, to bigint"), spark.createDataFrame([("a", 0), ("b", 0)], "file string, at bigint"))
    assert {(r["file"], r["at"]) for r in got.collect()} == {("a", i) for i in range(0, 301, 3)} | {("b", 0), ("b", 500)}


def test_foreign_record_ids_and_a_payload_of_many_magics(spark):
    for text in ("<urn:page:²>", "<urn:page:--5>", "<urn:page:>", "<urn:uuid:1a>", None, "", "<urn:page:99999999999999999999>", "<urn:page:9223372036854775808>"):
        assert warc._page(text) is None
    assert [warc._page(f"<urn:page:{i}>") for i in (5, -5, -(1 << 63), (1 << 63) - 1)] == [5, -5, -(1 << 63), (1 << 63) - 1]
    rows = [(1, "u", "WARC/1.1\r\n" * 20_000), (2, "u", "after")]
    assert round_trip(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string"), files=1) == brute(rows)
