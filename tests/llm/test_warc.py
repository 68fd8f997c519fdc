import base64
import gzip
import hashlib
from pathlib import Path

import pytest

import __spark_entry__ as entry
from sheafwork.llm import warc


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    first = {}
    for r in sorted(pages, key=lambda r: r.page_id):
        first.setdefault(r.html or "", r.page_id)
    rows = entry.queries()["op5_warc"](spark, d).collect()
    want = sorted(
        (r.page_id, len((r.html or "").encode()), sha((r.html or "").encode()), *(("response", None) if first[r.html or ""] == r.page_id else ("revisit", first[r.html or ""])))
        for r in pages
    )
    assert sorted(map(tuple, rows), key=lambda r: r[0]) == want


@pytest.fixture
def pages(spark):
    rows = [(3, "http://www.b.example/x?q=1#top", "<p>same</p>", "z"), (1, "https://a.example:8080/y", "<p>same</p>", "z"), (2, None, None, "z"), (5, "no url\r\nat all", "", "z")]
    rows += [(4, "http://a.example/long", "é" * 300_000, None), (None, "http://c.example/", "<p>same</p>", "z"), (1, "https://a.example:8080/y", "<p>same</p>", "z")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, surt string")


def test_round_trip(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    archive = warc.write(pages, str(tmp_path / "w"))
    got = sorted((tuple(r) for r in warc.read(archive).collect()), key=repr)
    assert [(r[0], r[2], r[3], r[5] if r[5] is None else bytes(r[5]).decode()[:5]) for r in got] == [
        (1, "response", None, "<p>sa"),
        (1, "response", None, "<p>sa"),
        (2, "response", None, ""),
        (3, "revisit", 1, None),
        (4, "response", None, "é" * 5),
        (5, "revisit", 2, None),
        (None, "response", None, "<p>sa"),
    ]
    out = {(r.page_id, r.payload_bytes, r.payload_digest) for r in warc.resolved(warc.read(archive)).collect()}
    assert (3, 11, sha(b"<p>same</p>")) in out and (4, 600_000, sha(("é" * 300_000).encode())) in out
    for file in Path(tmp_path / "w").glob("archive*.gz"):  # every archive is also a plain sequence of gzip members
        assert gzip.decompress(file.read_bytes()).count(b"WARC/1.1\r\n") >= 1


def test_lookup_reads_only_blocks_that_may_hold_a_key(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 1)
    archive = warc.write(pages, str(tmp_path / "w"))
    assert archive.directory.count() == 7
    urls = spark.createDataFrame([("http://www.b.example/x?q=1",), ("https://a.example/y",), ("http://none.example/",), (None,)], "url string")
    for most in (500_000, 0):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
        assert sorted(r.page_id for r in warc.lookup(archive, urls).collect()) == [1, 1, 2, 3]


def test_many_keys_over_many_index_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "INDEX_BYTES", 1)  # an index file a block
    rows = [(i % 40 if i % 9 else None, f"http://h{i % 7}.example/{i % 5}", f"p{i % 3}") for i in range(150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (500_000, 0):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
        monkeypatch.setattr(warc, "HOT_PAGES", 45)
        archive = warc.write(pages, str(tmp_path / f"w{most}"))
        assert archive.directory.select("file").distinct().count() == archive.directory.count() > 40
        pairs = sorted((r[0] is not None, r[0] or 0, r[1]) for r in rows)
        found = warc.lookup(archive, pages, "url", "page_id")
        records = warc.records_at(archive, found).collect()
        assert sorted((r.page_id is not None, r.page_id or 0, r.url) for r in records) == pairs
        first = {p: min(r[0] for r in rows if r[2] == p and r[0] is not None) for p in ("p0", "p1", "p2")}
        assert {r.refers_to for r in records if r.record_type == "revisit"} == set(first.values())
        assert all(r.payload_bytes == 2 for r in records)
        assert sorted((r[1] for r in rows if r[1] in ("http://h3.example/1", "http://h0.example/0"))) == sorted(
            r.url for r in warc.records_at(archive, warc.lookup(archive, spark.createDataFrame([("http://h3.example/1",), ("http://h0.example/0",)], "url string"))).collect()
        )


def test_small_payloads_are_not_revisited(spark, pages, tmp_path):
    records = warc.read(warc.write(pages, str(tmp_path / "w"), min_payload=20)).collect()
    assert {r.record_type for r in records} == {"response"}


def test_no_rows(spark, pages):
    archive = warc.write(pages.where("false"))
    assert warc.read(archive).count() == 0 and archive.directory.count() == 0


def test_broken_records_are_refused():
    good = warc.record_bytes(1, "http://a.example/", b"payload", None, "1970-01-01T00:00:00Z")
    text = gzip.decompress(good)
    assert warc.parse_record(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(gzip.compress(text.replace(b"payload\r\n\r\n", b"paxload\r\n\r\n")))
    with pytest.raises(ValueError):
        warc.parse_record(gzip.compress(text[:-6] + text[-4:]))
