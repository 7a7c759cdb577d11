"""WARC bundles: what is written comes back, by frames and by ids, and other readers can read it too."""

from __future__ import annotations

import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from lumenforge.llm import warc
from lumenforge.runtime import scratch

LONG = "<p>" + "page text " * 200
ROWS = [
    (1, "http://a.example/x%20y?q=1", LONG + "é"),
    (2, None, LONG + "é"),
    (9, "http://c.example/\r\nWARC-Type: x", LONG + "é"),
    (9, "http://d.example/", LONG + "é"),
    (None, "http://e.example/", LONG + "é"),
    (3, "http://f.example/ü", "short"),
    (4, "", "short"),
    (5, "http://g.example/", None),
    (6, "http://h.example/", ""),
    (None, None, LONG),
    (None, None, LONG),
    (7, "http://i.example/", "\r\n\r\nWARC/1.1\r\n" * 9000),
    (8, "http://j.example/", "x" * 999),
    (10, "http://k.example/", "x" * 999),
    (11, "http://l.example/", "y" * 1000),
    (12, "http://l.example/", "y" * 1000),
]
SCHEMA = "page_id long, url string, html string, payload_digest string, leader long"


def expected():
    out = []
    for page_id, _, html in ROWS:
        data = (html or "").encode()
        same = [r[0] for r in ROWS if (r[2] or "") == (html or "")]
        leader = max((x for x in same if x is not None), default=None)
        revisit = len(data) >= 1000 and page_id != leader
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", leader if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA)


def test_records_come_back(pages):
    assert sorted(map(tuple, warc.archive_and_read(pages).collect()), key=repr) == expected()


def test_small_frames_and_bundles_and_search_by_id(spark, pages):
    folder = scratch(spark, "warc-test")
    index = warc.write_archives(pages.coalesce(1), folder, frame=3000, bundle=600)
    assert index.count() == len(ROWS) and index.select("bundle").distinct().count() > 1 and index.agg(F.max("frame")).first()[0] > 0
    back = warc.read_archives(index.select("bundle"))
    assert sorted(map(tuple, back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == expected()
    assert sorted(repr((r.page_id, r.url)) for r in back.collect()) == sorted(repr(r[:2]) for r in ROWS)
    found = warc.fetch(index, spark.createDataFrame([(9,), (3,), (3,), (77,), (None,)], "page_id long")).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in found) == [(3, "short"), (9, LONG + "é"), (9, LONG + "é")]


def test_a_reader_of_plain_zstandard_reads_the_whole(spark, pages):
    index = warc.write_archives(pages.coalesce(1), scratch(spark, "warc-test"), frame=2000)
    path = index.first().bundle
    fs, at = warc._open(path)
    with fs.open_input_file(at) as f:
        data = f.read()
        table = warc.read_seek_table(f, f.size())
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert len(whole) == sum(x[2] for x in table) and len(table) > 1
    at = n = 0
    while at < len(whole):
        _, at = warc.parse(whole, at)
        n += 1
    assert n == len(ROWS)


def test_no_pages(spark):
    assert warc.archive_and_read(spark.createDataFrame([], SCHEMA)).collect() == []


def test_broken_records_are_told():
    digest = hashlib.sha1(b"abc").hexdigest()
    good = warc.record(1, "u", b"abc", digest, 3, None)
    assert warc.parse(good)[0]["payload"] == b"abc"
    for bad in (good[:-5], good.replace(b"abc", b"abd"), b"x" + good, b""):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        warc.read_seek_table(io.BytesIO(b"1"), 1)
