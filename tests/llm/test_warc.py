from __future__ import annotations

import hashlib
import os

import pytest

from segue.llm import warc
from segue.llm.common import shared_dir


def test_both_arc_versions():
    blocks = [b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhello\nworld", b"HTTP/1.0 200 OK\r\n\r\n", b"plain\n\n\nbytes\xff"]
    for version in (1, 2):
        data = warc.arc_version_block(version) + b"".join(warc.arc_record(version, f"http://a/{i}", "19990102030405", x) for i, x in enumerate(blocks))
        for size in (1, 7, 10_000):
            chunks = (data[i : i + size] for i in range(0, len(data), size))
            found = list(warc.parse_arc(chunks))
            assert [b for _, b in found] == blocks and [h["url"] for h, _ in found] == ["http://a/0", "http://a/1", "http://a/2"]
        records = list(warc.parse_warc(iter([b"".join(warc.convert(iter([data])))])))
        assert [h["warc-type"] for h, _ in records] == ["response", "response", "resource"]
        assert records[0][0]["warc-date"] == "1999-01-02T03:04:05Z"
        assert records[0][0]["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"hello\nworld").hexdigest()
    with pytest.raises(ValueError):
        list(warc.parse_arc(iter([b"http://a 1 2 3 4\nxx"])))


def test_files_are_converted(spark):
    folder = shared_dir(spark).removeprefix("file:") + "/arcs"
    os.makedirs(folder, exist_ok=True)
    data = warc.arc_version_block(2) + warc.arc_record(2, "http://x/", "2001", b"HTTP/1.1 200 OK\r\nX-Page-Id: 3\r\n\r\nabc")
    for name, raw in (("a.arc", data), ("b.arc.gz", warc.gzip_member(data[:50]) + warc.gzip_member(data[50:]))):
        with open(f"{folder}/{name}", "wb") as out:
            out.write(raw)
    made = warc.convert_files(spark.createDataFrame([(f"file://{folder}/{n}",) for n in ("a.arc", "b.arc.gz")], "uri string"), f"file://{folder}/warc")
    rows = warc.read_records(made).collect()
    assert [(r["page_id"], r["payload_bytes"], r["sound"]) for r in rows] == [(3, 3, True)] * 2


def test_pages_come_back(spark):
    big, small = "é" * 60, "s" * 99
    pages = [(5, "http://a/5", big), (2, "http://a/2 x", big), (9, None, big), (1, "u", small), (0, "u", small), (7, "http://a/7", None), (8, "", ""), (None, "http://n", big), (4, "http://a/4", "x\r\n\r\nWARC/1.0\r\n" * 20)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string")
    rows = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert len(rows) == len(pages) and all(r["sound"] for r in rows.values())
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (rows[i]["payload_bytes"], rows[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in rows.items()} == {i: ("revisit", 2) if i in (5, 9) else ("response", None) for i, *_ in pages}
    assert warc.round_trip(df.where("false")).count() == 0


def test_odd_urls_and_repeated_rows(spark):
    urls = ["filedesc://x/y", "filedesc:z", "FILEDESC://x", "http://a/\u00a0b\u2028c\x85d", "a\nb\rc\td", "WARC/1.0", "://", " "]
    rows = [(i, u, f"page {i} " * 40) for i, u in enumerate(urls)] * 2 + [(50, "http://r", "s" * 200)] * 3
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r["sound"] for r in got)
    assert sorted((r["page_id"], r["payload_digest"]) for r in got) == sorted((i, hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows)
    assert {r["record_type"] for r in got} == {"response"}


def test_a_record_of_the_scheme_of_version_blocks():
    data = warc.arc_version_block(1) + warc.arc_record(1, "filedesc://own", "2001", b"HTTP/1.1 200 OK\r\n\r\nabc") + warc.arc_version_block(2) + warc.arc_record(2, "http://b", "2001", b"x")
    assert [(h["url"], b) for h, b in warc.parse_arc(iter([data]))] == [("filedesc://own", b"HTTP/1.1 200 OK\r\n\r\nabc"), ("http://b", b"x")]
    with pytest.raises(ValueError):
        list(warc.parse_arc(iter([warc.arc_version_block(1).replace(b"1 0", b"7 0")])))
