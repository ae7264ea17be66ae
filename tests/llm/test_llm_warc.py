"""WARC archives: pages written in segments and read back, and archives that others damaged."""

from __future__ import annotations

import gzip
import hashlib

from llm import common, warc
from newscorpus.operators import keyed

SCHEMA = "page_id bigint, url string, html string, row long, first string, digest int, payload string, status string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", 2, "p", "s") for r in rows], SCHEMA)


def wanted(rows):
    """What ``archived`` has to tell, from the rows alone."""
    out, first = [], {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (html or "").encode()
        kind, of = "response", None
        if len(data) >= 100 and data in first:
            kind, of = "revisit", first[data]
        first.setdefault(data, page)
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), kind, of, "ok"))
    return sorted(out, key=repr)


def told(df):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


ROWS = [
    (1, "http://a/1", "x" * 99),
    (2, "http://a/2", "x" * 99),
    (7, "http://a/7", "y" * 100),
    (5, "http://a/5\r\nWARC-Type: fake", "y" * 100),
    (5, "http://a/5", "y" * 100),
    (9, None, "é€😀" * 700),
    (8, "http://a/WARC/1.1", "é€😀" * 700),
    (None, "http://a/n", "é€😀" * 700),
    (None, None, None),
    (11, "", ""),
    (12, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 9),
    (13, "u", "WARC/1.WARC/1.\r\n\r\nWARC/1.0"),
    (14, "u", "\r\n\r\n0\r\n\r\nWARC/1.1" * 200),
    (15, "u", "long " * 400_000),
]


def test_pages_come_back(spark, tmp_path):
    for n, (chunk, segment) in enumerate([(7, 40), (100, 1000), (8192, 32768)]):
        found = warc.archived(pages(spark, ROWS[:-1] if n == 0 else ROWS), str(tmp_path / str(n)), chunk=chunk, segment=segment)
        assert told(found) == wanted(ROWS[:-1] if n == 0 else ROWS)


def test_whole_payloads_and_fields(spark, tmp_path):
    warc.write_archives(pages(spark, ROWS), str(tmp_path / "a"), chunk=50, segment=333)
    got = {r["page"]: r for r in warc.read_archives(spark, str(tmp_path / "a")).collect() if r["page"]}
    for page, url, html in ROWS:
        if page in (2, 8, 12, 13, 14, 15):
            r = got[str(page)]
            assert bytes(r["payload"]).decode() == html and r["status"] == "ok" and r["target_uri"] == url
            assert r["payload_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert got["9"]["record_type"] == "revisit" and got["9"]["refers_to"] == got["8"]["record_id"] and got["9"]["payload"] is None
    segments = warc.read_records(spark, str(tmp_path / "a"), segments=True).where("record_type = 'continuation'")
    assert segments.count() > 1000 and segments.where("origin is null").count() == 0


def test_many_copies_by_shuffle_and_as_hot_keys(spark, tmp_path, monkeypatch):
    rows = [(i, "u", ("same " if i % 3 else f"{i % 40} ") * 60) for i in range(300)]
    plain = told(warc.archived(pages(spark, rows), str(tmp_path / "a")))
    monkeypatch.setattr(keyed, "MAX_BROADCAST_KEYS", 3)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    assert plain == told(warc.archived(pages(spark, rows), str(tmp_path / "b"))) == wanted(rows)


def test_no_pages(spark, tmp_path):
    assert told(warc.archived(pages(spark, []), str(tmp_path / "a"))) == []


def record(block: bytes, *fields: str, size: int | None = None) -> bytes:
    head = "\r\n".join(["WARC/1.0", *fields, f"Content-Length: {len(block) if size is None else size}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http(body: bytes, *fields: str) -> bytes:
    return "\r\n".join(["HTTP/1.1 200 OK", *fields]).encode() + b"\r\n\r\n" + body


CHUNKED = "Transfer-Encoding: Chunked"


def test_other_archives(spark, tmp_path):
    block = http(b"5;name=x\r\nhello\r\n3\r\n\r\n!\r\n0\r\n\r\n", CHUNKED)

    def segment(n, data, own="", *more):
        return record(data, "WARC-Type: continuation", f"WARC-Segment-Origin-ID: <{own}>", f"WARC-Segment-Number: {n}", *more)

    def first(own, data):
        return record(data, "WARC-Type: response", f"WARC-Record-ID: <{own}>", "WARC-Segment-Number: 1")

    total = f"WARC-Segment-Total-Length: {len(block)}"
    one = [
        record(b"software: x\r\n", "WARC-Type: warcinfo", "WARC-Record-ID: <info>"),
        segment(3, block[40:], "whole", total),
        segment(2, block[20:40], "gap"),
        segment(2, block[20:40], "clash"), segment(2, block[21:41], "clash"),
        segment(2, block[20:], "short", f"WARC-Segment-Total-Length: {len(block) + 1}"),
        segment(2, block[20:], "open"),
        record(http(b"plain"), "WARC-Type: response", "WARC-Record-ID: <plain>", "X-Page-ID: 4"),
        record(http(b"5\r\nhell", CHUNKED), "WARC-Type: response", "WARC-Record-ID: <broken>"),
    ]
    two = [
        first("whole", block[:20]), segment(2, block[20:40], "whole"), segment(2, block[20:40], "whole"),
        first("gap", block[:20]), segment(4, block[40:], "gap", total),
        first("clash", block[:20]), segment(3, block[41:], "clash", total),
        first("short", block[:20]), first("open", block[:20]),
        record(http(b"lost"), "WARC-Type: response", "WARC-Record-ID: <damaged>", size=90),
        record(http(b"after"), "WARC-Type: response", "WARC-Record-ID: <after>"),
        b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <none>\r\n\r\nno length\r\n\r\n",
        record(http(b"cut off"), "WARC-Type: response", "WARC-Record-ID: <end>")[:-9],
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.warc").write_bytes(b"".join(one))
    (tmp_path / "in" / "two.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in two))  # a member for each record
    got = {r["record_id"].strip("<>"): (r["status"], r["payload"] and bytes(r["payload"])) for r in warc.read_archives(spark, str(tmp_path / "in")).collect()}
    assert got == {
        "info": ("no http head", None),
        "whole": ("ok", b"hello\r\n!"),
        "gap": ("missing segment", None),
        "clash": ("conflicting segments", None),
        "short": ("wrong length", None),
        "open": ("missing segment", None),
        "plain": ("ok", b"plain"),
        "broken": ("broken chunks", None),
        "damaged": ("wrong length", None),
        "after": ("ok", b"after"),
        "none": ("wrong length", None),
        "end": ("wrong length", None),
    }
