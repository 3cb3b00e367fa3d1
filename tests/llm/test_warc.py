import base64
import hashlib

import pytest

from sonolith.llm import warc

SCHEMA = "page_id long, url string, html string, block string"


def test_chunked_round_trip_and_faults():
    for p in (b"", b"x", bytes(range(256)) * 100):
        assert warc.unchunked(warc.chunked(p)) == p
    for bad in (b"", b"5\r\nab\r\n0\r\n\r\n", b"2\r\nabXX0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_round_trip(spark):
    pages = [(1, "http://a/\r\nX: y", "é" * 40_000), (2, None, None), (3, "u", ""), (4, "u", "same"), (9, "u", "same"), (5, "u", "same"), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 3000), (7, "u", "\x00\x01 \n")]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame([(*p, "x") for p in pages], SCHEMA)).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        data = (html or "").encode()
        holder = max(j for j, _, h in pages if (h or "") == (html or ""))
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.intact) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), True)
        assert (r.record_type, r.refers_to) == (("response", None) if holder == i else ("revisit", holder))
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_payload_survives_and_faults_show(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"{k}ü" * 30_000, "") for k in range(5)], SCHEMA)
    warc.write_archives(pages, str(tmp_path / "w"))
    segments = warc.read_segments(spark, str(tmp_path / "w")).cache()
    assert segments.where("segment > 1").count() > 0
    whole = {r.origin: bytes(r.payload).decode() for r in warc.reassemble(segments.union(segments)).collect()}
    assert {o.split(":")[2]: p for o, p in whole.items()} == {str(k): f"{k}ü" * 30_000 for k in range(5)}
    lost = warc.reassemble(segments.where("not (origin like '<urn:page:2:%' and segment = 2) and not (origin like '<urn:page:3:%' and total is not null)"))
    assert {r.origin.split(":")[2]: r.intact for r in lost.collect()} == {str(k): k not in (2, 3) for k in range(5)}


def test_missing_and_repeated_ids(spark):
    """A record and a result for each row, also for those without an id and repeated ones."""
    rows = [(None, "u", "a", ""), (1, "u", "a", ""), (1, "v", "a", ""), (2, "u", "a", ""), (3, "u", "b", ""), (3, "u", "c", ""), (None, "u", "d" * 50_000, ""), (None, None, None, ""), (4, "u", "b", ""), (4, "u", "b", "")]
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = [(None, "revisit", 2, 1), (1, "revisit", 2, 1), (1, "revisit", 2, 1), (2, "response", None, 1), (3, "revisit", 4, 1), (3, "response", None, 1), (4, "response", None, 1), (4, "response", None, 1), (None, "response", None, 50_000), (None, "response", None, 0)]
    assert got == sorted(want, key=str)


def test_clashing_columns_and_a_long_page(spark):
    names = ("sha1", "holder", "n", "row", "payload", "refers_to", "record", "value")
    rows = [(1, "u", "long \u00e9 " * 400_000, *names), (2, "u", "x", *names)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, " + ", ".join(f"{c} string" for c in names))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.intact) for r in warc.round_trip(pages).collect()}
    assert got == {1: (len(rows[0][2].encode()), "response", True), 2: (1, "response", True)}
