import base64
import hashlib
import io

import pytest

from grovetally.llm import warc


def rows(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, path string")


CASES = [
    (3, "http://a/ü?x=1 2\r\nX: y", "same", "x"),
    (1, "http://b/", "same", "x"),
    (2, None, "same", "x"),
    (4, "http://c/", "", "x"),
    (5, "http://d/", None, "x"),
    (6, "http://e/", "long é " * 60_000, "x"),
    (7, "http://f/", "\r\n\r\nWARC/1.1\r\n\r\n", "x"),
    (None, "http://g/", "same", "x"),
    (1, "http://b/", "same", "x"),
]


def test_round_trip(spark):
    got = warc.archive_pages(spark, rows(spark, CASES), with_payload=True).collect()
    assert len(got) == len(CASES) and not any(r.error for r in got)
    first = {}
    for p, _, html, _ in CASES:
        if p is not None:
            first[html or ""] = min(p, first.get(html or "", p))
    for p, url, html, _ in CASES:
        mine = [r for r in got if r.page_id == p and r.url == url][0]
        data = (html or "").encode()
        assert mine.payload_bytes == len(data)
        assert mine.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = p != first[html or ""]
        assert (mine.record_type, mine.refers_to) == (("revisit", first[html or ""]) if revisit else ("response", None))
        assert mine.payload == (None if revisit else data)


def test_short_payloads_are_responses(spark):
    got = warc.archive_pages(spark, rows(spark, CASES), min_revisit=5).collect()
    assert {r.record_type for r in got} == {"response"}


def test_empty_table(spark):
    assert warc.archive_pages(spark, rows(spark, [])).count() == 0


@pytest.mark.parametrize("spoil", ["cut", "flip"])
def test_damage_is_told(spoil):
    member = warc.encode_record(1, "http://a/", b"payload" * 99, None, "2000-01-01T00:00:00Z")
    if spoil == "cut":
        data = member[:-20]
    else:
        raw = __import__("zlib").decompress(member, 31).replace(b"payloadpayload", b"payloadpayl0ad", 1)
        data = __import__("gzip").compress(raw)
    got = list(warc.read_records(io.BytesIO(data)))
    assert len(got) == 1 and got[0]["error"]


def test_many_members_in_small_chunks():
    data = b"".join(warc.encode_record(i, None, b"x" * i, None, "d") for i in range(50))
    assert [r["payload_bytes"] for r in warc.read_records(io.BytesIO(data))] == list(range(50))


def test_long_urls_and_broken_records_lose_no_others():
    long = "http://a/" + "é" * 400_000
    spoiled = __import__("gzip").compress(b"WARC/1.1\r\nno header" + b"x" * 200_000)
    parts = [warc.encode_record(1, long, b"one", None, "d"), spoiled, warc.encode_record(2, None, b"two", None, "d")]
    got = list(warc.read_records(io.BytesIO(b"".join(parts))))
    assert [(r["page_id"], r["payload_bytes"]) for r in got] == [(1, 3), (None, None), (2, 3)]
    assert got[0]["url"] == long and [bool(r["error"]) for r in got] == [False, True, False]
