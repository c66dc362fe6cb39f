"""Round trips through the archive."""

import base64
import hashlib

from facetra.llm.warc import restore, write_archive

SHAPE = "page_id long, url string, html string, header string"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_round_trip(spark):
    rows = [(5, "http://a/", "one", "x"), (3, "http://b/", "one", "x"), (9, None, None, None), (8, "u\r\nv", "", "x"), (7, "c", "é" * 70000, "x"), (None, "d", "two", "x"), (None, "d", "one", "x")]
    rows += [(3, "http://b/", "one", "x")]  # a repeated row
    out = restore(spark, write_archive(spark.createDataFrame(rows, SHAPE))).collect()
    assert len(out) == len(rows)
    first = {"one": 3, "": 8, "é" * 70000: 7, "two": None}
    for key, _, html, _ in rows:
        text = html or ""
        r = next(r for r in out if r.page_id == key and bytes(r.payload) == text.encode())
        assert r.payload_bytes == len(text.encode()) and r.payload_digest == digest(text)
        response = key == first[text]
        assert r.record_type == ("response" if response else "revisit")
        assert r.refers_to == (None if response else first[text])
        assert bytes(r.record) == bytes(r.header) + text.encode() + b"\r\n\r\n"
        assert b"\r\nWARC-Payload-Digest: sha1:" + digest(text).encode() in bytes(r.header)


def test_payloads_are_stored_once(spark):
    rows = [(i, "u", "same", None) for i in range(50)] + [(99, "u", "other", None)] * 2
    archive = write_archive(spark.createDataFrame(rows, SHAPE))
    assert spark.read.parquet(archive.payloads).count() == 2


def test_short_payloads_are_all_responses(spark):
    rows = [(1, "u", "ab", None), (2, "u", "ab", None), (3, "u", "abcdef", None), (4, "u", "abcdef", None)]
    out = restore(spark, write_archive(spark.createDataFrame(rows, SHAPE), smallest=4)).collect()
    assert {r.page_id: r.record_type for r in out} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty(spark):
    assert restore(spark, write_archive(spark.createDataFrame([], SHAPE))).count() == 0
