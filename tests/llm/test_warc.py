"""Revisit resolution on hand-made captures, and against a loop over all of them."""

from __future__ import annotations

import gzip
import random

from pyspark.sql import functions as F

from marlstone.llm import warc

SCHEMA = "record_id long, url string, captured_at long, record_type string, headers map<string,string>, bucket int"


def resolved(spark, rows, **more):
    return {r.record_id: r for r in warc.resolved(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), **more).collect()}


def test_urls(spark):
    same = ["http://www.A.org:80/p/?b=2&a=1#x", "https://a.org/p?a=1&b=2&utm_source=z", "a.org/p?a=1&b=2"]
    got = spark.createDataFrame([(u,) for u in same], "u string").select(warc.canonical_url(F.col("u"))).collect()
    assert {r[0] for r in got} == {"a.org/p?a=1&b=2"}


def test_validators_and_headers(spark):
    full = {"ETag": '"1"', "Content-Length": "9", "Date": "a", "Server": "s"}
    got = resolved(
        spark,
        [
            (1, "http://a.org/", 100, "response", full),
            (2, "https://a.org", 200, "revisit", {"etag": 'W/"1"', "date": "b", "content-length": "0"}),
            (3, "http://a.org/", 300, "revisit", {"etag": '"2"'}),
            (4, "http://a.org/", 50, "revisit", {"etag": '"1"'}),
            (5, None, 300, "revisit", None),
            (6, "http://a.org/", 300, "revisit", {"last-modified": "x"}),
            (7, "http://b.org/", 10, "response", {"last-modified": "x"}),
            (8, "http://b.org/", 20, "revisit", {"Last-Modified": "x"}),
            (9, "http://b.org/", 20, "other", {}),
        ],
    )
    assert {k: (r.status, r.response_id) for k, r in got.items()} == {2: ("resolved", 1), 3: ("validator_mismatch", 1), 4: ("no_response", None), 5: ("no_response", None), 6: ("validator_mismatch", 1), 8: ("resolved", 7)}
    assert got[2].headers == {"etag": 'W/"1"', "content-length": "9", "date": "b", "server": "s"}


def test_one_hot_url_over_many_buckets(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h.org/{'hot' if rng.random() < 0.7 else rng.randrange(5)}", rng.randrange(2000), rng.choice(["response", "revisit"]), {"etag": str(rng.randrange(2))}) for i in range(600)]
    got = resolved(spark, rows, bucket_seconds=37)
    for i, url, at, kind, headers in rows:
        if kind == "revisit":
            before = [r for r in rows if r[1] == url and r[3] == "response" and (r[2], r[0]) < (at, i)]
            last = max(before, key=lambda r: (r[2], r[0]), default=None)
            want = ("no_response", None) if last is None else ("resolved" if last[4] == headers else "validator_mismatch", last[0])
            assert (got[i].status, got[i].response_id) == want
    assert warc.resolved(spark.createDataFrame([], SCHEMA)).count() == 0


def test_missing_and_repeated_ids(spark):
    tag = {"etag": '"1"'}
    rows = [
        (None, "http://a.org", 10, "response", tag), (None, "http://a.org", 20, "revisit", tag), (None, None, 5, "response", tag), (None, None, 20, "revisit", tag),
        (3, "http://a.org", 30, "response", {"etag": '"x"'}), (3, "http://b.org", 30, "response", tag), (3, "http://b.org", 40, "revisit", tag), (3, "http://a.org", 40, "revisit", tag),
        (3, "http://a.org", 40, "revisit", tag), (9, "http://b.org", None, "revisit", tag), (3, "http://c.org", 1, "response", tag), (3, "http://c.org", 1, "revisit", tag),
    ]
    frame = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], SCHEMA + ", response string, status string, url_key string")
    got = sorted((r.record_id or 0, r.url_key or "", r.captured_at or 0, r.status, r.response_id or 0) for r in warc.resolved(frame).collect())
    assert got == [
        (0, "", 20, "no_response", 0), (0, "a.org", 20, "resolved", 0), (3, "a.org", 40, "validator_mismatch", 3), (3, "a.org", 40, "validator_mismatch", 3),
        (3, "b.org", 40, "resolved", 3), (3, "c.org", 1, "no_response", 0), (9, "b.org", 0, "no_response", 0),
    ]


def test_records_come_back_from_files(spark, tmp_path):
    rows = [(1, "http://a.org/x", 1700000000, "response", {"etag": '"1"', "date": "a: b"}), (2, "http://a.org/x", 1700000100, "revisit", {"etag": '"1"'}), (3, None, 1700000200, "revisit", None), (4, "", None, "response", {})]
    captures = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    raw = {r[0]: bytes(r[1]) for r in captures.select("record_id", warc.record(*(F.col(c) for c in ("record_id", "url", "captured_at", "record_type", "headers")))).collect()}
    (tmp_path / "a.warc").write_bytes(raw[1] + raw[2])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw[3]) + gzip.compress(raw[4] + b"WARC/1.1\r\nbroken"))
    (tmp_path / "c.warc").write_bytes(b"")
    records = warc.records_of(spark.read.format("binaryFile").load(str(tmp_path)))
    got = {int(r.record_id): (r.url, r.captured_at, r.record_type, r.headers) for r in warc.parsed(records).collect()}
    assert got == {i: (u, at, kind, h or {}) for i, u, at, kind, h in rows}
    foreign = b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Refers-To: <urn:uuid:0>\r\nWARC-Date: 2023-11-14T22:13:20Z\r\nContent-Length: 30\r\n\r\nHTTP/1.1 304 x\r\nA: 1\r\na: 2\r\n\r\n\r\n\r\n"
    (r, bad, none) = warc.parsed(spark.createDataFrame([(foreign,), (b"no record",), (None,)], "record binary").coalesce(1)).collect()
    assert (r.record_id, r.refers_to, r.captured_at, r.headers) == ("urn:uuid:1", "urn:uuid:0", 1700000000, {"a": "2"})
    assert set(bad) == set(none) == {None}
