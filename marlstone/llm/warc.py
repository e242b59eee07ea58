"""Not-modified revisits of web archives, resolved to the response they stand for.

A revisit record says that a server answered 304: the page is as in an earlier
full response.  It is resolved by an as-of join to the latest earlier full
response of the same canonical URL.  The join holds if the validators agree:
entity tags, compared weakly, where the revisit has one, else the
modification dates.  The headers of the response are then updated with those
of the revisit, but for the headers that describe the stored body.

All of it is DataFrame expressions.  A URL's captures are cut into time
buckets; a window finds the latest response inside a bucket, and a window over
one row a bucket carries the last response of earlier ones, so a URL with a
large part of all captures is still many small groups.  Responses travel with
their headers, so no record is looked up by its id.

Records in their file format: ``record`` writes one, ``parsed`` reads one a row,
``records_of`` cuts the bytes of whole files, plain or gzipped by record.

Defined cases: a null URL matches nothing; of responses captured at one time
the highest record id is the latest, and one captured at the revisit's own
time is earlier only with a lower record id; null ids come before all others,
and repeated ones stand for themselves; a null time comes before all others;
null headers are empty; header names are compared in lower case; repeated rows
are resolved each; other columns play no part; an empty table gives no rows; a
row that is no record has nulls.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 6 * 3600
#: Headers of a 304 that don't update the stored response (they describe its body, or one connection).
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that name where a visitor came from.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"
_NO_BUCKET = -(1 << 62)
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, user, leading www, default port, fragment, tracking parameters and last slash; parameters in order."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), "^www[0-9]*\\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last_by_name(pairs: Column) -> Column:
    """A map of (key, value) pairs; of equal keys the last counts."""
    last = lambda ps, name: F.element_at(F.filter(ps, lambda e: e["key"] == name), -1)["value"]
    return _let(pairs, lambda ps: _let(F.array_distinct(F.transform(ps, lambda e: e["key"])), lambda names: F.map_from_arrays(names, F.transform(names, lambda name: last(ps, name)))))


def _lowered(headers: Column) -> Column:
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    return _last_by_name(F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, updated with the permitted ones of a 304."""
    may = F.map_filter(fresh, lambda k, v: ~k.isin(*NOT_MERGED))
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(may, k))
    return F.map_concat(kept, may)


def resolved(captures: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """(record_id, url_key, captured_at, response_id, response_at, status, headers) of every revisit.

    captures: record_id, url, captured_at (seconds), record_type (response or revisit), headers. status: resolved,
    validator_mismatch or no_response; response_id is that of the latest earlier response also where validators differ.
    """
    rows = captures.where("record_type in ('response', 'revisit')").select(
        "record_id",
        canonical_url(F.col("url")).alias("url_key"),
        F.col("captured_at").cast("long").alias("captured_at"),
        F.floor(F.col("captured_at") / bucket_seconds).alias("bucket"),
        (F.col("record_type") == "response").alias("full"),
        _lowered(F.col("headers")).alias("headers"),
    )
    found = F.struct(F.col("captured_at").alias("at"), F.col("record_id").alias("id"), F.col("headers").alias("headers"))
    order = ["captured_at", "record_id", "full", "tie"]  # a response with a revisit's time and id isn't earlier
    keyed = rows.where("url_key is not null").withColumn("tie", F.xxhash64(F.map_entries("headers"))).withColumn("response", F.when(F.col("full"), found))
    inside = Window.partitionBy("url_key", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    revisit = ["record_id", "url_key", "captured_at", "bucket", F.col("headers").alias("fresh")]
    near = keyed.withColumn("near", F.last("response", ignorenulls=True).over(inside)).where("not full").select(*revisit, "near")
    buckets = keyed.where("full").groupBy("url_key", "bucket").agg(F.max_by("response", F.struct("captured_at", "record_id", "tie")).alias("last"))
    present = buckets.unionByName(near.where("near is null").select("url_key", "bucket").distinct(), allowMissingColumns=True).groupBy("url_key", "bucket").agg(F.first("last", ignorenulls=True).alias("last"))
    before = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = present.withColumn("far", F.last("last", ignorenulls=True).over(before)).where("far is not null").select("url_key", F.coalesce("bucket", F.lit(_NO_BUCKET)).alias("b"), "far")
    latest = near.withColumn("b", F.coalesce("bucket", F.lit(_NO_BUCKET))).join(carried, ["url_key", "b"], "left").withColumn("response", F.coalesce("near", "far")).drop("b", "far")
    nowhere = rows.where("url_key is null and not full").select(*revisit).withColumn("near", F.lit(None)).withColumn("response", F.lit(None).cast(latest.schema["response"].dataType))
    linked = latest.drop("near").unionByName(nowhere.drop("near")).select("record_id", "url_key", "captured_at", "fresh", F.col("response.id").alias("response_id"), F.col("response.at").alias("response_at"), F.col("response.headers").alias("stored"), F.col("response").isNotNull().alias("any"))
    tag = lambda h: F.regexp_replace(F.trim(F.element_at(h, "etag")), "^W/", "")
    agree = F.when(tag(F.col("fresh")).isNotNull(), F.coalesce(tag(F.col("fresh")) == tag(F.col("stored")), F.lit(False))).otherwise(
        F.coalesce(F.trim(F.element_at("fresh", F.lit("last-modified"))) == F.trim(F.element_at("stored", F.lit("last-modified"))), F.lit(False))
    )
    status = F.when(~F.col("any"), "no_response").when(agree, "resolved").otherwise("validator_mismatch")
    return linked.select(
        "record_id", "url_key", "captured_at", "response_id", "response_at", status.alias("status"), F.when(status == "resolved", merged_headers(F.col("stored"), F.col("fresh"))).otherwise(F.col("fresh")).alias("headers")
    )


def record(record_id: Column, url: Column, captured_at: Column, record_type: Column, headers: Column) -> Column:
    """The bytes of a WARC record whose block is an HTTP message without a body."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    status = F.when(record_type == "revisit", "HTTP/1.1 304 Not Modified\r\n").otherwise("HTTP/1.1 200 OK\r\n")
    fields = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")), F.lit("\r\n")))
    block = F.concat(status, F.coalesce(F.array_join(fields, ""), F.lit("")), F.lit("\r\n"))
    about = [
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", record_type),
        line("WARC-Record-ID", F.concat(F.lit("<"), record_id.cast("string"), F.lit(">"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.date_format(F.timestamp_seconds(captured_at), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.when(record_type == "revisit", line("WARC-Profile", F.lit(_REVISIT_PROFILE))).otherwise(""),
        F.lit("Content-Type: application/http\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    ]
    return F.concat(*about, block, F.lit("\r\n\r\n")).cast("binary")


def parsed(records: DataFrame, column: str = "record") -> DataFrame:
    """(record_id, url, captured_at, record_type, refers_to, headers) of records, one a row; the body isn't touched. Of repeated names the last counts.

    Times are read in UTC; the session's zone must be UTC, as in Spark's own date functions.
    """
    text = F.decode(F.col(column), "ISO-8859-1")
    parts = records.select(F.split(text, "\r\n\r\n", 3).alias("p"))

    def fields(block: Column) -> Column:
        lines = F.filter(F.split(block, "\r?\n"), lambda x, i: (i > 0) & (F.instr(x, ":") > 1))
        return _last_by_name(F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value"))))

    head, block = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    ok = head.startswith("WARC/")
    read = parts.select(F.when(ok, fields(head)).alias("w"), F.when(ok & block.startswith("HTTP/"), fields(block)).alias("headers"))
    bare = lambda name: F.regexp_replace(F.element_at("w", F.lit(name)), "^<|>$", "")
    return read.select(
        bare("warc-record-id").alias("record_id"), bare("warc-target-uri").alias("url"), F.unix_timestamp(F.try_to_timestamp(F.element_at("w", F.lit("warc-date")), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("captured_at"),
        F.element_at("w", F.lit("warc-type")).alias("record_type"), bare("warc-refers-to").alias("refers_to"), "headers",
    )


def _cut(raw: bytes) -> Iterator[bytes]:
    """The records of a file; what follows a broken one is left."""
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        yield from _cut(member.decompress(raw))
        raw = member.unused_data
    at = 0
    while raw.startswith(b"WARC/", at):
        end = raw.find(b"\r\n\r\n", at)
        length = re.search(rb"\r\ncontent-length:\s*(\d+)", raw[at : end + 2], re.I)
        if end < 0 or not length:
            return
        to = end + 4 + int(length[1]) + 4
        yield raw[at:to]
        at = to


def records_of(files: DataFrame, column: str = "content") -> DataFrame:
    """(record) of every record of files as Spark's binaryFile source reads them; a file is one row, so of 2 GB at most."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                for one in _cut(raw.as_py() or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([one], pa.binary())], ["record"])

    return files.select(column).mapInArrow(run, "record binary")


def captures_of(pages: DataFrame) -> DataFrame:
    """A capture log made from pages: a response each, a revisit one to three days later, and for some a revisit just before. Pages without an id have none."""
    page = pages.where("page_id is not null").select(
        "page_id", "url", (F.lit(1704067200) + 60 * F.col("page_id")).alias("at"), F.length("html").cast("string").alias("size"), F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"')).alias("tag")
    )
    shared = ["cache-control", "date", "last-modified"]

    def headers(age: str, at: Column, modified: Column, **more: Column) -> Column:
        both = [F.lit(age), at.cast("string"), modified, *more.values()]
        return F.map_from_arrays(F.array(*map(F.lit, [*shared, *(k.replace("_", "-") for k in more)])), F.array(*both))

    modified = F.concat(F.lit("day "), (F.col("page_id") % 97).cast("string"))
    tagged = F.col("page_id") % 4 != 0
    response = page.select(
        (3 * F.col("page_id")).alias("record_id"), "url", F.col("at").alias("captured_at"), F.lit("response").alias("record_type"),
        F.when(tagged, headers("max-age=60", F.col("at"), modified, Content_Length=F.col("size"), ETag=F.col("tag"))).otherwise(headers("max-age=60", F.col("at"), modified, Content_Length=F.col("size"))).alias("headers"),
    )
    later = F.col("at") + 86400 * (1 + F.col("page_id") % 3)
    changed = F.col("page_id") % 5 == 0
    new_tag = F.when(changed, '"changed"').when(F.col("page_id") % 7 == 0, F.concat(F.lit("W/"), F.col("tag"))).otherwise(F.col("tag"))
    new_date = F.when(changed, "changed").otherwise(modified)
    length = F.lit("0")
    revisit = page.select(
        (3 * F.col("page_id") + 1).alias("record_id"), F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("#again"))).otherwise(F.col("url")).alias("url"), later.alias("captured_at"), F.lit("revisit").alias("record_type"),
        F.when(tagged, headers("max-age=120", later, modified, Content_Length=length, ETag=new_tag)).otherwise(headers("max-age=120", later, new_date, Content_Length=length)).alias("headers"),
    )
    early = page.where("page_id % 11 = 0").select(
        (3 * F.col("page_id") + 2).alias("record_id"), "url", (F.col("at") - 1).alias("captured_at"), F.lit("revisit").alias("record_type"), headers("max-age=120", F.col("at") - 1, modified, Content_Length=length).alias("headers")
    )
    return response.unionByName(revisit).unionByName(early)
