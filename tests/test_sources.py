"""Page files, paged records, pushes, content state, block index, forecast requests and key pages, against plain Python."""

from __future__ import annotations

import io
import random
import tracemalloc
from collections import Counter
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone.operators import answers, blocks, ingest, search
from marlstone.sources import pagefiles, records
from marlstone.streaming.content import ContentLog


def strict(file):
    """Only files that say so."""
    data = file.read()
    if not data.startswith(b"OK"):
        raise ValueError("not mine")
    return Lazy(data.decode().split("\f"))


class Lazy(list):
    def __getitem__(self, n):
        found = super().__getitem__(n)
        if found.startswith("BAD"):
            raise RuntimeError(f"page {n} is damaged")
        return found


def read_pages(spark, path, **options):
    pagefiles.register(spark, {"strict": strict, "text": pagefiles.form_feed_pages})
    reader = spark.read.format("pagefiles").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return sorted((Path(r.file).name, r.page, r.pages, r.text, r.parser, r.error) for r in reader.load().collect())


@pytest.mark.parametrize("most", [8, 100, 10**6])
def test_page_files(spark, tmp_path, most):
    long = "\f".join(f"page {i}" for i in range(50)) + "\f"
    files = {"a.txt": long.encode(), "b.txt": "OK\fBAD page\fthird".encode(), "c.txt": b"\xff\xfe broken", "d.txt": b"", "e.doc": b"other", "sub/f.txt": "é\f\fz".encode()}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = read_pages(spark, str(tmp_path), pattern="*.txt", partitionBytes=most)
    by = lambda f: [g for g in got if g[0] == f]
    assert [g[1:5] for g in by("a.txt")] == [(i + 1, 50, f"page {i}", "text") for i in range(50)]
    assert [g[1:5] for g in by("b.txt")] == [(1, 3, "OK", "strict"), (2, 3, "BAD page", "text"), (3, 3, "third", "strict")]
    (broken,) = by("c.txt")
    assert broken[1:5] == (None,) * 4 and "strict: ValueError" in broken[5] and "text: UnicodeDecodeError" in broken[5]
    assert [g[3] for g in by("f.txt")] == ["é", "", "z"] and not by("e.doc") and not by("d.txt")
    only = read_pages(spark, str(tmp_path), pattern="b.txt", parsers="strict", partitionBytes=most)
    assert [(g[1], g[3], bool(g[5])) for g in only] == [(1, "OK", False), (2, None, True), (3, "third", False)]


def test_form_feed_pages_hold_no_file(tmp_path):
    """A file's bytes and its decoded text, which takes four bytes a character here, were held by each share's task."""
    page = "đ\U0001f600 text of a page " * 400
    (tmp_path / "a.txt").write_text("\f".join([page, "", *[page] * 3000]), encoding="utf-8")
    tracemalloc.start()
    with open(tmp_path / "a.txt", "rb") as file:
        pages = pagefiles.form_feed_pages(file)
        got = [len(pages), pages[0] == page, pages[1], pages[3001] == page]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [3002, True, "", True] and most < 40 << 20


@pytest.mark.parametrize("block", [1, 2, 3, 1000])
@pytest.mark.parametrize("text", ["", "\f", "a", "a\f", "\f\f", "é\f\U0001f600\f\fz", "a\f\n"])
def test_form_feed_pages_of_blocks(text, block):
    parts = text.split("\f")
    assert list(pagefiles.FormFeedPages(io.BytesIO(text.encode()), block)) == (parts[:-1] if parts[-1] == "" else parts)


@pytest.mark.parametrize("data", [b"a\xff", "é".encode()[:1], b"\xc3\fa"])
def test_other_bytes_than_utf8_open_no_pages(data):
    with pytest.raises(UnicodeDecodeError):
        pagefiles.FormFeedPages(io.BytesIO(data), 1)


def test_no_page_files(spark, tmp_path):
    assert read_pages(spark, str(tmp_path / "none")) == []
    with pytest.raises(Exception, match="parsers"):
        read_pages(spark, str(tmp_path), parsers="other")


def test_shares_cut_files_without_gaps():
    files = [("a", 3), ("b", 30), ("c", 4), ("d", 7), ("e", 1)]
    made = pagefiles.shares(files, 10)
    assert sorted(f for s in made if s.parts == 1 for f in s.files) == [files[0], *files[2:]]
    assert [(s.part, s.parts) for s in made if s.files == [("b", 30)]] == [(0, 3), (1, 3), (2, 3)]


def test_page_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pagefiles.register(spark, {"text": pagefiles.form_feed_pages})

    def run():
        stream = spark.readStream.format("pagefiles").option("path", str(tmp_path / "in")).option("settleSeconds", 0).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination(90)
        return sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in/a").write_text("1\f2")
    assert run() == ["1", "2"]
    (tmp_path / "in/b").write_text("3")
    assert run() == ["1", "2", "3"]
    assert run() == ["1", "2", "3"]


def test_reading_order_and_second_reading(spark):
    boxes = spark.createDataFrame([(1, 0.50001, 0.9, "right"), (1, 0.50002, 0.1, " left "), (1, 0.1, 0.5, "top"), (1, 0.9, 0.0, "  "), (2, 0.2, 0.2, None), (3, 0.3, 0.3, "b"), (3, 0.3, 0.3, "a")], "p int, y double, x double, text string")
    got = {r.p: (r.text, r.n_lines) for r in pagefiles.reading_order(boxes, ["p"], F.col("y"), F.col("x")).collect()}
    assert got == {1: ("top\nleft\nright", 3), 3: ("a\nb", 2)}
    bad = "�" * 60 + " xx �� zz" * 20
    good = "The company reports a higher revenue for the year. " * 5
    pages = spark.createDataFrame([("f", 1, bad), ("f", 2, good), ("g", 1, good), ("g", 2, ""), ("g", 3, None), *[("g", n, good) for n in range(4, 8)]], "file string, page int, text string")
    flags = {(r.file, r.page): r.reread for r in pagefiles.reread(pages).collect()}
    assert flags == {("f", 1): True, ("f", 2): True, ("g", 1): False, ("g", 2): True, ("g", 3): True, **{("g", n): False for n in range(4, 8)}}
    both = pagefiles.repaired(pagefiles.reread(pages).withColumn("ocr", F.lit("read again")))
    assert {(r.file, r.page): r.text for r in both.where("by_picture").collect()} == {("f", 1): "read again", ("g", 2): "read again", ("g", 3): "read again"}


class Service:
    """Records 0 to n - 1 of two markets. Every third request fails once; what was asked is noted in files."""

    key = "id"

    def __init__(self, n, folder, failing=True):
        self.n, self.folder, self.failing, self.calls = n, str(folder), failing, 0

    def borders(self, params):
        return [self.n // 3, 2 * self.n // 3] if self.n else []

    def page(self, params, after, upto, limit):
        self.calls += 1
        if self.failing and self.calls % 3 == 1:
            raise records.Transient("busy")
        with open(f"{self.folder}/asked", "a") as f:
            f.write(f"{sorted(params.items())}\n")
        rows = [{"id": i, "market": "hsx" if i % 2 else "hnx", "year": 2000 + i % 5} for i in range(self.n)]
        fit = lambda r: params.get("market") in (None, r["market"]) and params.get("year_from", 0) <= r["year"] <= params.get("year_to", 9999)
        return [r for r in rows if fit(r) and (after is None or r["id"] > after) and (upto is None or r["id"] <= upto)][:limit]


def test_paged_records(spark, tmp_path):
    schema = "id long, market string, year int, extra string"
    records.register(spark, "service", Service(100, tmp_path), schema, ["market"], ["year"])
    load = lambda: spark.read.format("service").option("pageSize", 7).option("waitSeconds", 0).load()
    assert sorted(r.id for r in load().collect()) == list(range(100))
    assert load().where("extra is null").count() == 100
    (tmp_path / "asked").unlink()
    some = load().where("market in ('hnx', 'upcom') and year >= 2001 and year <= 2003 and id % 4 = 0")
    assert sorted(r.id for r in some.collect()) == [i for i in range(100) if i % 4 == 0 and 1 <= i % 5 <= 3]
    asked = set((tmp_path / "asked").read_text().splitlines())
    assert asked == {str([("market", m), ("year_from", 2001), ("year_to", 2003)]) for m in ("hnx", "upcom")}
    assert load().where("market = 'hsx' and market = 'hnx'").count() == 0


def test_a_service_that_stays_away_or_repeats_is_an_error(spark, tmp_path):
    class Away(Service):
        def page(self, params, after, upto, limit):
            raise records.Transient("gone")

    class Repeats(Service):
        def page(self, params, after, upto, limit):
            return [{"id": 1}] * limit

    for kind, word in ((Away, "gone"), (Repeats, "isn't above")):
        records.register(spark, kind.__name__.lower(), kind(9, tmp_path), "id long")
        with pytest.raises(Exception, match=word):
            spark.read.format(kind.__name__.lower()).option("waitSeconds", 0).load().collect()
    records.register(spark, "nothing", Service(0, tmp_path, False), "id long")
    assert spark.read.format("nothing").load().count() == 0


def test_rows_are_sent_once(spark, tmp_path):
    rows = spark.range(0, 103).select("id", F.when(F.col("id") < 40, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    rows = rows.unionByName(rows.where("id = 5"))
    folder = str(tmp_path)

    def send(key, held):
        from pathlib import Path

        stop = Path(folder, "stop")
        if stop.exists() and any(r["id"] == 77 for r in held):
            stop.unlink()
            raise OSError("killed")
        with open(f"{folder}/sent-{key}", "a") as f:
            f.writelines(f"{r['id']}\n" for r in held)

    (tmp_path / "stop").touch()
    with pytest.raises(Exception, match="killed"):
        records.push(rows, send, f"{folder}/ledger", batch=4, parts=3)
    for _ in range(2):
        records.push(rows, send, f"{folder}/ledger", batch=4, parts=3)
        got = Counter(int(x) for f in tmp_path.glob("sent-*") for x in f.read_text().split())
        assert got == Counter(list(range(103)) + [5])
    records.push(rows.limit(0), send, f"{folder}/none")
    assert not list(Path(folder, "none/sent").glob("*")) if Path(folder, "none/sent").exists() else True


T = [datetime(2025, 1, d) for d in range(1, 32)]
CONTENT = "url string, digest string, at timestamp, error string"


def content(spark, *rows):
    return spark.createDataFrame([(u, d, T[t], e) for u, d, t, e in rows], CONTENT)


def statuses(log, number):
    return sorted((r.url, r.n, r.status, r.same_as) for r in log.log().where(f"batch = {number}").collect())


def test_content_state_across_runs(spark, tmp_path):
    log = ContentLog(spark, str(tmp_path), keep="10 days", buckets=2)
    first = content(spark, ("b", "x", 1, None), ("a", "x", 1, None), ("a", "x", 1, None), ("c", "y", 2, None), ("d", None, 2, "timeout"), ("e", None, 2, None), ("f", "z", 2, "cut"))
    log.record(first, 0)
    want = [("a", 1, "deduplicated", "a"), ("a", 1, "downloaded", None), ("b", 1, "deduplicated", "a"), ("c", 1, "downloaded", None), ("d", 1, "failed", None), ("e", 1, "failed", None), ("f", 1, "failed", None)]
    assert sorted(statuses(log, 0), key=str) == sorted(want, key=str)
    log.record(content(spark, ("f", "z", 3, None), ("g", "x", 8, None)), 1)
    assert statuses(log, 1) == [("f", 1, "downloaded", None), ("g", 1, "deduplicated", "a")]
    before = sorted(map(tuple, log.state.read().collect()))
    log.record(content(spark, ("f", "z", 3, None), ("g", "x", 8, None)), 1)
    assert sorted(map(tuple, log.state.read().collect())) == before and statuses(log, 1)[0][2] == "downloaded"
    log.record(content(spark, ("h", "x", 17, None), ("i", "y", 17, None)), 2)
    assert statuses(log, 2) == [("h", 1, "deduplicated", "a"), ("i", 1, "downloaded", None)]
    log.expire("2025-01-20")
    assert {r.digest for r in log.state.read().collect()} == {"x", "y"}
    log.record(first.limit(0), 3)
    assert statuses(log, 3) == []


def test_a_batch_that_stopped_between_log_and_state(spark, tmp_path):
    log = ContentLog(spark, str(tmp_path), buckets=2)
    batch = content(spark, ("a", "x", 1, None), ("b", "x", 2, None))
    log.judged(batch).write.parquet(f"{tmp_path}/log/batch=0")
    log.record(batch, 0)
    assert statuses(log, 0) == [("a", 1, "downloaded", None), ("b", 1, "deduplicated", "a")]
    assert [(r.digest, r.url) for r in log.state.read().collect()] == [("x", "a")]


def test_content_stream(spark, tmp_path):
    log = ContentLog(spark, str(tmp_path / "log"), buckets=2)
    for n in range(2):
        content(spark, (f"u{n}", "same", n, None)).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            log.run(spark.readStream.schema(CONTENT).parquet(str(tmp_path / "in")), str(tmp_path / "mark"))
    assert sorted((r.url, r.status) for r in log.log().collect()) == [("u0", "downloaded"), ("u1", "deduplicated")]


def test_block_index_equals_the_scan(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 40)))) for i in range(400)]
    texts += [(400 + i, "common rare rare" if i % 20 == 0 else "common") for i in range(100)] + [(600, None), (601, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = blocks.BlockIndex.build(docs, str(tmp_path / "i"), "doc_id", "text", buckets=4, block_docs=8)
    for asked in (["w0", "w5"], ["w59"], ["common", "rare"], ["w1", "w1", "absent"], ["absent"], []):
        for k in (1, 10, 1000):
            got = [(r.doc_id, round(r.score, 9)) for r in index.top(asked, k).collect()]
            want = search.bm25(docs, asked, "doc_id", "text").collect() if asked else []
            assert got == sorted(((r.doc_id, round(r.score, 9)) for r in want), key=lambda x: (-x[1], x[0]))[:k], (asked, k)
    assert index.all.where("token = 'common'").count() > 20
    upper, idf = index.bounds(["common", "rare"])
    assert max(r.upper for r in upper.collect()) >= index.top(["common", "rare"], 1).first().score
    nothing = blocks.BlockIndex.build(docs.limit(0), str(tmp_path / "n"), "doc_id", "text")
    assert nothing.top(["w1"], 5).collect() == []


def test_a_block_index_exchanges_texts_only_and_once(spark, tmp_path):
    """Not a row for each of 40,000 tokens, and nothing that is exchanged is worked out twice to find ranges."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 30)}" for _ in range(200))) for i in range(200)], "doc_id long, text string")
    context = spark.sparkContext
    context.setJobGroup("block-index", "")
    index = blocks.BlockIndex.build(docs, str(tmp_path / "i"), "doc_id", "text", buckets=4, block_docs=20)
    context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, status = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("block-index") for s in tracker.getJobInfo(j).stageIds}
    done = [s for s in (status.lastStageAttempt(x) for x in stages) if s.status().toString() == "COMPLETE"]
    sent, read = sum(s.shuffleWriteRecords() for s in done), sum(s.shuffleReadRecords() for s in done)
    rows = index.all.count()
    assert 300 <= rows <= 310 and 200 <= sent <= 220 and read == sent


def test_a_large_block_has_several_rows_for_a_token(spark, tmp_path, monkeypatch):
    texts = [(i, f"common common w{i % 7} " + "long " * (i % 5)) for i in range(60)] + [(60, "long " * 100), (61, "- a"), (62, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    plain = type(docs).mapInArrow

    def small(self, run, schema):
        def limited(batches):
            most, run.__globals__["BATCH_TOKENS"] = run.__globals__["BATCH_TOKENS"], 50  # in the worker, which later tests use again
            try:
                yield from run(b.slice(a, 9) for b in batches for a in range(0, b.num_rows, 9))
            finally:
                run.__globals__["BATCH_TOKENS"] = most

        return plain(self, limited, schema)

    with monkeypatch.context() as m:
        m.setattr(type(docs), "mapInArrow", small)
        index = blocks.BlockIndex.build(docs, str(tmp_path / "i"), "doc_id", "text", buckets=2, block_docs=40)
    assert index.all.where("token = 'common'").count() > 4 and index.all.where("token = 'common'").select("block").distinct().count() == 2
    assert index.all.agg(F.sum("n"), F.sum("total")).first() == (60 * 2 + 48 + 1, 60 * 3 + 120 + 100)
    for asked in (["common", "w3"], ["long"], ["w1", "long"]):
        want = sorted(((r.doc_id, round(r.score, 9)) for r in search.bm25(docs, asked, "doc_id", "text").collect()), key=lambda x: (-x[1], x[0]))
        for k in (3, 100):
            assert [(r.doc_id, round(r.score, 9)) for r in index.top(asked, k).collect()] == want[:k]


def test_forecast_answers(spark, tmp_path):
    table = "symbol string, target_year int, revenue_pred double, ord int"
    report = spark.createDataFrame([("aaa", 2024, 1.0, 1), ("AAA", 2025, 2.0, 1), ("AAA", 2025, 3.0, 2)], table)
    requests = spark.createDataFrame([(1, " aaa ", 2025), (2, "AAA", 2030), (3, "BBB", 2026), (4, "CCC", 2026), (5, "DDD", 2026), (6, " ", 2026), (7, None, None), (8, "BBB", None), (9, "BBB", 2026)], "request_id int, symbol string, target_year int")
    calls = []

    def compute(missing):
        calls.append(sorted((r.symbol, r.wanted_year) for r in missing.collect()))
        return missing.where("symbol <> 'EEE'").select("symbol", "wanted_year", F.col("wanted_year").alias("target_year"), F.lit(float(len(calls))).alias("revenue_pred"))

    store = answers.cache(spark, str(tmp_path / "cache"), 2)

    def ask(bundles, report=report, detail=report.limit(0), **more):
        found = answers.answered(requests, report, detail, store, spark.createDataFrame(bundles, "symbol string, digest string"), compute, **more).collect()
        return {r.request_id: (r.revenue_pred, r.tier, r.error_code) for r in found}

    first = ask([("BBB", "b1"), ("CCC", "c1")])
    assert first[1] == (3.0, "report", None) == first[2]
    assert first[3] == first[9] == (1.0, "computed", None) and first[4] == (1.0, "computed", None)
    assert first[5][1:] == (None, "FORECAST_SYMBOL_NOT_FOUND") and first[6][2] == first[7][2] == "INVALID_ARGS" and first[8][2] == "FORECAST_SYMBOL_NOT_FOUND"
    assert calls == [[("BBB", 2026), ("CCC", 2026)]]
    second = ask([("BBB", "b1"), ("CCC", "c2")])
    assert second[3] == (1.0, "cache", None) and second[4] == (2.0, "computed", None) and calls[1:] == [[("CCC", 2026)]]
    third = ask([("BBB", "b1"), ("CCC", "c1")], default_year=2026)
    assert third[4] == (1.0, "cache", None) and third[8] == (1.0, "cache", None) and len(calls) == 2
    assert ask([("BBB", "b1")], report.limit(0), report)[1] == (3.0, "detail", None)
    assert ask([("BBB", "b1")], report.limit(0))[5][2] == "FORECAST_REPORT_EMPTY"
    off = ask([("BBB", "b1")], enabled=False)
    assert off[1] == (None, None, "FORECAST_DISABLED") and off[6][2] == "INVALID_ARGS"
    assert len(calls) == 2


def test_key_pages_go_on_where_they_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i:03d}", i) for i in random.Random(1).sample(range(95), 95)] + [(None, -1)], "k string, v int")
    pages = ingest.paged(rows, "k", 10, str(tmp_path / "p")).collect()
    assert sorted((r.page_no, r.k) for r in pages) == [(i // 10, f"k{i:03d}") for i in range(95)]
    seen, stop = [], [True]

    def handle(page, number):
        found = sorted(r.v for r in page.collect())
        if found[0] == 30 and stop and stop.pop():
            raise OSError("stopped")
        seen.append(found)

    with pytest.raises(OSError, match="stopped"):
        ingest.walk(rows, "k", 10, str(tmp_path / "w"), handle)
    assert ingest.walk(rows, "k", 10, str(tmp_path / "w"), handle) == 7
    assert seen == [list(range(i, min(i + 10, 95))) for i in range(0, 95, 10)]
    assert ingest.walk(rows, "k", 10, str(tmp_path / "w"), handle) == 0
    assert ingest.walk(rows.limit(0), "k", 10, str(tmp_path / "e"), handle) == 0
