"""Operators on small tables, with the cases that they define."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from marlstone.operators import docs, forecast, ingest, insights, market, panel, search, taxonomy, valuation
from marlstone.sources import readers, store
from marlstone.streaming import ingest as incremental


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_trends_with_gaps_zeros_and_negatives(spark):
    df = spark.createDataFrame([("a", 1, 100.0), ("a", 2, None), ("a", 3, 50.0), ("b", 1, 0.0), ("b", 2, 5.0), ("c", 1, -10.0), ("c", 2, 10.0)], "symbol string, year int, v double")
    got = {(r.symbol, r.year): r for r in df.withColumns(panel.trend_features(df, "v", "v")).collect()}
    assert got["a", 2].v_yoy_pct is None and got["a", 3].v_yoy_pct == 0.0 and got["a", 3].v_roll3_mean == 75.0
    assert got["b", 2].v_yoy_pct == 0.0
    assert got["c", 2].v_yoy_pct == pytest.approx(-200.0) and got["c", 2].v_momentum_pct == pytest.approx(200.0)
    assert got["c", 1].v_roll3_std == 0.0


def test_macro_as_of(spark):
    p = spark.createDataFrame([("x", y) for y in (1990, 2001, 2002, 2010)], "symbol string, year int")
    m = spark.createDataFrame([(2000, 1.0, 1), (2002, 2.0, 2), (2002, 3.0, 3)], "year int, v double, ord int")
    assert rows(panel.macro_as_of(p, m, ["v"], "ord").select("year", "v"), "year") == [(1990, 1.0), (2001, 1.0), (2002, 3.0), (2010, 3.0)]


def test_lagged_macro_keeps_duplicates(spark):
    p = spark.createDataFrame([("x", 2001)], "symbol string, year int")
    m = spark.createDataFrame([(2000, 1.0), (2000, 2.0)], "year int, v double")
    assert rows(panel.with_macro(p, m, lag=1).select("v"), "v") == [(1.0,), (2.0,)]


def test_percent_columns(spark):
    df = spark.createDataFrame([(0.1, 12.0, None), (0.2, 15.0, None)], "a double, b double, c double")
    assert panel.percent_columns(df, ["a", "b", "c", "missing"]) == ["a"]


def test_clip_bounds_skip_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    assert panel.clip_bounds(df, ["a", "b"], 0.0, 1.0) == {"a": (1.0, 3.0)}


def test_error_metrics_without_variance(spark):
    df = spark.createDataFrame([("g", 0.0, 1.0), ("g", 0.0, 1.0), ("g", None, 1.0)], "k string, y double, p double")
    r = panel.error_metrics(df, "k", "y", "p").first()
    assert (r.n, r.wape, r.mape, r.mae, r.r2) == (2, None, None, 1.0, None)


def test_keep_last_and_first(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, o int")
    assert rows(panel.keep_last(df, ["k"], "o").select("k", "v"), "k") == [(1, "b"), (2, "c")]
    assert rows(panel.keep_first(df, ["k"], "o").select("k", "v"), "k") == [(1, "a"), (2, "c")]


def test_canonical_daily_columns(spark):
    df = spark.createDataFrame([("2024-01-02", "10", "5"), ("bad", "1", "1")], "`Date` string, `Adj Close` string, Vol string")
    assert [(str(a), b, c) for a, b, c in rows(market.canonical(df))] == [("2024-01-02", 10.0, 5.0)]


def test_yearly_return_crosses_years(spark):
    df = spark.createDataFrame([("2023-12-31", 100.0, 1.0), ("2024-01-01", 110.0, 2.0)], "date string, close double, volume double").withColumn("date", F.to_date("date"))
    got = {r.year: r for r in market.yearly(df).collect()}
    assert got[2024].daily_return_mean_pct == pytest.approx(10.0) and got[2024].growth_yoy_pct == pytest.approx(10.0)
    assert got[2023].daily_return_mean_pct is None and got[2024].value_source == "close_x_volume_proxy"


def test_fusion_prefers_the_earlier_list_on_ties(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "id int, score double")
    b = spark.createDataFrame([(3, 5.0), (4, 4.0)], "id int, score double")
    assert [r.id for r in search.fused([a, b], 4, "id").collect()] == [1, 3, 2, 4]


@pytest.mark.parametrize(("code", "label", "want"), [("8355", None, "BANK"), ("8351", None, "BANK"), ("9999", None, "DEFAULT"), ("2399", None, "MANUFACTURING_HEAVY"), ("", "Bán lẻ", "RETAIL"), (None, "công ty thép xyz", "MANUFACTURING_HEAVY"), (None, None, "DEFAULT")])
def test_industry(spark, code, label, want):
    df = spark.createDataFrame([(code, label)], "c string, l string")
    assert df.select(valuation.industry(F.col("c"), F.col("l"))).first()[0] == want


def test_fair_value_by_hand(spark):
    columns = "symbol string, eps double, bvps double, roe double, live_price double, cagr double, median_pe double, median_pb double, forecast_profit double, cplh double, industry string"
    df = spark.createDataFrame([("a", 2000.0, 20000.0, 0.17, 20000.0, 0.05, None, None, None, None, "BANK"), ("b", -5.0, -1.0, -0.1, 0.0, None, None, None, None, None, "BANK")], columns)
    got = {r.symbol: r for r in valuation.fair_values(df).collect()}
    assert got["a"].target_pb == pytest.approx(2.0) and got["a"].fair_price == pytest.approx(round((2000 * 2 / 0.17 * 0.3 + 40000 * 0.7) / 100) * 100)
    assert got["a"].verdict == "UNDERVALUED"
    assert (got["b"].target_pe, got["b"].target_pb, got["b"].fair_price, got["b"].upside_pct) == (15.0, 2.0, 0.0, 0.0)


def test_profit_cagr(spark):
    df = spark.createDataFrame([("a", 2020, 100.0), ("a", 2021, -5.0), ("a", 2022, 121.0), ("b", 2020, 1.0), ("c", 2020, 1.0), ("c", 2021, 9.0)], "symbol string, year int, profit double")
    got = dict(rows(valuation.profit_cagr(df)))
    assert got["a"] == pytest.approx(0.1) and got["b"] is None and got["c"] is None


def test_parents(spark):
    df = spark.createDataFrame([("8000", 1), ("8300", 2), ("8350", 3), ("8355", 4), ("9955", 4)], "code string, level int")
    got = {r.code: r.parent_code for r in taxonomy.with_parents(df).collect()}
    assert got == {"8000": None, "8300": "8000", "8350": "8300", "8355": "8350", "9955": None}
    short = spark.createDataFrame([("8", 1), ("83", 2), ("8355", 4), ("99", 2)], "code string, level int")
    assert {r.code: r.parent_code for r in taxonomy.longest_prefix_parents(short).collect()} == {"8": None, "83": "8", "8355": "83", "99": None}


def test_codes_and_aliases(spark):
    df = spark.createDataFrame([("8,355", "x", None), ("50205040.0", None, "7"), (" abc ", "1", "2"), ("", None, None)], "c string, a string, b string")
    assert [r[0] for r in df.select(ingest.icb_code(F.col("c"))).collect()] == ["8355", "50205040", "abc", None]
    got = ingest.statement_rows(df, F.col("c"), {"f": ("none", "a", "b")}).collect()
    assert [r.f for r in got] == [None, 7.0, 1.0, None] and [r._warnings for r in got] == [["f"], [], [], []]


def test_sections_and_chunks(spark):
    pages = spark.createDataFrame([("f", 1, "intro\nCHAPTER ONE\nbody a"), ("f", 2, "body b\n2.1 Next\nbody c"), ("f", 3, "")], "file string, page int, text string")
    got = rows(docs.sections(pages).select("section", "heading", "text", "page_start", "page_end"), "section")
    assert got == [(0, docs.FIRST_HEADING, "intro", 1, 1), (1, "CHAPTER ONE", "CHAPTER ONE\nbody a\nbody b", 1, 2), (2, "2.1 Next", "2.1 Next\nbody c", 2, 3)]


def test_split_rules(spark):
    def split(body, least, most, overlap):
        df = spark.createDataFrame([(body,)], "text string")
        return [r.text for r in docs.split_chunks(df, "text", least, most, overlap).orderBy("piece_index").collect()]

    assert split("x" * 100, 10, 100, 20) == ["x" * 100]
    cut = split("y" * 101, 10, 100, 20)
    assert cut[0] == "y" * 100 and cut[1].endswith("\n" + "y" * 21)
    assert split("a. bb\n\nccc", 1, 6, 3) == ["a. bb", "bb\nccc"]
    assert split("short", 10, 100, 5) == [] == split(None, 1, 100, 5)
    # no window begins inside the last one's end
    assert split("z" * 180, 1, 100, 20) == ["z" * 100] * 2
    assert [len(p) for p in split("z" * 181, 1, 100, 20)] == [100, 100, 42]
    # the white space that begins a tail is the first
    assert split("aaaa bbb cc\n\ndddddddd", 1, 11, 7) == ["aaaa bbb cc", "cc\ndddddddd"]
    assert split("one\n\ntwo", 1, 3, 0) == ["one", "two"]
    with pytest.raises(ValueError):
        split("x", 1, 5, 5)


def test_links(spark):
    html = '<a href="/a.pdf">1</a><a class=x href="http://o.org/b?file=x.pdf">2</a><a href="/a.pdf#p2">3</a><a href="mailto:x.pdf">4</a><a href="c.html">5</a>'
    df = spark.createDataFrame([(1, "http://h.org/d/", html), (2, None, "<a href='x.pdf'>")], "page_id int, url string, html string")
    assert rows(docs.links(df), "page_id", "link_no") == [(1, 1, "http://h.org/a.pdf"), (1, 2, "http://o.org/b?file=x.pdf")]


@pytest.mark.parametrize(
    ("raw", "want"),
    [('{"a":1}', {"a": 1}), ('```json\n{"a":1}\n```', {"a": 1}), ('{"a":[1,],}', {"a": [1]}), ('"a":1', {"a": 1}), ('<think>x</think>{"a":2}', {"a": 2}), ("[1]", None), ("", None), (None, None), ("no", None), ('{"a":1} x', None), ('{"a":1}] x', None), ('{"a":1}, {"b":2}', None), ('{"a":NaN}', None), ('{"a":",}",}', {"a": ",}"}), ("<|think|>{x<|think|> ```{\"a\": [1, 2]}```", {"a": [1, 2]}), ('"a"', None), ("1", None), ("{}", {})],
)
def test_json_repair(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "v string").select(insights.repaired_json("v")).first()[0]
    assert (json.loads(got) if got else None) == want


def test_prefill(spark):
    df = spark.createDataFrame([(-1.0, None, "9", "a", "n" * 600, "bad", 3.0, None)], "amount double, type string, categoryId string, accountId string, note string, transactionDate string, confidence double, warnings array<string>")
    r = insights.prefill(df, F.array(F.lit("1")), F.array(F.lit("a"))).first()
    assert (r.amount, r.categoryId, r.accountId, len(r.note), r.transactionDate, r.confidence) == (None, None, "a", 500, None, 1.0)
    assert r.missingFields == ["amount", "type", "categoryId", "transactionDate"] and len(r.warnings) == 1


def test_insights_last_of_a_type_wins(spark):
    df = spark.createDataFrame([(1, 0, "a", "TIP", "t", "m", "0.5"), (1, 1, "b", "tip", "t2", "m2", "x"), (1, 2, "c", "NOTE", "t", "m", "1"), (1, 7, "d", "WARNING", "t", "m", "1")], "request_id int, place int, id string, type string, title string, message string, confidence string")
    got = {r.type: r for r in insights.insights(df).collect()}
    assert (got["TIP"].id, got["TIP"].confidence) == ("b", 0.0)
    assert (got["WARNING"].id, got["WARNING"].confidence) == ("fallback-warning", 0.7)


def test_recursion_uses_actual_values_where_there_are_any(spark):
    base = spark.createDataFrame([("a", 100.0, 90.0, 80.0, 10.0, 9.0, 8.0)], "symbol string, revenue_current double, revenue_lag1 double, revenue_lag2 double, profit_after_tax double, profit_lag1 double, profit_lag2 double")
    step = lambda s, y: s.withColumns({"revenue_next": F.col("revenue_current") + F.col("revenue_lag1"), "profit_next": F.col("profit_after_tax") + 1})
    actual = spark.createDataFrame([("a", 2026, 1000.0, 1.0)], "symbol string, year int, revenue double, profit_after_tax double")
    assert rows(forecast.recursive(base, step, 2025, 2027).select("year", "revenue", "source"), "year") == [(2025, 100.0, "base"), (2026, 190.0, "predicted"), (2027, 290.0, "predicted")]
    assert rows(forecast.recursive(base, step, 2025, 2027, actual).select("revenue"), "revenue")[-1] == (1100.0,)


def test_model_and_elimination(spark):
    df = spark.range(200).select((F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.lit(1.0).alias("c"), ((F.col("id") % 10) * 2.0).alias("label"), F.lit(5.0).alias("cur"))
    assert forecast.eliminated(df, ["a", "b", "c"], 1, trees=3, step=0.34) == ["a"]
    model = forecast.regressor(["a", "b"], trees=5, rate=0.5).fit(df)
    assert forecast.predicted(model, df, "cur").where("predicted is null").count() == 0
    assert {r.feature for r in forecast.drivers_of(model, df.limit(1), ["a", "b"], ["label"]).collect()} == {"a", "b"}


def test_keyed_table(spark, tmp_path):
    t = store.KeyedTable(spark, str(tmp_path / "t"), ["id"], "id string, v int, created_at int")
    make = lambda *r: spark.createDataFrame(r, "id string, v int, created_at int, ord int")
    assert t.read().count() == 0
    t.upsert(make(("a", 1, 1, 1), ("a", 2, 2, 2), ("b", 1, 1, 1)), "ord")
    t.upsert(make(("a", 5, 9, 1),), "ord")
    assert rows(t.read(), "id") == [("a", 5, 2), ("b", 1, 1)]
    assert rows(t.pending(spark.createDataFrame([("a",), ("z",)], "id string"))) == [("z",)]
    t.delete("v = 1")
    assert rows(t.read()) == [("a", 5, 2)]
    t.replace(make(("c", 1, 1, 1)))
    assert rows(t.read()) == [("c", 1, 1)]


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    schema = "id long, v int, created_at int"
    t = store.KeyedTable(spark, str(tmp_path / "t"), ["id"], schema, buckets=8)
    t.upsert(spark.range(100).selectExpr("id", "0 as v", "1 as created_at", "1 as ord"), "ord")
    base, before = t._current()
    reader = t.read()
    t.upsert(spark.createDataFrame([(7, 1, 5, 1)], "id int, v int, created_at int, ord int"), "ord")  # int keys are cast before they are hashed
    _, after = t._current()
    assert len(before) == 8 and sum(before[k] != after[k] for k in before) == 1
    assert reader.count() == 100 and rows(t.read().where("v = 1")) == [(7, 1, 1)] and t.read().count() == 100
    with pytest.raises(RuntimeError):
        t._write(t.read(), base, {})
    t.delete("id <> 7")
    assert rows(store.KeyedTable(spark, str(tmp_path / "t"), ["id"], schema).read()) == [(7, 1, 1)]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2


def test_vectors_of_two_sizes_are_an_error(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<float>")
    with pytest.raises(ValueError):
        store.checked_vectors(df)


def test_repeated_runs_change_nothing(spark, tmp_path):
    schema = "id string, v int, created_at int, ord int"
    table = store.KeyedTable(spark, str(tmp_path / "t"), ["id"], "id string, v int, created_at int")
    put = lambda n, *r: spark.createDataFrame(r, schema).coalesce(1).write.parquet(str(tmp_path / "in" / n))
    run = lambda: incremental.run_available(incremental.file_stream(spark, str(tmp_path / "in" / "*"), schema), table, str(tmp_path / "cp"), "ord")
    put("1", ("a", 1, 1, 1))
    run()
    run()
    assert rows(table.read()) == [("a", 1, 1)]
    put("2", ("b", 2, 2, 1))
    run()
    assert rows(table.read(), "id") == [("a", 1, 1), ("b", 2, 2)]


def test_report_columns_in_any_case(spark):
    df = spark.createDataFrame([(" abc ", "1", "x", "2026"), (" ", "1", "1", "1")], "`Symbol` string, `REVENUE_PRED` string, profit_pred string, Target_Year string")
    assert rows(readers.report_table(df).select("symbol", "revenue_pred", "profit_pred", "target_year")) == [("ABC", 1.0, None, 2026)]
    with pytest.raises(ValueError):
        readers.report_table(df.drop("Symbol"))


def test_business_areas_of_a_long_page(spark):
    """Each line was looked up among all lines, which were made anew for it: a page's lines squared. The first of equal lines stays, in its own case."""
    lines = [f"Line {i % 5000}." if i % 2 else f"LINE {i % 5000}" for i in range(10000)] + ["", "...", "Ünd", "üND.."]
    seen, want = set(), []
    for x in (y.rstrip(".") for y in lines if y):
        if x.lower() not in seen:
            seen.add(x.lower())
            want.append(x)
    pages = spark.createDataFrame([("<p>" + "</p><p>".join(lines) + "</p>",), (None,), ("",)], "html string")
    began = time.monotonic()
    got = [r[0] for r in pages.select(docs.business_areas(F.col("html"), 10**6)).collect()]
    assert got == ["; ".join(want), None, ""] and time.monotonic() - began < 30
