"""Company records, names, replies, checks, quantiles, indexes and saved models on hand-made rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import checks, text
from marlstone.operators import company, forecast, insights, panel, search


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_overview_of_odd_rows(spark):
    rows = spark.createDataFrame([(" ", None, float("nan"), '[{"x": {"SHORT_NAME": "Deep"}}, {"fullName": "Later"}]'), (None, "Bank", 8355.0, "{broken"), ("A", "A", None, None)], "Short_Name string, Industry string, ICB_Code double, company_profile string").coalesce(1)
    got = [(r.companyName, r.industryLabelFull, r.icbCode, r.description) for r in company.overview(rows).collect()]
    assert got == [("Deep", None, None, "Deep"), (None, "Bank", "8355", "hoạt động trong lĩnh vực Bank"), ("A", "A", None, "A hoạt động trong lĩnh vực A")]
    assert company.overview(rows.limit(0)).count() == 0
    long = company.overview(spark.createDataFrame([("x" * 3000,)], "industry string")).first().industryLabelFull
    assert len(long) == 2000 and long.endswith("...")
    name = F.lit('{"a": 1, "b": {"fullName": "bank", "short_name": "Own"}}')
    assert one(spark, company.key_search(company.PROFILE_KEYS)(name, F.lit("Bank"))) == "Own"


def test_rows_for_the_receiving_service(spark):
    got = company.pushed(spark.createDataFrame([(None, 3.0)], "year int, interestAndSimilarExpenses double"), "income", True, F.lit("S")).first().asDict()
    assert (got["year"], got["quarter"], got["interestExpense"], got["netProfit"]) == (2026, 1, 3.0, None) and "totalRevenue" not in got


def test_valuation_inputs_name_what_is_missing(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = company.valuation_inputs(f([("A", 1.0, None, "Ngân hàng")], "symbol string, eps double, industry_code string, industry_label string"), f([("A", 2020, 1.0), ("A", 2022, 1.21), ("B", 2020, 1.0)], "symbol string, year int, profit double"), f([("A", 10.0, 1.0), ("A", 20.0, None)], "symbol string, pe double, pb double"), f([("B", 5.0)], "symbol string, live_price double"), f([], "symbol string, profit_pred double"))
    rows = {r.symbol: r for r in got.collect()}
    assert (rows["A"].error, rows["A"].median_pe, rows["A"].industry) == ("Không lấy được dữ liệu: live", 15.0, "BANK") and rows["A"].cagr == pytest.approx(0.1)
    assert rows["B"].error == "Không lấy được dữ liệu: metrics" and rows["B"].live_price == 5.0


def test_names(spark):
    for raw, want in ((None, "f.pdf"), ("a%20b?x=1", "a_b.pdf"), ("..x..PDF", "x..PDF"), ("Báo cáo+1.pdf#2", "B_o_c_o_1.pdf"), ("%zz", "zz.pdf")):
        assert one(spark, text.safe_file_name(F.lit(raw).cast("string"), F.lit("f"))) in (want, "f.pdf"), raw
    assert one(spark, text.file_name_of_url(F.lit("https://a.org/x/y.pdf?z=/w"), F.lit("f"))) == "y.pdf"
    assert one(spark, text.file_name_of_url(F.lit("https://a.org"), F.lit("f"))) == "f.pdf"
    rows = spark.createDataFrame([(1, "a.pdf"), (2, "a.pdf"), (3, "b.pdf"), (4, "a.pdf")], "k int, name string")
    assert {r.k: r.name for r in text.with_unique_names(rows, "name", "k").collect()} == {1: "a.pdf", 2: "a_1.pdf", 3: "b.pdf", 4: "a_2.pdf"}


def test_messages(spark):
    assert one(spark, text.for_readers(F.lit("## A\n**b** _c_ d_e  roe_x (zz_y) Tác động tiêu cực"))) == "A\nb c một số chỉ tiêu tài chính một số chỉ tiêu tài chính gây áp lực"
    assert one(spark, text.for_readers(F.lit(None).cast("string"))) is None and one(spark, text.for_readers(F.lit(""))) == ""
    assert [one(spark, text.asks_back(F.lit(x).cast("string"))) for x in ("a? ", "Bạn muốn gì", "no", None)] == [True, True, False, False]
    assert one(spark, text.raw_input(F.lit("\r a\x00b " + "c" * 5000))) == ("a b " + "c" * 5000)[:4000]


def test_tool_calls(spark):
    bodies = ["{}", None, '{"choices":[{}]}', '{"choices":[{"finish_reason":"tool_calls","message":{"content":null,"tool_calls":[{"id":"1","function":{"name":"f","arguments":"{\\"a\\":1}"}},{"function":{"arguments":"[2]"}}, {}]}}]}']
    got = insights.tool_calls(spark.createDataFrame([(b,) for b in bodies], "body string").coalesce(1)).collect()
    assert [(r.content, len(r.calls)) for r in got] == [("", 0), ("", 0), (None, 0), (None, 3)]
    assert [tuple(c) for c in got[3].calls] == [("1", "f", '{"a":1}'), ("", "", "{}"), ("", "", "{}")] and got[3].finish_reason == "tool_calls"


def test_checks():
    assert checks.required_text({"q": " a "}, "q") == "a" and checks.required_list({"s": [1]}, "s") == ["1"] and checks.whole_numbers({"a": "3", "b": None}, "a", "b", "c") == {"a": 3}
    assert list(checks.year_range(2020, 2021)) == [2020, 2021] and checks.shard_of(1, 2) == 1
    for call in (lambda: checks.required_text({"q": " "}, "q"), lambda: checks.required_list({"s": []}, "s"), lambda: checks.quantile_range(0.9, 0.1), lambda: checks.shard_of(2, 2), lambda: checks.year_range(2021, 2020)):
        with pytest.raises(ValueError):
            call()


def test_quantiles_equal_numpys(spark):
    rng = random.Random(5)
    rows = [(float(rng.randrange(40)), rng.gauss(0, 5), None) if rng.random() < 0.9 else (None, float("nan"), None) for _ in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    columns = {c: F.when(~F.isnan(c), F.col(c)) for c in "abc"}
    shares = (0.0, 0.01, 0.37, 0.5, 0.99, 1.0)
    got = panel.exact_quantiles(df, columns, shares)
    for i, c in enumerate("ab"):
        values = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        assert got[c] == pytest.approx(np.quantile(values, shares).tolist())
    assert got["c"] is None and panel.exact_quantiles(df.limit(0), columns, (0.5,)) == dict.fromkeys("abc")


def test_interactions_of_industries(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 3.0), (None, None)], "ind_NG_N_H_NG double, usd_vnd_log double").coalesce(1)
    assert len(panel.INDUSTRY_MACROS) == 35
    assert [r["ix_usd_vnd_log__NG_N_H_NG"] for r in panel.industry_interactions(df, -1).collect()] == [2.0, 0.0, 0.0]


def test_index_scores_as_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the Bank the risk"), (2, "risk of banks"), (3, ""), (4, None), (5, "the end of it all")], "doc_id long, body string")
    index = search.TermIndex.build(docs, str(tmp_path / "i"), "doc_id", "body", buckets=4)
    for words in (["the", "risk"], ["bank", "bank", "nowhere"], ["nowhere"], []):
        want = {r.doc_id: r.score for r in search.bm25(docs.fillna(""), words, "doc_id", "body").collect()}
        assert {r.doc_id: r.score for r in index.bm25(words).collect()} == pytest.approx(want), words


def test_batch_and_saved_bundles(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"s{i}", y, float(100 + i + y % 7), float(10 + i), rng.random(), rng.random() * 3, float(110 + i), float(11 + i) if i else None) for i in range(25) for y in range(2018, 2023)]
    data = spark.createDataFrame(rows, "symbol string, year int, revenue_current double, profit_after_tax double, roe double, debt double, revenue_next double, profit_after_tax_next double")
    detail, bundles = forecast.batch({"bank": (data, ["roe", "debt"]), "nonbank": (data, ["roe", "debt"])}, 2022, 2023, debt={"nonbank": ("roe", "debt")}, budget={"nonbank": 1}, mandatory=("roe",), trees=2)
    got = detail.collect()
    assert sorted(bundles) == ["bank_profit_after_tax_next", "bank_revenue_next", "nonbank_profit_after_tax_next", "nonbank_revenue_next"]
    assert {(r.dataset, r.target, r.feature_year, r.target_year) for r in got} == {(d, t, 2022, 2023) for d in ("bank", "nonbank") for t in ("revenue_next", "profit_after_tax_next")} and len(got) == 98
    bundle = bundles["nonbank_revenue_next"]
    assert bundle.features == ["roe"] and set(bundle.clip_bounds) == {"roe"} and bundle.debt["upper"] <= 3
    bundle.save(str(tmp_path / "m"))
    back = forecast.Bundle.load(str(tmp_path / "m"))
    score = lambda b: sorted(r.prediction for r in b.model.transform(b.prepared(data, ("roe", "debt")).withColumn("label", F.lit(0.0))).collect())
    assert back.features == bundle.features and back.clip_bounds == bundle.clip_bounds and back.debt == bundle.debt and score(back) == score(bundle)


def test_industries_by_list(spark):
    listing = spark.createDataFrame([(" aaa", "8350", "Ngân hàng", 2), ("AAA", "1", "other", 3), ("BBB", None, None, 1)], "symbol string, industry_code string, industry_label string, ord int")
    got = {r.symbol: (r.industry_code, r.industry_label) for r in company.industries_of(listing, ["aaa", " BBB ", "AAA", "zzz", ""]).collect()}
    assert got == {"AAA": ("8350", "Ngân hàng"), "BBB": (None, None), "ZZZ": (None, None)}
    with pytest.raises(ValueError, match="symbols"):
        company.industries_of(listing, [])


def test_market_data_sections(spark):
    rows = spark.createDataFrame([("a", 2020, 0, 1.0), ("a", 2021, None, 2.0), ("a", 2021, 1, 3.0), ("a", 2021, 2, 4.0), ("b", 2019, 4, None)], "symbol string, year int, quarter int, v double")
    sections = {"x": rows, "y": rows.limit(0)}
    pick = lambda *a, **k: sorted((r.symbol, r.section, r.year, r.quarter or 0, r.payload) for r in company.market_data(sections, *a, **k).collect())
    assert len(pick()) == 5 and pick("y") == [] and pick(["x", "x"]) == pick("x")
    assert pick("x", annual=1, quarterly=1) == [("A", "x", 2021, 0, '{"v":2.0}'), ("A", "x", 2021, 2, '{"v":4.0}'), ("B", "x", 2019, 4, "{}")]
    assert pick("x", annual=0, first=2021) == [("A", "x", 2021, 1, '{"v":3.0}'), ("A", "x", 2021, 2, '{"v":4.0}')]
    with pytest.raises(ValueError, match="z aren't"):
        company.market_data(sections, "x,z")
