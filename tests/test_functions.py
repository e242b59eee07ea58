"""Column expressions on the rows that generated tables don't have."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from marlstone.functions import num, text


def one(spark, column, **values):
    cells = [F.lit(v).cast("double").alias(k) if v is None else F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cells).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("value", "want"), [("1.5", 1.5), ("abc", None), ("NaN", None), ("Infinity", None), (None, None)])
def test_finite(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(num.finite("v")).first()[0] == want


def test_null_stays_null_in_clip_and_log(spark):
    row = spark.createDataFrame([(None,), (-5.0,), (7.0,)], "v double").select(num.clip("v", 0.0, 5.0), num.log1p_nonneg("v")).collect()
    assert row[0] == (None, None)
    assert row[1] == (0.0, 0.0)
    assert row[2][0] == 5.0


def test_growth_and_its_inverse(spark):
    rows = spark.createDataFrame([(100.0, 150.0), (100.0, 20.0), (-50.0, 10.0)], "a double, b double")
    for a, b, back in rows.select("a", "b", num.grown("a", num.signed_log_growth("a", "b"))).collect():
        assert back == pytest.approx(b), (a, b)
    assert spark.createDataFrame([(0.0, 1.0)], "a double, b double").select(num.signed_log_growth("a", "b")).first()[0] is None


@pytest.mark.parametrize(("live", "median", "want"), [(85.0, 100.0, 0), (95.0, 100.0, 1), (100.0, 100.0, 2), (105.0, 100.0, 3), (115.0, 100.0, 4), (1.0, 0.0, None)])
def test_relative_view_bounds_are_inclusive(spark, live, median, want):
    got = spark.createDataFrame([(live, median)], "a double, b double").select(num.relative_view("a", "b")).first()[0]
    assert got == (None if want is None else num.VIEWS[want])


def test_uuid5_equals_pythons(spark):
    rows = spark.createDataFrame([("a",), ("chunk_2025_0001",), ("đ",)], "v string").select("v", num.uuid5_url("v")).collect()
    assert all(got == str(uuid.uuid5(uuid.NAMESPACE_URL, v)) for v, got in rows)


def test_folding(spark):
    rows = spark.createDataFrame([("  Hội  Đồng Quản trị ",), ("NGÂN HÀNG",), ("éa",)], "v string")
    assert [r[0] for r in rows.select(text.normalized("v")).collect()] == ["hoi đong quan tri", "ngan hang", "ea"]
    assert rows.select(text.normalized("v", fold_dj=True)).first()[0] == "hoi dong quan tri"
    assert rows.select(text.ascii_lower("v")).collect()[1][0] == "ngan hang"
    assert rows.select(text.slug("v")).collect()[1][0] == "NG_N_H_NG"
    assert spark.createDataFrame([("  ",)], "v string").select(text.slug("v")).first()[0] == "UNKNOWN"


def test_every_character_folds_as_in_python(spark):
    import unicodedata

    codes = [c for c in (*range(0x20, 0xD800), *range(0xE000, 0x30000))]
    plain = lambda s: "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x))
    values = [f"a{chr(c)}b" for c in codes] + ["ﬁnance Ⅳ. №½ª①…Ｆｕｌｌ", "한국어 ﷺ", "A\u0301\u0327o\u0308", "𝐀𝟘"]
    rows = spark.createDataFrame([(v, plain(v)) for v in values], "v string, want string").repartition(8)
    assert [r for r in rows.withColumn("got", text.folded("v")).where("got is null or got <> want").collect()] == []
    some = spark.createDataFrame([("ﬁnance Ⅳ. №½ Ｆｕｌｌ ①②",), (None,)], "v string").select(text.tokens("v"), text.match_key("v"), text.normalized("v")).collect()
    assert some[0] == (["finance", "iv", "no1", "full", "12"], "FINANCEIV.NO12FULL12", "finance iv. no1⁄2 full 12") and some[1] == (None, None, None)


@pytest.mark.parametrize(("line", "want"), [("Chương 3 Báo cáo", True), ("1.2 Rủi ro", True), ("IV. Quản trị", True), ("BUSINESS OVERVIEW", True), ("Mục tiêu:", True), ("a plain line of text", False), ("", False), ("1" * 200, False)])
def test_headings(spark, line, want):
    assert spark.createDataFrame([(line,)], "v string").select(text.is_heading("v")).first()[0] is want


@pytest.mark.parametrize(
    ("value", "want"),
    [("", False), ("Doanh thu năm 2025 tăng 12% so với Q1/2025, ROE2025 đạt 15x", False), ("a1b2c x9y8z b7c6d", True), ("ab�c �d� e", True), ("plain words only here", False), (" ".join(["word"] * 18 + ["a1b2", "c3d4"]), True)],
)
def test_garbled(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(text.is_garbled("v")).first()[0] is want


def test_contents(spark):
    contents = "\n".join(f"{i}. Phần {i}" for i in range(1, 8))
    leaders = "\n".join(["Một dòng dài hơn bốn mươi lăm ký tự để không ngắn"] * 4 + ["x ..... 1", "y ..... 2", "z ..... 3"])
    rows = spark.createDataFrame([(contents,), (leaders,), ("một\nhai",)], "v string").select(text.looks_like_contents("v")).collect()
    assert [r[0] for r in rows] == [True, True, False]


def test_categories(spark):
    rows = spark.createDataFrame([("Chương 3", "Ban điều hành"), ("", "Quản lý rủi ro"), ("1.7 x", ""), ("Giới thiệu", ""), ("Other", "nothing")], "h string, t string")
    assert [r[0] for r in rows.select(text.category(F.col("h"), F.col("t"), fold_dj=True)).collect()] == ["mdna", "risk", "strategy", "business_overview", "other"]


def test_codes_and_years_of_names(spark):
    rows = spark.createDataFrame([("ACB_2024",), ("annual report Hoa Phat 2023",), ("vnm-23CN",), ("Báo cáo",)], "v string")
    got = rows.select(text.stock_from_name("v"), text.stock_from_name_hints_first("v"), text.year_from_name("v")).collect()
    assert [tuple(r) for r in got] == [("ACB", "ACB", 0), ("ANNUAL", "HPG", 2023), ("VNM", "VNM", 2023), ("UNKNOWN", "UNKNOWN", 0)]


def test_keywords(spark):
    got = spark.createDataFrame([("Lợi nhuận của the ACB là bao nhiêu ACB",)], "v string").select(text.keywords("v")).first()[0]
    assert got == ["lợi", "nhuận", "acb"]


def test_feature_labels(spark):
    rows = spark.createDataFrame([("roe", 0.05), ("xx_interest", 0.02), ("zzz", None)], "v string, s double").select(text.feature_label("v"), text.impact_level("s")).collect()
    assert rows[0] == (text.FEATURE_LABELS["roe"], "mạnh")
    assert rows[1] == ("lãi suất", "vừa")
    assert rows[2] == (text.OTHER_FEATURE, "nhẹ")


def test_garbled_texts_are_split_once(spark):
    """Each number of words was counted from a split of its own; words with symbols at their edges count as before."""
    odd = " ".join(["(a1b2c3),"] * 8 + ["plain"] * 12)
    df = spark.createDataFrame([(odd,), ("plain words " * 20,), ("~x {y} �",), (None,), ("",)], "t string").select("t", text.is_garbled("t").alias("g"))
    assert [r.g for r in df.collect()] == [True, False, True, False, False]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
