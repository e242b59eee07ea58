"""Fair value, industry resolution, growth of profits, summaries of multiples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import num, text

# Industries by classification code and by label, in the order in which they are tried, and each one's weights and defaults.
ICB = (
    ("8355", "BANK"), ("8350", "BANK"), ("8770", "SECURITIES"), ("8771", "SECURITIES"), ("3510", "REAL_ESTATE"), ("3520", "REAL_ESTATE"), ("5370", "RETAIL"), ("5371", "RETAIL"), ("5373", "RETAIL"), ("5550", "RETAIL"),
    ("9530", "TECHNOLOGY"), ("9533", "TECHNOLOGY"), ("9535", "TECHNOLOGY"), ("9537", "TECHNOLOGY"), ("1750", "MANUFACTURING_HEAVY"), ("1730", "MANUFACTURING_HEAVY"), ("1710", "MANUFACTURING_HEAVY"), ("2350", "MANUFACTURING_HEAVY"),
    ("3570", "FMCG"), ("3573", "FMCG"), ("3533", "FMCG"), ("6530", "UTILITIES"), ("6570", "UTILITIES"), ("6575", "UTILITIES"), ("2770", "LOGISTICS_PORTS"), ("2771", "LOGISTICS_PORTS"), ("2773", "LOGISTICS_PORTS"), ("4530", "HEALTHCARE"), ("4535", "HEALTHCARE"),
)
LABELS = (
    ("ngân hàng", "BANK"), ("chứng khoán", "SECURITIES"), ("bất động sản", "REAL_ESTATE"), ("bán lẻ", "RETAIL"), ("bán lẻ tổng hợp", "RETAIL"), ("công nghệ", "TECHNOLOGY"), ("phần mềm", "TECHNOLOGY"), ("sắt thép", "MANUFACTURING_HEAVY"), ("thép", "MANUFACTURING_HEAVY"),
    ("vật liệu xây dựng", "MANUFACTURING_HEAVY"), ("hóa chất", "MANUFACTURING_HEAVY"), ("thực phẩm", "FMCG"), ("đồ uống", "FMCG"), ("điện", "UTILITIES"), ("nước", "UTILITIES"), ("điện lực", "UTILITIES"), ("cảng biển", "LOGISTICS_PORTS"), ("vận tải", "LOGISTICS_PORTS"),
    ("logistics", "LOGISTICS_PORTS"), ("dược phẩm", "HEALTHCARE"), ("y tế", "HEALTHCARE"),
)
#: industry: weights of P/E, P/B, P/S; cost of equity; growth.
PLAYBOOK = {
    "BANK": (0.3, 0.7, 0.0, 0.11, 0.05), "SECURITIES": (0.5, 0.5, 0.0, 0.13, 0.05), "REAL_ESTATE": (0.3, 0.7, 0.0, 0.13, 0.05), "RETAIL": (0.6, 0.0, 0.4, 0.12, 0.07), "TECHNOLOGY": (0.7, 0.0, 0.3, 0.12, 0.08), "MANUFACTURING_HEAVY": (0.6, 0.4, 0.0, 0.12, 0.05),
    "FMCG": (0.8, 0.1, 0.1, 0.11, 0.06), "UTILITIES": (0.6, 0.4, 0.0, 0.10, 0.04), "LOGISTICS_PORTS": (0.6, 0.4, 0.0, 0.12, 0.05), "HEALTHCARE": (0.8, 0.1, 0.1, 0.11, 0.06), "DEFAULT": (0.6, 0.4, 0.0, 0.12, 0.05),
}


def industry(code: Column, label: Column) -> Column:
    """By the exact code, a code with the same first three or two digits, the exact label, a label that contains a known one; else DEFAULT."""
    c, name = text.strip(code), F.lower(text.strip(label))
    out = F.when(F.lit(False), F.lit(""))
    given = F.coalesce(c != "", F.lit(False))
    for k, v in ICB:
        out = out.when(given & (c == k), v)
    for n in (3, 2):
        for k, v in ICB:
            out = out.when(given & F.lit(k).startswith(F.substring(c, 1, n)), v)
    for k, v in LABELS:
        out = out.when(name == k, v)
    for k, v in LABELS:
        out = out.when(name.contains(k), v)
    return out.otherwise("DEFAULT")


def playbook(spark: SparkSession) -> DataFrame:
    """One row an industry."""
    return spark.createDataFrame([(k, *v) for k, v in PLAYBOOK.items()], "industry string, w_pe double, w_pb double, w_ps double, coe double, default_growth double")


def fair_values(inputs: DataFrame) -> DataFrame:
    """inputs (symbol, eps, bvps, roe, live_price, cagr, median_pe, median_pb, forecast_profit, cplh, industry) with multiples, prices and verdict.

    Every step is an expression of the row; the playbook's eleven rows are broadcast.
    """
    rows = inputs.join(F.broadcast(playbook(inputs.sparkSession)), "industry", "left")
    c = F.col
    spread = F.greatest(F.lit(0.03), 0.25 * c("coe"))
    g = F.greatest(F.when(c("cagr").isNull(), c("default_growth")).otherwise(F.least("cagr", c("coe") - spread)), F.lit(0.0))
    forward = F.when((F.coalesce("forecast_profit", F.lit(0.0)) != 0) & (F.coalesce("cplh", F.lit(0.0)) > 0), F.try_divide(c("forecast_profit") * 1e9, F.nullif("cplh", F.lit(0.0)))).otherwise(c("eps"))
    rows = rows.withColumns({"growth": g, "forward_eps": forward, "m_pe": F.nullif("median_pe", F.lit(0.0)), "m_pb": F.nullif("median_pb", F.lit(0.0)), "r": F.coalesce("roe", F.lit(0.0))})
    plain = (c("r") <= 0) | (c("coe") <= c("growth"))
    raw_pb = F.try_divide(c("r") - c("growth"), F.nullif(c("coe") - c("growth"), F.lit(0.0)))
    raw_pe = F.try_divide(raw_pb, F.nullif(c("r"), F.lit(0.0)))
    ratio = F.when(c("m_pe") > 0, raw_pe / c("m_pe"))
    limited = F.when(ratio > 2, 1.5 * c("m_pe")).when(ratio < 0.5, 0.7 * c("m_pe"))
    pe = F.when(plain, F.coalesce("m_pe", F.lit(15.0))).otherwise(F.coalesce(limited, raw_pe))
    pb = F.when(plain, F.coalesce("m_pb", F.lit(2.0))).otherwise(F.coalesce(limited * c("r"), raw_pb))
    rows = rows.withColumns({"target_pe": pe, "target_pb": pb})
    rows = rows.withColumns({
        "price_pe": F.when(c("forward_eps") > 0, c("forward_eps") * c("target_pe")).otherwise(0.0),
        "price_pb": F.when(c("bvps") > 0, c("bvps") * c("target_pb")).otherwise(0.0),
        "u_pe": F.when((c("w_ps") > 0) & (c("w_pb") > 0), c("w_pe") + c("w_ps") / 2).otherwise(c("w_pe")),
        "u_pb": F.when((c("w_ps") > 0) & (c("w_pb") == 0), c("w_ps")).when(c("w_ps") > 0, c("w_pb") + c("w_ps") / 2).otherwise(c("w_pb")),
    })
    total = c("u_pe") + c("u_pb")
    fair = F.bround((c("price_pe") * c("u_pe") + c("price_pb") * c("u_pb")) / total / 100) * 100
    rows = rows.withColumn("fair_price", fair)
    upside = F.when(c("live_price") > 0, (c("fair_price") - c("live_price")) / F.nullif("live_price", F.lit(0.0)) * 100).otherwise(0.0)
    verdict = F.when(c("upside_pct") > 15, "UNDERVALUED").when(c("upside_pct") < -15, "OVERVALUED").otherwise("FAIR")
    return rows.withColumn("upside_pct", upside).withColumn("verdict", verdict).drop("m_pe", "m_pb", "r", "u_pe", "u_pb")


def profit_cagr(profits: DataFrame, key: str = "symbol", year: str = "year", profit: str = "profit") -> DataFrame:
    """Compound growth from the first to the last year with a positive profit; NULL outside -50 % to 100 %."""
    some = profits.where(F.col(profit) > 0).groupBy(key).agg(F.min_by(profit, year).alias("a"), F.max_by(profit, year).alias("b"), (F.max(year) - F.min(year)).alias("span"))
    rate = F.when(F.col("span") > 0, F.pow(F.col("b") / F.col("a"), 1 / F.nullif(F.col("span"), F.lit(0)).cast("double")) - 1)
    return profits.select(key).distinct().join(some.select(key, rate.alias("rate")), key, "left").select(key, F.when(F.col("rate").between(-0.5, 1.0), F.col("rate")).alias("cagr"))


def multiple_summary(daily: DataFrame, key: str = "symbol") -> DataFrame:
    """Mean and median of pe, pb, ps; the number of data points counts pe only."""
    stats = [f(c).alias(f"{c}_{name}") for c in ("pe", "pb", "ps") for name, f in (("mean", F.avg), ("median", F.median))]
    return daily.groupBy(key).agg(*stats, F.count("pe").alias("data_points_count"))


def metric_status(df: DataFrame, current: str, mean: str, median: str) -> DataFrame:
    """Differences from mean and median in percent, and what they are called."""
    a, b = num.percent_change(current, mean), num.percent_change(current, median)
    return df.withColumns({"diff_vs_mean_pct": a, "diff_vs_median_pct": b, "status_vs_mean": num.status_label(a), "status_vs_median": num.status_label(b)})
