"""Annual company panels: joins with macro series and industries, lags and windows, clipping, encoding, metrics.

A panel has one row for each symbol and year. NULL means missing. Everything is
one lazy plan but for the few numbers that a later column needs as constants
(quantiles, medians, group names), each from one aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import checks, num

# Macro series that matter to each industry group, and ratio columns that may come as fractions.
SECTOR_MACROS = {
    "KIM_LO_I_C_NG_NGHI_P_KHAI_KHO_NG": ("hrc_log", "iron_ore_log", "coal_log", "spread_hrc_iron"),
    "CH_BI_N_THUY_S_N": ("usd_vnd_log", "bdry_shipping_etf_log"),
    "S_N_XU_T_TH_C_PH_M": ("usd_vnd_log", "bdry_shipping_etf_log"),
    "S_N_XU_T_V_T_LI_U_X_Y_D_NG": ("interest_loan_midlong_pct", "usd_vnd_log"),
    "X_Y_D_NG_V_V_T_LI_U_X_Y_D_NG": ("interest_loan_midlong_pct", "usd_vnd_log"),
    "U_T_B_T_NG_S_N_V_D_CH_V": ("cpi_inflation_yoy_pp", "gdp_ty_dong_log", "interest_loan_short_pct", "interest_loan_midlong_pct"),
    "B_N_L_": ("cpi_inflation_yoy_pp", "gold_gc_log"),
    "N_NG_L_NG": ("oil_brent_log", "nat_gas_log"),
    "NG_N_H_NG": ("interest_deposit_12m_pct", "interest_loan_short_pct"),
    "C_NG_TY_CH_NG_KHO_N": ("vnindex_daily_return_mean_pct", "vnindex_growth_yoy_pct", "vnindex_trading_volume_avg", "vnindex_trading_value_avg"),
}
#: Series of each industry group of the finer grouping.
INDUSTRY_MACROS = {
    "X_Y_D_NG_V_V_T_LI_U_X_Y_D_NG": ("hrc_log", "interest_loan_midlong_pct", "cpi_inflation_yoy_pp"),
    "V_N_T_I_KHO_B_I": ("oil_brent_log", "bdry_shipping_etf_log", "usd_vnd_log"),
    "U_T_B_T_NG_S_N_V_D_CH_V": ("cpi_inflation_yoy_pp", "gdp_ty_dong_log", "interest_loan_short_pct", "interest_loan_midlong_pct"),
    "S_N_XU_T_TH_C_PH_M": ("sugar_log", "rice_log", "cpi_inflation_yoy_pp"),
    "GA_N_C_V_C_C_TI_N_CH_KH_C": ("nat_gas_log", "oil_brent_log"),
    "H_A_CH_T": ("rubber_log", "oil_brent_log", "usd_vnd_log"),
    "I_N": ("coal_log", "nat_gas_log", "oil_brent_log"),
    "D_NG_C_NH_N": ("cpi_inflation_yoy_pp", "usd_vnd_log"),
    "D_C_PH_M_V_C_NG_NGH_SINH_H_C": ("usd_vnd_log", "cpi_inflation_yoy_pp"),
    "KHAI_KHO_NG": ("coal_log", "iron_ore_log", "oil_brent_log"),
    "C_NG_TY_CH_NG_KHO_N": ("interest_deposit_12m_pct", "gdp_ty_dong_log", "vnindex_daily_return_mean_pct", "vnindex_growth_yoy_pct", "vnindex_trading_volume_avg", "vnindex_trading_value_avg"),
    "D_CH_V_H_TR_T_V_N_THI_T_K": ("gdp_ty_dong_log", "interest_loan_short_pct"),
    "KIM_LO_I_C_NG_NGHI_P_KHAI_KHO_NG": ("hrc_log", "iron_ore_log", "coal_log"),
    "DU_L_CH_V_GI_I_TR": ("gdp_ty_dong_log", "oil_brent_log", "usd_vnd_log"),
    "U_NG": ("sugar_log", "cpi_inflation_yoy_pp", "coffee_log"),
    "TRUY_N_TH_NG": ("gdp_ty_dong_log",),
    "B_N_L_CHUNG": ("cpi_inflation_yoy_pp", "gdp_ty_dong_log"),
    "NG_N_H_NG": ("interest_deposit_12m_pct", "interest_loan_midlong_pct", "usd_vnd_log"),
    "C_KH_CH_T_O_M_Y": ("hrc_log", "usd_vnd_log", "iron_ore_log"),
    "H_NG_GIA_D_NG_X_Y_D_NG_NH_C_A": ("interest_loan_midlong_pct", "hrc_log"),
    "C_NG_NGHI_P_CHUNG": ("gdp_ty_dong_log", "interest_loan_short_pct"),
    "C_NG_NGH_PH_N_C_NG_V_THI_T_B": ("usd_vnd_log", "gdp_ty_dong_log"),
    "THI_T_B_I_N_I_N_T": ("hrc_log", "usd_vnd_log"),
    "L_M_NGHI_P_V_GI_Y": ("usd_vnd_log", "gdp_ty_dong_log"),
    "PH_N_M_M_V_D_CH_V_I_N_TO_N": ("gdp_ty_dong_log", "usd_vnd_log"),
    "T_V_LINH_KI_N_T": ("usd_vnd_log", "hrc_log", "interest_loan_midlong_pct"),
    "B_O_HI_M_PHI_NH_N_TH": ("interest_deposit_12m_pct", "cpi_inflation_yoy_pp"),
    "THI_T_B_V_D_CH_V_Y_T": ("usd_vnd_log", "cpi_inflation_yoy_pp"),
    "T_I_CH_NH_T_NG_H_P": ("interest_deposit_12m_pct", "gdp_ty_dong_log"),
    "B_N_L_TH_C_PH_M_V_D_C_PH_M": ("cpi_inflation_yoy_pp", "gdp_ty_dong_log"),
    "H_NG_TI_U_KHI_N": ("gdp_ty_dong_log", "cpi_inflation_yoy_pp"),
    "THU_C_L": ("cpi_inflation_yoy_pp", "gdp_ty_dong_log"),
    "VI_N_TH_NG_C_NH": ("gdp_ty_dong_log", "interest_loan_midlong_pct"),
    "B_O_HI_M_NH_N_TH": ("interest_deposit_12m_pct", "gdp_ty_dong_log"),
    "VI_N_TH_NG_DI_NG": ("gdp_ty_dong_log", "usd_vnd_log"),
}
PERCENT_LIKE = ("roe", "roa", "nim_pct", "gross_margin", "net_margin", "profit_margin_calc_pct", "net_debt_to_equity_pct", "receivable_ratio_pct", "revenue_yoy_pct", "profit_yoy_pct", "revenue_momentum_pct", "profit_momentum_pct", "asset_growth_yoy", "profit_margin_change", "interest_deposit_12m_pct", "interest_loan_short_pct", "interest_loan_midlong_pct")


def drop_identifiers(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Without columns named id or ending in _id."""
    gone = sorted(c for c in df.columns if c.lower() == "id" or c.lower().endswith("_id"))
    return df.drop(*gone), gone


def annual(df: DataFrame) -> DataFrame:
    return df.where("quarter = 0") if "quarter" in df.columns else df


def with_macro(panel: DataFrame, macro: DataFrame, lag: int = 0) -> DataFrame:
    """Left join on the year, the series shifted by lag; a year that occurs twice in the series multiplies rows.

    Whether the series is broadcast is Spark's choice, by its size.
    """
    shifted = macro.where("year is not null").withColumn("year", (F.col("year") + lag).cast(panel.schema["year"].dataType))
    return panel.join(shifted, "year", "left")


def macro_as_of(panel: DataFrame, macro: DataFrame, values: Sequence[str], order: str) -> DataFrame:
    """For each year of the panel the macro row of that year, else of the latest year before, else of the first year.

    The distinct years and the series are a few rows: the as-of lookup is made on them, and its result joined to the panel.
    """
    last = macro.where("year is not null").groupBy("year").agg(F.max_by(F.struct(*values), order).alias("row"))
    years = panel.select("year").distinct()
    both = years.withColumn("side", F.lit(1)).unionByName(last.withColumn("side", F.lit(0)), allowMissingColumns=True)
    # One row a year: a window over all of them stays small whatever the panel's size.
    back = Window.orderBy("year", "side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy("year", "side").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = both.select("year", "side", F.coalesce(F.last("row", ignorenulls=True).over(back), F.first("row", ignorenulls=True).over(ahead)).alias("row")).where("side = 1")
    return panel.join(found.select("year", *(F.col(f"row.{v}").alias(v) for v in values)), "year", "left")


def coalescing_merge(base: DataFrame, new: DataFrame, key: str, from_key: int | None = None) -> DataFrame:
    """Left join on the key; of columns on both sides the new value wins where it has one. Base's column order first."""
    taken = new.where(F.col(key) >= from_key) if from_key is not None else new
    renamed = taken.select(F.col(key), *(F.col(c).alias(f"{c}_new") for c in new.columns if c != key))
    joined = base.join(renamed, key, "left")
    both = [F.coalesce(f"{c}_new", c).alias(c) if f"{c}_new" in renamed.columns else F.col(c) for c in base.columns]
    return joined.select(*both, *(F.col(f"{c}_new").alias(c) for c in new.columns if c not in base.columns))


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of the rows of a key, the one of the highest order; one aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*").select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*").select(*df.columns)


def with_industry(panel: DataFrame, industries: DataFrame, order: str) -> DataFrame:
    """Left join of the industry group by symbol, the last of a symbol's rows; UNKNOWN without one."""
    unique = keep_last(industries.select(F.upper(F.trim("symbol")).alias("symbol"), "industry_group", order), ["symbol"], order).drop(order)
    joined = panel.withColumn("symbol", F.upper(F.trim("symbol"))).join(unique, "symbol", "left")
    return joined.withColumn("industry_group", F.coalesce("industry_group", F.lit("UNKNOWN")))


def by_symbol(order: str = "year"):
    return Window.partitionBy("symbol").orderBy(order)


def trend_features(panel: DataFrame, column: str, name: str) -> dict[str, Column]:
    """Lags, three-year mean and deviation, year-on-year change and momentum of a column; one window for all."""
    w = by_symbol()
    c, lag1 = F.col(column).cast("double"), F.lag(F.col(column).cast("double"), 1).over(w)
    three = w.rowsBetween(-2, 0)
    return {
        f"{name}_lag1": lag1,
        f"{name}_lag2": F.lag(c, 2).over(w),
        f"{name}_roll3_mean": F.avg(c).over(three),
        f"{name}_roll3_std": F.coalesce(F.stddev_pop(c).over(three), F.lit(0.0)),
        f"{name}_yoy_pct": F.when(F.coalesce(lag1, F.lit(0.0)) != 0, (c / F.nullif(lag1, F.lit(0.0)) - 1) * 100).otherwise(0.0),
        f"{name}_momentum_pct": F.when(F.coalesce(lag1, F.lit(0.0)) != 0, (c - lag1) / F.nullif(F.abs(lag1), F.lit(0.0)) * 100).otherwise(0.0),
    }


def margin(profit: str, revenue: str) -> Column:
    return F.when(F.coalesce(F.col(revenue), F.lit(0.0)) != 0, F.col(profit) / F.nullif(F.col(revenue), F.lit(0.0)) * 100).otherwise(0.0)


def delta_features(panel: DataFrame, revenue: str = "revenue_current", profit: str = "profit_after_tax", assets: str = "total_assets_reported", debt: str = "net_debt_to_equity_pct") -> DataFrame:
    """All trend features of revenue and profit, margin and its change, asset growth, lagged debt; one exchange and one sort."""
    w = by_symbol()
    out = panel.withColumns(trend_features(panel, revenue, "revenue") | trend_features(panel, profit, "profit") | {"profit_margin_calc_pct": margin(profit, revenue)})
    more = {"revenue_momentum_delta": F.coalesce(F.col(revenue) - F.col("revenue_lag1"), F.lit(0.0)), "profit_margin_change": F.coalesce(F.col("profit_margin_calc_pct") - F.lag("profit_margin_calc_pct").over(w), F.lit(0.0))}
    if assets in panel.columns:
        more["asset_growth_yoy"] = growth(F.col(assets), F.lag(assets).over(w))
    if debt in panel.columns:
        more[f"{debt}_lag1"] = F.lag(debt).over(w)
    return out.withColumns(more)


def growth(current: Column, before: Column) -> Column:
    """Relative change in percent; 0 where it isn't defined."""
    return F.coalesce((F.try_divide(current.cast("double"), F.nullif(before.cast("double"), F.lit(0.0))) - 1) * 100, F.lit(0.0))


def exact_quantiles(df: DataFrame, columns: dict[str, Column], shares: Sequence[float]) -> dict[str, list[float] | None]:
    """Interpolated quantiles of every column, without all its values in one task: NULL values don't count, and a column of none has none.

    Values are counted, and put in order by a range exchange; the few that the quantiles lie between are then found by
    their place, from the counts of earlier partitions. One number a column and partition goes through the driver.
    """
    rows = df.select(*(c.cast("double").alias(n) for n, c in columns.items()))
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("c"), F.col(f"`{n}`").alias("v")) for n in columns))).alias("x")).select("x.*").where("v is not null")
    counted = long.groupBy("c", "v").agg(F.count("*").alias("n"))
    dealt = counted.repartitionByRange("c", "v").sortWithinPartitions("c", "v").withColumn("part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sums = sorted(map(tuple, dealt.groupBy("c", "part").agg(F.sum("n")).collect()))
        totals: dict[str, int] = {}
        before = []
        for name, part, n in sums:
            before.append((name, part, totals.get(name, 0)))
            totals[name] = totals.get(name, 0) + n
        if not totals:
            return dict.fromkeys(columns)
        places = sorted({(c, int(p)) for c, n in totals.items() for s in shares for p in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))})
        spark = df.sparkSession
        inside = Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # only partitions that hold a wanted place
        ends = {(c, p): b for c, p, b in before}
        held = {(c, p): n for c, p, n in sums}
        wanted = [(c, p, place - b) for (c, p), b in ends.items() for k, place in places if k == c and b <= place < b + held[c, p]]
        ask = F.broadcast(spark.createDataFrame(wanted, "c string, part int, place long"))
        ranked = dealt.join(F.broadcast(spark.createDataFrame(sorted({(c, p) for c, p, _ in wanted}), "c string, part int")), ["c", "part"]).withColumn("upto", F.sum("n").over(inside))
        found = {(r["c"], r["part"], r["place"]): r["v"] for r in ranked.join(ask, ["c", "part"]).where("place >= upto - n and place < upto").collect()}
    finally:
        dealt.unpersist()
    at = {(c, place + ends[c, p]): found[c, p, place] for c, p, place in wanted}
    out: dict[str, list[float] | None] = {}
    for c in columns:
        n = totals.get(c, 0)
        pairs = [(at[c, math.floor(s * (n - 1))], at[c, math.ceil(s * (n - 1))], s * (n - 1) % 1) for s in shares] if n else []
        out[c] = [lo + (hi - lo) * part for lo, hi, part in pairs] if n else None
    return out


def percent_columns(df: DataFrame, columns: Iterable[str] = PERCENT_LIKE) -> list[str]:
    """Columns whose 5th and 95th percentiles are both within 1.5: they hold fractions."""
    found = exact_quantiles(df, {c: num.finite(c) for c in columns if c in df.columns}, (0.05, 0.95))
    return [c for c, q in found.items() if q and max(map(abs, q)) <= 1.5]


def scaled_percent(df: DataFrame, columns: Iterable[str] = PERCENT_LIKE) -> DataFrame:
    return df.withColumns({c: F.col(c) * 100 for c in percent_columns(df, columns)})


def clip_bounds(train: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> dict[str, tuple[float, float]]:
    """Exact quantiles of the training rows; columns without values have none."""
    found = exact_quantiles(train, {c: num.finite(c) for c in columns}, checks.quantile_range(low, high))
    return {c: (min(q), max(q)) for c, q in found.items() if q}


def clipped(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: num.clip(c, *b) for c, b in bounds.items()})


def median_imputed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL as the column's exact median, or 0 where it has no values."""
    found = exact_quantiles(df, {c: num.finite(c) for c in columns}, (0.5,))
    return df.withColumns({c: F.coalesce(num.finite(c), F.lit(found[c][0] if found[c] else 0.0)) for c in columns})


def target_encoded(df: DataFrame, group: str, target: str, train: Column, name: str) -> DataFrame:
    """The group's mean target over training rows; a group unseen there gets the mean of the groups' means."""
    means = df.where(train).where(F.col(target).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.avg(target).alias(name))
    overall = means.agg(F.avg(name)).first()[0]
    return df.join(means, group, "left").withColumn(name, F.coalesce(F.col(name), F.lit(overall).cast("double")))


def group_names(df: DataFrame, group: str, most: int = 1000) -> list[str]:
    """The distinct groups in order. One-hot columns are for few groups: more than ``most`` is an error."""
    found = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{group} has more than {most} values")
    return sorted(found)


def one_hot(df: DataFrame, group: str, names: Sequence[str], prefix: str = "ind") -> DataFrame:
    return df.withColumns({f"{prefix}_{n}": (F.coalesce(F.col(group) == n, F.lit(False))).cast("double") for n in names})


def encoded_groups(df: DataFrame, group: str, target: str, train: Column, threshold: int = 15) -> DataFrame:
    """One-hot up to a number of groups, target means beyond."""
    if df.agg(F.countDistinct(group)).first()[0] <= threshold:
        return one_hot(df, group, group_names(df, group))
    return target_encoded(df, group, target, train, f"{group}_target_mean")


def sector_interactions(df: DataFrame, group: str, mapping: dict[str, Sequence[str]], boost: float = 1.0, prefix: str = "ix_sector") -> DataFrame:
    """For each group and its series: the value in the group, 0 outside; one projection."""
    return df.withColumns({f"{prefix}_{g}_{m}": F.when(F.col(group) == g, F.col(m) * boost).otherwise(0.0) for g, series in mapping.items() for m in series if m in df.columns})


def industry_interactions(df: DataFrame, boost: float = 1.0, mapping: dict[str, Sequence[str]] = INDUSTRY_MACROS, prefix: str = "ind") -> DataFrame:
    """For each group whose one-hot column is there, and each of its series: their product, missing values as 0. A boost that isn't positive is 1."""
    factor = boost if boost > 0 else 1.0
    value = lambda c: F.coalesce(num.finite(c), F.lit(0.0))
    return df.withColumns({f"ix_{m}__{g}": value(m) * value(f"{prefix}_{g}") * factor for g, series in mapping.items() if f"{prefix}_{g}" in df.columns for m in series if m in df.columns})


def steel_features(df: DataFrame, group: str, steel: str, boost: float = 1.0) -> DataFrame:
    """Spread of steel over ore, membership in the steel group, and their product."""
    spread = F.col("hrc_log") - F.col("iron_ore_log") if {"hrc_log", "iron_ore_log"} <= set(df.columns) else F.lit(0.0)
    return df.withColumns({"spread_hrc_iron": spread, "ind_steel": (F.coalesce(F.col(group) == steel, F.lit(False))).cast("double")}).withColumn("ix_spread_hrc_iron_steel", F.col("spread_hrc_iron") * F.col("ind_steel") * boost)


def debt_parameters(train: DataFrame, debt: Column, low: float = 0.01, high: float = 0.99, threshold: float = 0.8) -> dict[str, float] | None:
    """Bounds of the debt ratio, and the high quantile of the ratio within these bounds."""
    bounds = exact_quantiles(train, {"debt": debt}, (low, high))["debt"]
    if not bounds:
        return None
    lower, upper = sorted(bounds)
    cut = exact_quantiles(train, {"debt": num.clip(debt, lower, upper)}, (threshold,))["debt"][0]
    return {"lower": lower, "upper": upper, "threshold": cut}


def debt_adjusted(df: DataFrame, rate: str, debt: Column, params: dict[str, float] | None, boost: float = 1.5) -> DataFrame:
    """The rate times a boost where the clipped debt ratio reaches the threshold; the multiplier as a column."""
    if not params:
        return df.withColumn(f"{rate}_multiplier", F.lit(1.0))
    high = num.clip(debt, params["lower"], params["upper"]) >= params["threshold"]
    return df.withColumn(f"{rate}_multiplier", F.when(high, boost).otherwise(1.0)).withColumn(rate, F.col(rate) * F.col(f"{rate}_multiplier"))


def recency_weight(year: Column, first: int, last: int, mode: str = "exp", least: float = 0.35, base: float = 0.8) -> Column:
    """Weight of a training year between the first and the last."""
    least = min(1.0, max(0.0, least))
    if mode == "none" or mode == "linear" and last <= first:
        return F.lit(1.0)
    if mode == "linear":
        return F.lit(least) + (1.0 - least) * num.clip((year - first) / (last - first), 0.0, 1.0)
    return F.lit(least) + (1.0 - least) * F.pow(F.lit(min(0.999999, max(1e-6, base))), F.greatest(F.lit(last) - year, F.lit(0)).cast("double"))


def error_metrics(df: DataFrame, group: str, actual: str, predicted: str) -> DataFrame:
    """WAPE, MAPE (zeros skipped), MAE, RMSE and R2 by group, over finite pairs; one aggregation."""
    pairs = df.select(group, num.finite(actual).alias("y"), num.finite(predicted).alias("p")).dropna(subset=["y", "p"])
    e = F.col("p") - F.col("y")
    return pairs.groupBy(group).agg(
        F.count("*").alias("n"),
        F.try_divide(F.sum(F.abs(e)), F.nullif(F.sum(F.abs("y")), F.lit(0.0))).alias("wape"),
        F.avg(F.abs(F.try_divide(e, F.nullif(F.col("y"), F.lit(0.0))))).alias("mape"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.nullif(F.var_pop("y") * F.count("*"), F.lit(0.0)))).alias("r2"),
    )


def latest_years(df: DataFrame, keys: Sequence[str], year: str, n: int) -> DataFrame:
    """Rows of the latest n distinct years of a key."""
    return df.withColumn("__rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(year)))).where(f"__rank <= {int(n)}").drop("__rank")
