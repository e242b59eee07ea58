"""Daily market series: canonical columns, yearly rollup, choice of a source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import num

# Names that providers use.
ALIASES = {"date": ("date", "datetime", "time", "timestamp"), "close": ("close", "adj close", "adj_close", "adjclose"), "volume": ("volume", "vol", "total_volume"), "value": ("value", "trading_value", "total_value")}


def canonical(df: DataFrame) -> DataFrame:
    """date, close, volume and, where there is one, value; the first alias present wins; rows without a date go."""
    by_name: dict[str, str] = {}
    for c in df.columns:
        by_name.setdefault(c.strip().lower(), c)
    chosen = {name: next((by_name[a] for a in aliases if a in by_name), None) for name, aliases in ALIASES.items()}
    columns = [F.to_date(F.col(f"`{chosen['date']}`").try_cast("timestamp")).alias("date") if chosen["date"] else F.lit(None).cast("date").alias("date")]
    for name in ("close", "volume", "value"):
        if chosen[name]:
            columns.append(num.finite(F.col(f"`{chosen[name]}`")).alias(name))
        elif name != "value":
            columns.append(F.lit(None).cast("double").alias(name))
    return df.select(*columns).where("date is not null")


def yearly(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Means, sums and the last close of each year, the mean daily return, and the growth of the last close.

    The return is against the day before in the whole series, so it crosses years.  A value that the series lacks is
    close times volume.  keys separate instruments; each one's days are one window.
    """
    rows = daily.dropna(subset=["date", "close", "volume"])
    order = Window.partitionBy(*keys).orderBy("date")
    whole = Window.partitionBy(*keys)
    reported = F.count("value").over(whole) > 0 if "value" in daily.columns else F.lit(False)
    value = F.when(reported, F.col("value")).otherwise(F.col("close") * F.col("volume")) if "value" in daily.columns else F.col("close") * F.col("volume")
    rows = rows.select(*keys, "date", "close", "volume", value.alias("value"), reported.alias("reported"), (F.try_divide("close", F.nullif(F.lag("close").over(order), F.lit(0.0))) - 1).alias("back"))
    out = rows.groupBy(*keys, F.year("date").alias("year")).agg(
        F.avg("close").alias("close_mean"),
        F.max_by("close", "date").alias("close_last"),
        (F.avg("back") * 100).alias("daily_return_mean_pct"),
        F.avg("volume").alias("volume_avg"),
        F.sum("volume").alias("volume_sum"),
        F.avg("value").alias("value_avg"),
        F.sum("value").alias("value_sum"),
        F.when(F.max("reported"), "reported").otherwise("close_x_volume_proxy").alias("value_source"),
    )
    years = Window.partitionBy(*keys).orderBy("year")
    return out.withColumn("growth_yoy_pct", (F.try_divide("close_last", F.nullif(F.lag("close_last").over(years), F.lit(0.0))) - 1) * 100)


def first_usable(sources: Sequence[tuple[str, DataFrame]]) -> tuple[DataFrame | None, list[dict]]:
    """The first source that has rows with a close and a volume, and a report on each one tried."""
    report = []
    for name, df in sources:
        row = canonical(df).agg(F.count("*").alias("rows"), F.count("close").alias("closes"), F.count("volume").alias("volumes")).first()
        report.append({"source": name, "rows": row["rows"], "has_close": row["closes"] > 0, "has_volume": row["volumes"] > 0})
        if row["closes"] and row["volumes"]:
            return canonical(df), report
    return None, report
