"""Vendor records: aliases, codes, names, event rows, what is still to fetch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import num, text
from marlstone.sources.store import scratch


def alias_value(df: DataFrame, aliases: Sequence[str]) -> Column:
    """The first alias that the frame has and that isn't NULL, as a number."""
    present = [F.col(f"`{a}`") for a in aliases if a in df.columns]
    return F.coalesce(*(num.finite(c) for c in present)) if present else F.lit(None).cast("double")


def alias_warnings(df: DataFrame, aliases: dict[str, Sequence[str]]) -> Column:
    """Names of the fields whose value is there but is no number."""
    bad = [F.when(F.coalesce(*(F.col(f"`{a}`").cast("string") for a in names if a in df.columns), F.lit(None)).isNotNull() & alias_value(df, names).isNull(), F.lit(field)) for field, names in aliases.items() if any(a in df.columns for a in names)]
    return F.filter(F.array(*bad), lambda x: x.isNotNull()) if bad else F.array().cast("array<string>")


def statement_rows(df: DataFrame, company: Column, fields: dict[str, Sequence[str]], year: Sequence[str] = ("year",), quarter: Sequence[str] = ("quarter",)) -> DataFrame:
    """companyId, year, quarter (0 where missing), the fields, and a list of warnings in place of exceptions."""
    period = [F.coalesce(alias_value(df, a), F.lit(0.0)).cast("int").alias(n) for n, a in (("year", year), ("quarter", quarter))]
    return df.select(company.alias("companyId"), *period, *(alias_value(df, a).alias(f) for f, a in fields.items()), alias_warnings(df, fields).alias("_warnings"))


def icb_code(value: Column) -> Column:
    """A classification code as plain digits where it is a whole number, else trimmed; NULL if blank."""
    s = text.strip(value.cast("string"))
    number = F.replace(s, F.lit(","), F.lit("")).try_cast("double")
    return F.when(number == F.floor(number), F.floor(number).cast("long").cast("string")).otherwise(F.nullif(s, F.lit("")))


def clean_date(value: Column) -> Column:
    return F.nullif(text.strip(value), F.lit(""))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(text.strip(v), F.lit("")) for v in values))


def valid_symbols(df: DataFrame, symbol: str = "symbol", shortest: int = 2, longest: int = 4) -> DataFrame:
    return df.withColumn(symbol, F.upper(text.strip(symbol))).where(F.length(symbol).between(shortest, longest))


def dividend_events(events: DataFrame, title: str = "event_title", listed: str = "event_list_name") -> DataFrame:
    """Events whose title names a dividend or bonus; CASH if title or list name speaks of money, else STOCK."""
    names = F.concat_ws(" ", title, listed)
    kept = events.where(F.coalesce(F.col(title).rlike("(?iu)cổ tức|thưởng"), F.lit(False)))
    return kept.withColumn("eventType", F.when(F.lower(names).contains("tiền"), "CASH").otherwise("STOCK"))


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What isn't done yet."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def market_of(exchange: Column) -> Column:
    e = F.upper(text.strip(exchange))
    return F.when(e == "HNX", "hnx").when(e == "UPCOM", "upcom").otherwise("hsx")


def exchange_filter(df: DataFrame, wanted: str | None, exchange: str = "exchange") -> DataFrame:
    """Rows of the exchanges in a comma-separated list; all without one."""
    names = [x.strip().upper() for x in (wanted or "").split(",") if x.strip()]
    return df.where(F.upper(text.strip(exchange)).isin(*names)) if names else df


def valid_years(years: Column, most: int = 6) -> Column:
    """Years from 1990 to 2100, each once, ascending, the first six."""
    whole = F.transform(years, lambda y: y.try_cast("int"))
    return F.slice(F.array_sort(F.array_distinct(F.filter(whole, lambda y: y.between(1990, 2100)))), 1, most)


def paged(rows: DataFrame, key: str, size: int, path: str, after=None) -> DataFrame:
    """Rows with a key above ``after`` (all without one) with ``page_no`` from 0: pages of ``size`` in ascending order of the key, the last one shorter.

    Keys are unique; null ones go. Rows are dealt in ranges of the key and written below ``path`` by range, so that ranges stay as they
    are; the ranges' counts say where each begins, and no task sorts more than one range.
    """
    if size < 1:
        raise ValueError(f"a page holds {size} rows")
    left = rows.where(F.col(key).isNotNull() if after is None else F.col(key) > F.lit(after))
    left.repartitionByRange(key).withColumn("__range", F.spark_partition_id()).write.mode("overwrite").partitionBy("__range").parquet(path)
    made = rows.sparkSession.read.schema(left.withColumn("__range", F.lit(0)).schema).parquet(path)
    counts = sorted(made.groupBy("__range").agg(F.count("*")).collect())
    before, start = [], 0
    for number, n in counts:
        before.append((number, start))
        start += n
    begins = F.broadcast(rows.sparkSession.createDataFrame(before, "__range int, __start long"))  # a row a range
    place = F.col("__start") + F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return made.join(begins, "__range").withColumn("page_no", F.floor(place / size)).select(*rows.columns, "page_no")


def walk(rows: DataFrame, key: str, size: int, folder: str, handle: Callable[[DataFrame, int], None]) -> int:
    """Gives each page of the rows above the bookmark to ``handle``, in order of the key, and moves the bookmark behind it; the number of pages given.

    The bookmark is a file in ``folder`` for each page done, which holds its last key, so a walk that was stopped goes on with the
    first page that isn't done. A page whose handling failed half way is given again.
    """
    spark = rows.sparkSession
    typed = rows.schema[key].dataType
    marks = spark.read.schema(f"last {typed.simpleString()}").parquet(f"{folder}/marks") if _exists(spark, f"{folder}/marks") else None
    after = marks.agg(F.max("last")).first()[0] if marks is not None else None
    pages = paged(rows, key, size, scratch(spark, "pages"), after)
    ends = {r["page_no"]: r["last"] for r in pages.groupBy("page_no").agg(F.max(key).alias("last")).collect()}
    for number in sorted(ends):
        handle(pages.where(F.col("page_no") == number).drop("page_no"), number)
        spark.createDataFrame([(ends[number],)], f"last {typed.simpleString()}").coalesce(1).write.mode("append").parquet(f"{folder}/marks")
    return len(ends)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
