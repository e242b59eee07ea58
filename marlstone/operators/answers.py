"""Forecast requests answered from a report, else from what was computed before, else by one computation for all that is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.sources.store import KeyedTable, scratch

VALUES = ("feature_year", "revenue_pred", "profit_pred", "revenue_actual", "profit_actual")
_TYPES = {c: "int" if c == "feature_year" else "double" for c in VALUES}
CACHE = "symbol string, wanted_year int, digest string, target_year int, " + ", ".join(f"{c} {t}" for c, t in _TYPES.items()) + ", computed_at timestamp"


def cache(spark: SparkSession, path: str, buckets: int = 32) -> KeyedTable:
    """Computed forecasts by symbol, year and the digest of the bundle that made them, so another bundle's rows aren't found."""
    return KeyedTable(spark, path, ["symbol", "wanted_year", "digest"], CACHE, buckets)


def bundle_digest(spark: SparkSession, path: str) -> str:
    """A digest of a saved bundle's files. The same model saved again may have another one, since Spark notes the time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.sha2("content", 256).alias("h"), F.regexp_replace("path", r"part-(\d+)-[0-9a-f-]{36}", "part-$1").alias("f"))
    return named.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "f", "h"))), "\n"), 256)).first()[0]


def _typed(rows: DataFrame, *first: str) -> DataFrame:
    return rows.select(*first, *((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in _TYPES.items()))


def picked(keys: DataFrame, rows: DataFrame, order: str = "ord") -> DataFrame:
    """(symbol, wanted_year, target_year, values) of the keys whose symbol has rows: the last row of the wanted year, or without one that of the latest year."""
    found = keys.join(rows.withColumn("__s", F.upper(text.strip("symbol"))).drop("symbol"), F.col("symbol") == F.col("__s"))
    best = F.struct(F.coalesce(F.col("target_year") == F.col("wanted_year"), F.lit(False)), "target_year", order)
    return found.groupBy("symbol", "wanted_year").agg(F.max_by(F.struct("target_year", *VALUES), best).alias("r")).select("symbol", "wanted_year", "r.*")


def answered(
    requests: DataFrame, report: DataFrame, detail: DataFrame, store: KeyedTable, bundles: DataFrame, compute: Callable[[DataFrame], DataFrame], default_year: int | None = None, enabled: bool = True
) -> DataFrame:
    """Each request (request_id, symbol, target_year) with predict_target_year, the values, ``tier``, ``error_code`` and ``error_message``.

    report and detail: (symbol, target_year, values, ord); the detail serves if the report has no rows at all. bundles: (symbol, digest)
    of the symbols that can be computed, one row a symbol. compute: from (symbol, wanted_year) of all keys that neither a table nor the
    cache has, to (symbol, wanted_year, target_year, values), called once. It need not answer all, and gives a
    key one row at most. Its rows go to the cache before they are given out.

    Symbols are compared trimmed and in upper case; a blank or null one is INVALID_ARGS. A request without a year takes the default;
    without that too it takes a table's latest year and can't be computed. Work is done once for each symbol and year, however many requests ask for it.
    """
    spark = requests.sparkSession
    year = F.coalesce(F.col("target_year").cast("int"), F.lit(default_year).cast("int"))
    asked = requests.select("request_id", F.nullif(F.upper(text.strip("symbol")), F.lit("")).alias("symbol"), year.alias("wanted_year"))
    if not enabled:
        code = F.when(F.col("symbol").isNull(), "INVALID_ARGS").otherwise("FORECAST_DISABLED")
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (_TYPES | {"tier": "string"}).items()]
        return asked.select("request_id", "symbol", F.col("wanted_year").alias("predict_target_year"), *nothing, code.alias("error_code"), F.lit("forecasts are off").alias("error_message"))
    keys = asked.where("symbol is not null").select("symbol", "wanted_year").distinct()
    tier = next((n for n, t in (("report", report), ("detail", detail)) if not t.isEmpty()), None)
    columns = ("symbol", "wanted_year", "target_year")
    tables = {"report": report, "detail": detail}
    known = picked(keys, _typed(tables[tier], "symbol", "target_year", "ord")) if tier else _typed(keys.withColumn("target_year", F.lit(None).cast("int")).limit(0), *columns)
    base = scratch(spark, "answers")
    known.withColumn("tier", F.lit(tier).cast("string")).write.parquet(f"{base}/known")
    known = spark.read.parquet(f"{base}/known")
    unknown = keys.where("wanted_year is not null").join(known.select("symbol").distinct(), "symbol", "left_anti")
    wanted = unknown.join(bundles.select(F.upper(text.strip("symbol")).alias("symbol"), "digest"), "symbol")
    hits = _typed(wanted.join(store.read(), ["symbol", "wanted_year", "digest"]), *columns).withColumn("tier", F.lit("cache"))
    hits.write.parquet(f"{base}/hits")
    hits = spark.read.parquet(f"{base}/hits")
    missing = wanted.join(hits.select("symbol", "wanted_year"), ["symbol", "wanted_year"], "left_anti")
    missing.write.parquet(f"{base}/missing")
    missing = spark.read.parquet(f"{base}/missing")
    made = hits.limit(0)
    if not missing.isEmpty():
        _typed(compute(missing.select("symbol", "wanted_year")), *columns).withColumn("tier", F.lit("computed")).write.parquet(f"{base}/made")
        made = spark.read.parquet(f"{base}/made")
        new = made.join(missing, ["symbol", "wanted_year"]).withColumn("computed_at", F.current_timestamp())
        if not new.isEmpty():
            store.upsert(new.drop("tier"), "computed_at", kept=())
    answers = known.unionByName(hits).unionByName(made)
    out = asked.join(answers.withColumnRenamed("wanted_year", "w"), (asked["symbol"] == answers["symbol"]) & asked["wanted_year"].eqNullSafe(F.col("w")), "left").drop(answers["symbol"], F.col("w"))
    lacking = F.when(F.col("symbol").isNull(), "INVALID_ARGS").when(F.lit(tier is None), "FORECAST_REPORT_EMPTY").otherwise("FORECAST_SYMBOL_NOT_FOUND")
    why = F.when(F.col("symbol").isNull(), "symbol is required").when(F.col("wanted_year").isNull(), "missing_target_year").otherwise("nothing in tables or cache, and nothing computed")
    none = F.col("tier").isNull()
    shown = {"predict_target_year": F.coalesce("wanted_year", "target_year"), "error_code": F.when(none, lacking), "error_message": F.when(none, why)}
    return out.withColumns(shown).select("request_id", "symbol", "predict_target_year", *VALUES, "tier", "error_code", "error_message")
