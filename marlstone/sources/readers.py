"""Scans: panels and series from CSV, JSON documents, reports with loosely named columns, page files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.functions import num


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """With a header; without a schema all columns are strings, to be coerced one by one."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def coerced(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Numbers where they can be read, else NULL."""
    return df.withColumns({c: num.finite(c) for c in numeric if c in df.columns})


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Multi-line JSON; documents that can't be read are left out."""
    frame = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED")
    return frame.json(path)


def json_column(df: DataFrame, column: str, schema: StructType | str) -> DataFrame:
    """The fields of a JSON text column; rows whose text is no object go."""
    return df.withColumn("__j", F.from_json(column, schema)).where("__j is not null").select(*(c for c in df.columns if c != column), "__j.*")


def resolve(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Columns by name whatever the case and spaces around; a required one that is missing is an error, an optional one NULL."""
    there: dict[str, str] = {}
    for c in df.columns:
        there.setdefault(c.strip().lower(), c)
    lost = [c for c in required if c not in there]
    if lost:
        raise ValueError(f"columns are missing: {', '.join(lost)}")
    return df.select(*(F.col(f"`{there[c]}`").alias(c) if c in there else F.lit(None).cast("string").alias(c) for c in (*required, *optional)))


def report_table(df: DataFrame) -> DataFrame:
    """Symbol, years and predictions of a report; blank symbols go."""
    rows = resolve(df, ("symbol", "revenue_pred", "profit_pred"), ("feature_year", "target_year", "revenue_actual", "profit_actual"))
    rows = rows.withColumn("symbol", F.upper(F.trim("symbol"))).where("symbol <> ''")
    whole = {c: num.finite(c).cast("int") for c in ("feature_year", "target_year")}
    return rows.withColumns(whole | {c: num.finite(c) for c in ("revenue_pred", "profit_pred", "revenue_actual", "profit_actual")})


def pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], pattern: str = "*.pdf") -> DataFrame:
    """(file, page, text) of binary files by an injected parser, one file at a time inside tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                texts = parse(content)
                yield pd.DataFrame({"file": [name] * len(texts), "page": list(range(1, len(texts) + 1)), "text": texts})

    return files.mapInPandas(run, "file string, page int, text string")
