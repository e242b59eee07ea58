"""Industry trees: parents by longest prefix or by level, checked against the codes there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import num


def parent_code(code: Column, level: Column) -> Column:
    """Four-digit codes: a level zeroes the digits from it on."""
    c = F.trim(code)
    out = F.when(level == 2, F.concat(F.substring(c, 1, 1), F.lit("000"))).when(level == 3, F.concat(F.substring(c, 1, 2), F.lit("00"))).when(level == 4, F.concat(F.substring(c, 1, 3), F.lit("0")))
    return F.when(F.length(c) == 4, out)


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes (code, level) with parent_code by level, NULL where no such code exists, and their stable ids."""
    known = nodes.select(F.col("code").alias("parent_code")).distinct().withColumn("known", F.lit(True))
    out = nodes.withColumn("parent_code", parent_code(F.col("code"), F.col("level"))).join(known, "parent_code", "left")
    named = out.select(*nodes.columns, F.when(F.col("known"), F.col("parent_code")).alias("parent_code"))
    return named.withColumns({"id": num.uuid5_url(F.concat(F.lit("icb:"), "code")), "parent_id": num.uuid5_url(F.concat(F.lit("icb:"), "parent_code"))})


def longest_prefix_parents(nodes: DataFrame, longest: int = 16) -> DataFrame:
    """nodes (code, level) with the longest proper prefix that is a code of a lower level.

    A code has few prefixes: each is joined as it stands, where comparing all pairs would grow with the square.
    """
    prefixes = nodes.select("code", "level", F.explode(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.substring(F.col("code"), F.lit(1), k))).alias("prefix")).where("length(prefix) < length(code)").distinct()
    other = nodes.select(F.col("code").alias("prefix"), F.col("level").alias("plevel")).distinct()
    best = prefixes.join(other, "prefix").where("plevel < level").groupBy("code", "level").agg(F.max_by("prefix", F.length("prefix")).alias("parent_code"))
    return nodes.join(best, ["code", "level"], "left")
