"""Term statistics, keyword, vector and fused retrieval."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import num, text

METRICS = {"cosine": (num.cosine, True), "dot": (num.dot, True), "euclid": (num.euclidean, False), "manhattan": (num.manhattan, False)}


def _exploded(docs: DataFrame, *more: Column | str, tokens: Column) -> DataFrame:
    """A row a token. An inner explode would add a filter on the tokens' number, which works them out once more."""
    return docs.select(*more, F.explode_outer(tokens).alias("token")).where("token is not null")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, id, tf)."""
    return _exploded(docs, id_col, tokens=text.tokens(text_col)).groupBy("token", id_col).agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, F.size(text.tokens(text_col)).cast("long").alias("doc_len"))


def terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, df, idf) with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); N counts all documents."""
    n = docs.count()
    counted = _exploded(docs, tokens=F.array_distinct(text.tokens(text_col))).groupBy("token").agg(F.count("*").alias("df"))
    return counted.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def bm25(docs: DataFrame, query: Sequence[str], id_col: str, text_col: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents with any of the query's tokens. An extension: the statistics' standard scorer.

    One pass over the texts: counts of the query's tokens are columns, so nothing is exploded or joined.
    """
    words = list(dict.fromkeys(query))
    docs = docs.select(id_col, text.tokens(text_col).alias("__tokens"))
    found = F.col("__tokens")

    def occurrences(word: str) -> Column:
        return F.size(F.filter(found, lambda t: t == word)).cast("long")

    counts = [occurrences(w).alias(f"tf{i}") for i, w in enumerate(words)]
    rows = docs.select(id_col, F.size(found).cast("long").alias("len"), *counts)
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words)))).first()
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), stats[f"df{i}"]
        idf = F.log(F.lit(1 + (stats["n"] - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(stats["avg"] or 1.0)))
    # A filter isn't pushed below inline, which would work the tokens out once more for each of them.
    one = F.array(F.struct("len", *(F.col(f"tf{i}") for i in range(len(words)))))
    return rows.select(id_col, F.inline_outer(one)).where(" or ".join(f"tf{i} > 0" for i in range(len(words))) or "false").select(id_col, score.alias("score"))


class TermIndex:
    """Postings with document lengths, dealt to folders by token, and the corpus's numbers: a query reads its tokens' folders only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.parquet(f"{path}/about").first()
        self.buckets, self.n, self.mean, self.id_col = about["buckets"], about["n"], about["mean"], about["id_col"]

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_col: str, text_col: str, buckets: int = 256) -> TermIndex:
        """Texts are tokenised once, for the postings; documents without tokens have none but count."""
        tokens = docs.select(F.col(id_col).alias("id"), text.tokens(text_col).alias("t")).withColumn("len", F.size("t").cast("long"))
        found = _exploded(tokens, "id", "len", tokens=F.col("t")).groupBy("token", "id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
        dealt = found.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)))
        dealt.repartitionByRange("bucket", "token", "id").sortWithinPartitions("bucket", "token", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        spark = docs.sparkSession
        lengths = spark.read.parquet(f"{path}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
        about = lengths.select(F.lit(buckets).alias("buckets"), F.lit(docs.count()).alias("n"), "total", F.lit(id_col).alias("id_col")).withColumn("mean", F.coalesce(F.try_divide("total", "n"), F.lit(0.0)))
        about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        return cls(spark, path)

    def bm25(self, query: Sequence[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(id, score) of the documents with any of the query's tokens."""
        words = list(dict.fromkeys(query))
        wanted = self.spark.createDataFrame([(w,) for w in words], "token string").select(F.pmod(F.xxhash64("token"), F.lit(self.buckets))).collect() if words else []
        rows = self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin([r[0] for r in wanted]) & F.col("token").isin(words))
        df = {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.count("*").alias("n")).collect()}
        idf = F.create_map(*(F.lit(x) for w, n in df.items() for x in (w, math.log(1 + (self.n - n + 0.5) / (n + 0.5))))) if df else F.create_map().cast("map<string,double>")
        one = F.element_at(idf, F.col("token")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(self.mean or 1.0)))
        return rows.groupBy(F.col("id").alias(self.id_col)).agg(F.sum(one).alias("score"))


def keyword(docs: DataFrame, query: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """(id, score) of documents in which a keyword occurs."""
    return docs.select(id_col, text.keyword_score(text_col, list(query)).alias("score")).where("score > 0")


def vector(items: DataFrame, query: Sequence[float], metric: str, id_col: str, vec_col: str) -> DataFrame:
    """(id, score) by similarity, or distance for euclid and manhattan."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return items.select(id_col, METRICS[metric][0](F.col(vec_col), q).alias("score")).where("score is not null")


def best_of(*found: DataFrame, id_col: str) -> DataFrame:
    """The highest score of an id over several searches, such as one for each year."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy(id_col).agg(F.max("score").alias("score"))


def top(found: DataFrame, k: int, id_col: str, larger: bool = True) -> DataFrame:
    """The k best; the id decides ties."""
    return found.orderBy(F.desc("score") if larger else F.asc("score"), F.asc(id_col)).limit(k)


def fused(lists: Sequence[DataFrame], k: int, id_col: str, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of short result lists: the sum of 1 / (60 + rank); ties go to the earlier list and rank."""
    ranked = [f.select(id_col, F.lit(i).alias("source"), F.row_number().over(Window.orderBy(F.desc("score"), F.asc(id_col))).alias("rank")) for i, f in enumerate(lists)]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    summed = out.groupBy(id_col).agg(F.sum(1 / (constant + F.col("rank"))).alias("score"), F.min(F.struct("source", "rank")).alias("first"))
    return summed.orderBy(F.desc("score"), "first").limit(k).select(id_col, "score")


def title_of(*candidates: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*(F.nullif(text.strip(c), F.lit("")) for c in candidates))
