"""A training corpus from raw documents: quality rules, line dedup, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept, which ``run`` has written
as Parquet and read again. All but the last return the columns of documents. Null texts are empty; an empty table stays empty;
rows without an id or with another's id take part like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import linededup, neardup, packing, quality
from marlstone.llm.shared import written

#: Stands for a null id, behind all others.
LAST = 2**63 - 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    return quality.filtered(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in the first only; n_chars follows the text."""
    done = linededup.deduplicated(docs).select(*docs.columns)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of linked documents one stays: of its least id (null comes last) and, among texts of that id, of the least hash.

    Rows of one id and one text are copies. Texts without words are linked with nothing, so that all of them stay.
    """
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "__hash": F.xxhash64("text")})
    found = neardup.linked(keyed, id_col="__id", carry="__hash").select("__id", F.col("carried").alias("__hash"), "component")
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct("__id", "__hash")).alias("f")).select("f.__id", "f.__hash")
    kept = keyed.join(first, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"])
    empty = keyed.join(found.where("component is null").select("__id", "__hash").distinct(), ["__id", "__hash"], "left_semi")
    return kept.unionByName(empty).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens in which every source has its share: one row for each piece of a document."""
    return packing.packed(packing.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("packing", pack)]

#: The last stage's token ids can't be had in SQL; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
