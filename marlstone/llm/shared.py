"""The folder that driver and executors share, and small helpers of all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text for a hash shard of its shingles, words or lines.
SHARD_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session (tests, a laptop) gets a temporary folder; on a cluster that is an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut there, and lost executors cost no recomputation.

    The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def shards(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> int:
    """How many hash shards to deal to: one for each ``SHARD_BYTES`` of text, but at least the session's shuffle partitions.

    A shard is one Arrow table of one task, so its size must not grow with the input.
    """
    size = docs.select(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
