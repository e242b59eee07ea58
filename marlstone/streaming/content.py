"""What became of fetched files, across runs: downloaded, deduplicated by content, failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.sources.store import KeyedTable

LOG = "url string, digest string, at timestamp, error string, n long, status string, same_as string, batch long"


class ContentLog:
    """State by digest in a keyed table, and a log of statuses with a folder for each batch.

    A batch has (url, digest, at, error) rows. One with an error, or without a digest, has failed. Of the others the first of a
    digest, by time and url, is downloaded, if no earlier batch saw that digest; the rest are deduplicated, and ``same_as`` names the
    url that came first. A digest not seen for ``keep`` before a batch's first row of it is new again.

    Rows that are alike are one row of the log with their number ``n`` (the one that was downloaded stands for itself), counted before
    the exchange, so that copies of one file don't meet row by row. The state is read and written by digest only.

    A batch is logged before the state changes. If it comes again, its log is taken as it is and the state written from
    it, which gives the same state, so a run that was stopped anywhere ends as if it hadn't been. Let one run write at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keep: str | None = None, buckets: int = 32):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.state = KeyedTable(spark, f"{self.path}/state", ["digest"], "digest string, url string, first_at timestamp, seen_at timestamp", buckets)

    def _logged(self, number: int) -> bool:
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/batch={number}/_SUCCESS")
        return done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)

    def judged(self, batch: DataFrame) -> DataFrame:
        """The batch's rows for the log, without its number, from the state as it is."""
        groups = batch.select("url", F.when(F.col("error").isNull(), F.col("digest")).alias("digest"), "at", "error").groupBy("url", "digest", "at", "error").agg(F.count("*").alias("n"))
        first = groups.where("digest is not null").groupBy("digest").agg(F.min(F.struct("at", "url")).alias("f"))
        known = self.state.read().select("digest", F.col("url").alias("known_url"), "seen_at")
        fresh = F.col("known_url").isNull()
        if self.keep:
            fresh = fresh | F.coalesce(F.col("seen_at") < F.col("f.at") - F.expr(f"interval {self.keep}"), F.lit(False))
        origin = first.join(known, "digest", "left").select("digest", "f", fresh.alias("fresh"), F.when(fresh, F.col("f.url")).otherwise(F.col("known_url")).alias("same_as"))
        rows = groups.join(origin, "digest", "left")
        here = F.col("fresh") & F.struct("at", "url").eqNullSafe(F.col("f"))
        copies = F.struct(F.lit("deduplicated").alias("status"), F.col("n"), F.col("same_as"))
        parts = (
            F.when(F.col("digest").isNull(), F.array(F.struct(F.lit("failed").alias("status"), F.col("n"), F.lit(None).cast("string").alias("same_as"))))
            .when(here, F.array(F.struct(F.lit("downloaded").alias("status"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("same_as")), F.struct(F.lit("deduplicated").alias("status"), (F.col("n") - 1).alias("n"), F.col("same_as"))))
            .otherwise(F.array(copies))
        )
        return rows.select("url", "digest", "at", F.when(F.col("digest").isNull(), F.coalesce("error", F.lit("empty_body"))).alias("error"), F.inline(F.filter(parts, lambda p: p["n"] > 0)))

    def record(self, batch: DataFrame, number: int) -> None:
        """Logs a batch and brings the state up to it."""
        folder = f"{self.path}/log/batch={number}"
        if not self._logged(number):
            self.judged(batch).write.mode("overwrite").parquet(folder)
        rows = self.spark.read.schema(LOG).parquet(folder).where("digest is not null")
        url = F.coalesce(F.max(F.when(F.col("status") == "downloaded", F.col("url"))), F.max("same_as"))
        seen = rows.groupBy("digest").agg(url.alias("url"), F.min("at").alias("first_at"), F.max("at").alias("batch_seen"), F.bool_or(F.col("status") == "downloaded").alias("fresh"))
        known = self.state.read().select("digest", F.col("first_at").alias("known_first"), "seen_at")
        merged = seen.join(known, "digest", "left").select(
            "digest", "url", F.when(F.col("fresh"), F.col("first_at")).otherwise(F.coalesce("known_first", "first_at")).alias("first_at"), F.greatest("seen_at", "batch_seen").alias("seen_at")
        )
        if not merged.isEmpty():
            self.state.upsert(merged, "seen_at", kept=())

    def log(self) -> DataFrame:
        """All batches' rows."""
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def expire(self, now: str) -> None:
        """Forgets digests not seen for ``keep`` before a time, which only makes the state smaller."""
        if self.keep:
            self.state.delete(f"seen_at < timestamp'{now}' - interval {self.keep}")

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """All that has arrived since the checkpoint, batch by batch."""
        query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(self.record).start()
        query.awaitTermination()
        return query
