"""Incremental runs: new files only, each batch upserted, so a run that is repeated changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marlstone.sources.store import KeyedTable


def file_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", per_batch: int = 1000, clean: str | None = None, archive: str | None = None) -> DataFrame:
    """Files as they arrive; read ones can be deleted or archived."""
    reader = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_batch)
    if clean:
        reader = reader.option("cleanSource", clean)
        if archive:
            reader = reader.option("sourceArchiveDir", archive)
    return reader.load(path)


def run_available(stream: DataFrame, table: KeyedTable, checkpoint: str, order: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """All that has arrived since the checkpoint, prepared and upserted batch by batch; ends when there is no more."""

    def write(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            table.upsert(prepare(batch), order)

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def rollup(events: DataFrame, time: str, value: str, keys: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Windowed counts and sums with a watermark, for streams and tables alike. An extension: event-time windows."""
    out = events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "total")
