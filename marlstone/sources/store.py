"""Keyed tables on plain Parquet: upsert with last write wins, merging of shards, vectors with a checked size."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.functions import num
from marlstone.operators import panel


class KeyedTable:
    """A table in buckets of its keys' hash. A write makes new folders for the buckets that it touches, and then a new version.

    A version is a small file that names the folder of each bucket, so readers see all of a write or nothing, and a write
    costs what its buckets hold, not the table. The file is renamed into place: of two writers that start from one version
    the second gets an error and can repeat, where renaming doesn't replace files (HDFS); elsewhere let one write at a time.

    buckets: chosen for the size that the table will have, some 100 MB a bucket; an existing table keeps its number. sort:
    columns that rows are ordered by in their files, so that a filter on them skips what it doesn't want.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: StructType | str, buckets: int = 32, sort: Sequence[str] = ()):
        self.sort = list(sort)
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str, start: str) -> list[str]:
        where = self._path(folder)
        names = [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(n for n in names if n.startswith(start))

    def _folders(self, version: str) -> dict[int, str]:
        """Folder of each bucket in a version, and the number of buckets."""
        found = json.loads(self.spark.read.text(f"{self.path}/{version}", wholetext=True).first()[0])
        self.buckets = found["buckets"]
        return {int(k): v for k, v in found["folders"].items()}

    def _current(self) -> tuple[int, dict[int, str]]:
        found = self._listed(self.path, "v-")
        return (int(found[-1].split("-")[1]), self._folders(found[-1])) if found else (-1, {})

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def _typed(self, df: DataFrame, *more: str) -> DataFrame:
        """The table's columns in its types, on which the hash depends."""
        return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema), *(c for c in more if c not in self.schema.fieldNames()))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self._bucket()).distinct().collect()}

    def _write(self, df: DataFrame, base: int, kept: dict[int, str]) -> None:
        """The version after base: buckets of df, which get new folders, and those kept. Folders that only older versions name go."""
        folder = f"data-{uuid.uuid4().hex}"
        dealt = df.withColumn("__bucket", self._bucket()).hint("rebalance", "__bucket")
        dealt = dealt.sortWithinPartitions("__bucket", *self.sort) if self.sort else dealt
        dealt.write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        named = kept | {int(n.split("=")[1]): f"{folder}/{n}" for n in self._listed(f"{self.path}/{folder}", "__bucket=")}
        made, wanted = self._path(f"{self.path}/.{folder}"), self._path(f"{self.path}/v-{base + 1:012d}")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "folders": named}).encode()))
        out.close()
        if self._fs.exists(wanted) or not self._fs.rename(made, wanted):
            self._fs.delete(made, False)
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            raise RuntimeError(f"another writer has changed {self.path}; repeat this write")
        *old, before, last = ["", *self._listed(self.path, "v-")]
        used = {f for v in (before, last) if v for f in self._folders(v).values()}
        for version in filter(None, old):
            for gone in set(self._folders(version).values()) - used:
                self._fs.delete(self._path(f"{self.path}/{gone}"), True)
            self._fs.delete(self._path(f"{self.path}/{version}"), False)

    def read(self) -> DataFrame:
        return self._rows(list(self._current()[1].values()))

    def replace(self, df: DataFrame) -> None:
        """A new version of just these rows."""
        self._write(self._typed(df), self._current()[0], {})

    def upsert(self, rows: DataFrame, order: str, kept: Sequence[str] = ("created_at",)) -> None:
        """New rows by key: the last of several in ``order`` wins over what is stored, but for the columns that keep their first value."""
        base, folders = self._current()
        typed = self._typed(rows, order)
        touched = self._touched(typed)
        new = panel.keep_last(typed, self.keys, order).select(*self.schema.fieldNames())
        old = self._rows([f for k, f in folders.items() if k in touched])
        some = [c for c in kept if c in self.schema.fieldNames()]
        if some:
            first = old.select(*self.keys, *(F.col(c).alias(f"__{c}") for c in some))
            new = new.join(first, self.keys, "left").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in some}).select(*self.schema.fieldNames())
        self._write(old.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new), base, {k: f for k, f in folders.items() if k not in touched})

    def delete(self, condition: str) -> None:
        base, folders = self._current()
        touched = self._touched(self._rows(list(folders.values())).where(condition))
        left = self._rows([f for k, f in folders.items() if k in touched]).where(f"not coalesce({condition}, false)")
        self._write(left, base, {k: f for k, f in folders.items() if k not in touched})

    def pending(self, wanted: DataFrame, condition: str | None = None) -> DataFrame:
        """Wanted keys that the table hasn't, such as chunks without an embedding of a model."""
        have = self.read().where(condition) if condition else self.read()
        common = [k for k in self.keys if k in wanted.columns]
        return wanted.join(have.select(*common).distinct(), common, "left_anti")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder for what a job writes and reads again, below spark.checkpoint.dir; a local session that has none gets a temporary one. It is removed when the application ends."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="marlstone-")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{what}-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def merged(shards: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of all shards; of equal keys the last shard's."""
    rows = shards[0].withColumn("__shard", F.lit(0))
    for i, s in enumerate(shards[1:], 1):
        rows = rows.unionByName(s.withColumn("__shard", F.lit(i)))
    return panel.keep_last(rows, keys, "__shard").drop("__shard")


def checked_vectors(df: DataFrame, vec_col: str = "embedding", size: int | None = None) -> int:
    """The vectors' common size; another size than wanted, or two sizes, is an error."""
    found = [r[0] for r in df.select(F.size(vec_col)).distinct().limit(3).collect()]
    if len(found) > 1 or size is not None and found and found[0] != size:
        raise ValueError(f"vectors of sizes {sorted(found)}, wanted {size}")
    return found[0] if found else size or 0


def points(df: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Rows with a stable point id; blank ids go."""
    return df.where(F.trim(id_col) != "").withColumn("point_id", num.uuid5_url(id_col))


def push(df: DataFrame, send: Callable[[list[dict]], None], batch: int = 500) -> None:
    """Rows to an injected client, in batches inside tasks; nothing is sent for no rows."""

    def run(rows: Iterator) -> None:
        held: list[dict] = []
        for row in rows:
            held.append(row.asDict(recursive=True))
            if len(held) >= batch:
                send(held)
                held = []
        if held:
            send(held)

    df.foreachPartition(run)


def one_csv(df: DataFrame, path: str) -> None:
    """A small table as one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: DataFrame, columns: Sequence[str], most: int = 200) -> str:
    """A report table of a few rows."""
    cells = rows.select(*(F.coalesce(F.when(F.lit(t in ("double", "float")), F.format_number(F.col(c).cast("double"), 2)).otherwise(F.col(c).cast("string")), F.lit("")) for c, t in rows.select(*columns).dtypes)).limit(most).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in cells])
