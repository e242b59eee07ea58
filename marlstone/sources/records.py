"""Records of a paged service as a data source, and rows sent to one: filters become parameters, pages follow their keys, requests are repeated inside tasks, rows are sent once by key.

The transport is injected: an object with methods of plain Python values, which does the requests. Nothing here opens a connection.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

#: Sets of parameters that filters may make; a filter that would make more is left to Spark.
MOST_SETS = 10_000


class Transient(Exception):
    """A failure that a later try may not have, such as a timeout or a full queue."""


class Transport(Protocol):
    """borders: values of the key, ascending, that cut the records into ranges (none: one range). page: records in ascending order of the
    key, above ``after`` (None: from the start) and up to ``upto`` (None: to the end), at most ``limit``; fewer only at the end."""

    key: str

    def borders(self, params: dict[str, Any]) -> Sequence[Any]: ...
    def page(self, params: dict[str, Any], after: Any, upto: Any, limit: int) -> Sequence[dict[str, Any]]: ...


def repeated(call: Callable[[], Any], tries: int, wait: float) -> Any:
    """The call's result; after a transient failure again, with twice the wait each time. The last failure is raised."""
    for n in range(tries):
        try:
            return call()
        except Transient:
            if n + 1 == tries:
                raise
            time.sleep(wait * 2**n)
    raise ValueError("there must be at least one try")


@dataclass
class KeyRange(InputPartition):
    """Records above ``after`` and up to ``upto``, of one set of parameters."""

    params: dict[str, Any]
    after: Any = None
    upto: Any = None


@dataclass
class Pushed:
    """What filters ask of the service: alternatives by column, and the two ends of a column."""

    among: dict[str, list] = field(default_factory=dict)
    least: dict[str, Any] = field(default_factory=dict)
    most: dict[str, Any] = field(default_factory=dict)

    def take(self, one: Filter, filterable: Sequence[str], ranged: Sequence[str]) -> bool:
        """Whether the service applies this filter in full."""
        column = getattr(one, "attribute", ())
        if len(column) != 1:
            return False
        name = column[0]
        if isinstance(one, (EqualTo, EqualNullSafe, In)) and name in filterable:
            values = list(one.value) if isinstance(one, In) else [one.value]
            before = self.among.get(name)
            left = list(dict.fromkeys(v for v in values if before is None or v in before))
            others = math.prod(len(v) for c, v in self.among.items() if c != name)
            if any(v is None for v in values) or others * len(left) > MOST_SETS:
                return False
            self.among[name] = left
            return True
        if isinstance(one, GreaterThanOrEqual) and name in ranged:
            self.least[name] = max(self.least.get(name, one.value), one.value)
            return True
        if isinstance(one, LessThanOrEqual) and name in ranged:
            self.most[name] = min(self.most.get(name, one.value), one.value)
            return True
        return False

    def requests(self) -> Iterator[dict[str, Any]]:
        """Parameters of each combination of alternatives: no record meets two of them. None if a column has no alternative left."""
        fixed = {f"{c}_from": v for c, v in self.least.items()} | {f"{c}_to": v for c, v in self.most.items()}
        sets: list[dict[str, Any]] = [fixed]
        for name, values in self.among.items():
            sets = [s | {name: v} for s in sets for v in values]
        yield from sets


class RecordReader(DataSourceReader):
    def __init__(self, schema: StructType, options, transport: Transport, filterable: Sequence[str], ranged: Sequence[str]):
        self.fields, self.transport, self.filterable, self.ranged = schema.fieldNames(), transport, filterable, ranged
        self.limit, self.tries, self.wait = int(options.get("pageSize", 500)), int(options.get("tries", 4)), float(options.get("waitSeconds", 0.5))
        if self.limit < 1 or self.tries < 1:
            raise ValueError(f"pageSize {self.limit} and tries {self.tries} must be 1 or more")
        self.pushed = Pushed()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Those that Spark must apply itself."""
        return [f for f in filters if not self.pushed.take(f, self.filterable, self.ranged)]

    def partitions(self) -> list[KeyRange]:
        out: list[KeyRange] = []
        for params in self.pushed.requests():
            ends = [None, *repeated(lambda p=params: self.transport.borders(p), self.tries, self.wait), None]
            out += [KeyRange(params, low, high) for low, high in zip(ends, ends[1:], strict=False)]
        return out

    def read(self, partition: KeyRange | None) -> Iterator[tuple]:
        """Page after page, each from the last key of the one before. What a failed task had read is dropped with it."""
        if partition is None:
            return
        after = partition.after
        while True:
            found = repeated(lambda a=after: self.transport.page(partition.params, a, partition.upto, self.limit), self.tries, self.wait)
            for record in found:
                here = record[self.transport.key]
                if after is not None and here <= after or partition.upto is not None and here > partition.upto:
                    raise ValueError(f"key {here!r} isn't above {after!r} and up to {partition.upto!r}")
                after = here
                yield tuple(record.get(c) for c in self.fields)
            if len(found) < self.limit:
                return


def register(spark: SparkSession, name: str, transport: Transport, schema: str, filterable: Sequence[str] = (), ranged: Sequence[str] = ()) -> None:
    """Makes ``spark.read.format(name)`` read the transport's records.

    Keys are unique. Fields that a record lacks are NULL. filterable: columns for which the service takes one value as a parameter of
    that name; ranged: those for which it takes ``<name>_from`` and ``<name>_to``, both included. Other filters Spark applies.
    Options: pageSize, tries, waitSeconds. Filters reach the service where the session has ``PUSHDOWN`` on, which this sets.
    """
    label, fields = name, schema

    class Records(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return fields

        def reader(self, schema: StructType) -> DataSourceReader:
            return RecordReader(schema, self.options, transport, filterable, ranged)

    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Records)


@dataclass
class Sent(WriterCommitMessage):
    """What one task did."""

    rows: int
    batches: int
    skipped: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class PushWriter(DataSourceWriter):
    """Batches of rows in the order they come, each with a key made of its place and rows; a batch whose key is in the ledger has been sent."""

    def __init__(self, options, send: Callable[[str, list[dict]], None]):
        self.send, self.ledger = send, options["ledger"].rstrip("/")
        self.most, self.tries, self.wait = int(options.get("batchRows", 500)), int(options.get("tries", 4)), float(options.get("waitSeconds", 0.5))
        if self.most < 1 or self.tries < 1:
            raise ValueError(f"batchRows {self.most} and tries {self.tries} must be 1 or more")

    def write(self, iterator: Iterator[Row]) -> Sent:
        store, base = _store(self.ledger)
        store.create_dir(f"{base}/sent", recursive=True)
        done = Sent(0, 0, 0)

        part, at = TaskContext.get().partitionId(), 0

        def flush(held: list[dict]) -> None:
            nonlocal at
            rows = "\n".join(json.dumps(r, sort_keys=True, default=str) for r in held)
            key = hashlib.sha256(f"{part} {at}\n{rows}".encode()).hexdigest()
            at += 1
            mark = f"{base}/sent/{key}"
            if store.get_file_info(mark).type == fs.FileType.File:
                done.skipped += len(held)
                return
            repeated(lambda: self.send(key, held), self.tries, self.wait)
            with store.open_output_stream(mark) as out:
                out.write(str(len(held)).encode())
            done.rows += len(held)
            done.batches += 1

        held: list[dict] = []
        for row in iterator:
            held.append(row.asDict(recursive=True))
            if len(held) == self.most:
                flush(held)
                held = []
        if held:
            flush(held)
        return done

    def commit(self, messages: list[Sent | None]) -> None:
        """A summary beside the marks, after all tasks."""
        store, base = _store(self.ledger)
        store.create_dir(base, recursive=True)
        total = {k: sum(getattr(m, k) for m in messages if m) for k in ("rows", "batches", "skipped")}
        with store.open_output_stream(f"{base}/committed-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(total).encode())

    def abort(self, messages: list[Sent | None]) -> None:
        """Marks stay, so that the same push, started again, goes on where this one ended."""


def push(df: DataFrame, send: Callable[[str, list[dict]], None], ledger: str, batch: int = 500, parts: int | None = None, tries: int = 4, wait: float = 0.5) -> None:
    """Sends the rows in batches; a task or a whole push that starts again sends no batch twice that the ledger holds.

    send: called inside tasks with the batch's key and its rows. If a task dies between sending and marking, the batch comes again
    under the same key, by which the receiver tells it; so each row counts once. Batches are the same at every start, since rows
    are dealt and sorted by all their columns, so that no frequent key meets in one task; ``parts`` must stay the same for that
    (without it, the session's shuffle partitions). Repeated rows are sent as often as they are there. No rows, no call.
    ledger: a folder of this push that driver and executors share.
    """
    spark, name = df.sparkSession, f"push-{uuid.uuid4().hex}"
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    class Push(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return PushWriter(self.options, send)

    spark.dataSource.register(Push)
    dealt = df.repartition(n, *df.columns).sortWithinPartitions(*df.columns)
    dealt.write.format(name).mode("append").option("ledger", ledger).option("batchRows", batch).option("tries", tries).option("waitSeconds", wait).save()
