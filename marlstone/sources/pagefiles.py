"""Files of pages (reports) as a data source for batches and streams: shares of about equal bytes, parsers in tiers, a row for what can't be read.

A parser is a function from an open binary file to a document: a sequence of page texts, read when asked for. Parsers are
given by name when the source is registered, and tried in the order of the option ``parsers``.
"""

from __future__ import annotations

import codecs
import fnmatch
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from marlstone.functions import text
from marlstone.operators import docs

SCHEMA = "file string, size long, page int, pages int, text string, parser string, error string"
Parser = Callable[[BinaryIO], Sequence[str]]
#: Bytes of a file of text that are looked through at once.
BLOCK_BYTES = 4 << 20


@dataclass
class Share(InputPartition):
    """Part ``part`` of ``parts`` of each of the files: pages n * part // parts and on of a file with n pages."""

    files: list[tuple[str, int]]
    part: int = 0
    parts: int = 1


def shares(files: Sequence[tuple[str, int]], most: int) -> list[Share]:
    """Small files together up to ``most`` bytes; a larger file alone, and cut by its pages into as many shares as its bytes make."""
    out: list[Share] = []
    held, weight = [], 0
    for name, size in files:
        if size > most:
            parts = -(-size // most)
            out += [Share([(name, size)], part, parts) for part in range(parts)]
            continue
        if held and weight + size > most:
            out.append(Share(held))
            held, weight = [], 0
        held.append((name, size))
        weight += size
    return out + [Share(held)] if held else out


def listed(path: str, pattern: str) -> list[tuple[int, str, int]]:
    """(time of the last change in ns, file, bytes) of all files below a folder whose name matches, oldest first. No folder, no files."""
    store, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


def _message(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def read_share(share: Share, path: str, parsers: Sequence[tuple[str, Parser]]) -> Iterator[tuple]:
    """Rows of a share's pages. What a parser can't open or read goes to the next one, page by page.

    The number of pages is that of the first parser that opens the file, so all shares of a file agree on it. A file that none
    opens is one row without a page (from its first share); a page that none reads is a row without a text.
    """
    store = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
    for name, size in share.files:
        tries = iter(parsers)
        opened: list[tuple[str, Sequence[str]]] = []
        failed: list[str] = []

        def next_tier(name=name, tries=tries, opened=opened, failed=failed) -> bool:
            for label, parse in tries:
                try:
                    document = parse(store.open_input_file(name))
                    len(document)
                except Exception as error:  # a parser may raise anything
                    failed.append(f"{label}: {_message(error)}")
                    continue
                opened.append((label, document))
                return True
            return False

        if not next_tier():
            if share.part == 0:
                yield name, size, None, None, None, None, "; ".join(failed)
            continue
        pages = len(opened[0][1])
        for n in range(pages * share.part // share.parts, pages * (share.part + 1) // share.parts):
            why: list[str] = []
            tier = 0
            while tier < len(opened) or next_tier():
                label, document = opened[tier]
                try:
                    found = str(document[n] or "")
                except Exception as error:
                    why.append(f"{label}: {_message(error)}")
                    tier += 1
                    continue
                yield name, size, n + 1, pages, found, label, None
                break
            else:
                yield name, size, n + 1, pages, None, None, "; ".join(why + failed)


class _Common:
    def __init__(self, options, parsers: dict[str, Parser]):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.most = int(options.get("partitionBytes", 128 << 20))
        wanted = [p.strip() for p in options.get("parsers", ",".join(parsers)).split(",") if p.strip()]
        unknown = [p for p in wanted if p not in parsers]
        if unknown or not wanted or self.most < 1:
            raise ValueError(f"parsers {unknown or 'none'} aren't among {sorted(parsers)}, or partitionBytes is below 1")
        self.parsers = [(p, parsers[p]) for p in wanted]

    def read(self, partition: Share) -> Iterator[tuple]:
        return read_share(partition, self.path, self.parsers)


class PageReader(_Common, DataSourceReader):
    def partitions(self) -> list[Share]:
        return shares([(name, size) for _, name, size in listed(self.path, self.pattern)], self.most) or [Share([])]


class PageStream(_Common, DataSourceStreamReader):
    """Files by time of change and name: an offset is the last one taken. A changed file comes again.

    A file is taken once it hasn't changed for ``settleSeconds`` (10), and must be in place by then: one that appears later
    with an older time is not seen.
    """

    def __init__(self, options, parsers: dict[str, Parser]):
        super().__init__(options, parsers)
        self.settle = float(options.get("settleSeconds", 10))
        self.last = {"time": -1, "file": ""}

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        done = [(when, name) for when, name, _ in listed(self.path, self.pattern) if when <= until]
        newest = max([(self.last["time"], self.last["file"]), *done[-1:]])
        self.last = {"time": newest[0], "file": newest[1]}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Share]:
        low, high = (start["time"], start["file"]), (end["time"], end["file"])
        return shares([(name, size) for when, name, size in listed(self.path, self.pattern) if low < (when, name) <= high], self.most) or [Share([])]

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession, parsers: dict[str, Parser], name: str = "pagefiles") -> None:
    """Makes ``spark.read.format(name)`` and ``spark.readStream.format(name)`` with these parsers.

    Options: path (a folder, read with all below it), pattern (of file names), parsers (names in the order to try), partitionBytes.
    """
    label = name

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return PageReader(self.options, parsers)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return PageStream(self.options, parsers)

    spark.dataSource.register(Pages)


class FormFeedPages(Sequence):
    """Pages of a text, read from the file when asked for: what is held is where each page ends."""

    def __init__(self, file: BinaryIO, block: int = BLOCK_BYTES):
        self.file = file
        decoder = codecs.getincrementaldecoder("utf-8")()
        ends, size = [np.zeros(0, np.int64)], 0
        while data := file.read(block):
            decoder.decode(data)
            ends.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0C) + size)
            size += len(data)
        decoder.decode(b"", final=True)
        self.ends = np.concatenate(ends)
        if size > (self.ends[-1] + 1 if len(self.ends) else 0):
            self.ends = np.append(self.ends, size)

    def __len__(self) -> int:
        return len(self.ends)

    def __getitem__(self, n: int) -> str:
        n = range(len(self))[n]
        start = int(self.ends[n - 1]) + 1 if n else 0
        self.file.seek(start)
        return self.file.read(int(self.ends[n]) - start).decode("utf-8")


def form_feed_pages(file: BinaryIO) -> Sequence[str]:
    """Text with a form feed after each page, as text extractors write it. Other bytes than UTF-8 are an error."""
    return FormFeedPages(file)


def reread(pages: DataFrame, file_col: str = "file", text_col: str = "text", share: float = 0.3, force: bool = False) -> DataFrame:
    """The pages with ``reread``: whether a page should be read by its picture.

    That is so for blank pages and garbled ones, and for all of a file in which at least ``share`` of the pages that aren't
    blank are garbled; with ``force`` for every page. Null texts are blank. The share comes from one aggregation by file.
    """
    blank = text.strip(F.coalesce(text_col, F.lit(""))) == ""
    judged = pages.withColumns({"__blank": blank, "__bad": ~blank & F.coalesce(text.is_garbled(text_col), F.lit(False))})
    by_file = judged.groupBy(F.col(file_col).alias("__file")).agg(F.count_if(~F.col("__blank")).alias("__full"), F.count_if("__bad").alias("__n_bad"))
    whole = F.coalesce((F.col("__full") > 0) & (F.col("__n_bad") >= F.lit(share) * F.col("__full")), F.lit(False))
    out = judged.join(by_file, judged[file_col].eqNullSafe(by_file["__file"]), "left")
    return out.withColumn("reread", F.lit(force) | F.col("__blank") | F.col("__bad") | whole).select(*pages.columns, "reread")


def repaired(pages: DataFrame, text_col: str = "text", second: str = "ocr", force: bool = False) -> DataFrame:
    """Texts with the second reading where it was asked for (``reread``) and is better; ``by_picture`` says where."""
    takes = F.col("reread") & (F.coalesce(text.strip(F.coalesce(second, F.lit(""))) != "", F.lit(False)) if force else docs.prefer_ocr(F.col(text_col), F.col(second)))
    made = F.coalesce(takes, F.lit(False))
    return pages.withColumns({text_col: F.when(made, F.col(second)).otherwise(F.col(text_col)), "by_picture": made})


def reading_order(boxes: DataFrame, page: Sequence[str], top: Column, left: Column, line: str = "text", places: int = 4) -> DataFrame:
    """(page, text, n_lines): a page's lines from above, joined by line ends, without blank ones at both ends.

    top: distance from the upper edge; lines whose rounded top agrees are one band, read from the left. Blank lines go. Ties of place
    are broken by the text. One page's lines are one array: a page holds as many lines as fit on it.
    """
    kept = boxes.where(text.strip(line) != "").select(*page, F.struct(F.round(top, places).alias("y"), left.alias("x"), text.strip(line).alias("t")).alias("l"))
    lines = kept.groupBy(*page).agg(F.array_sort(F.collect_list("l")).alias("l"))
    return lines.select(*page, F.array_join(F.col("l.t"), "\n").alias("text"), F.size("l").alias("n_lines"))
