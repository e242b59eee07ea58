"""Token ids in directly addressable codes: any token of a stored file by a few array reads.

An id is cut into bytes, least first.  Level 0 holds every id's first byte;
a bitmap tells which ids go on, and level 1 holds the next byte of just these,
and so on.  The place of an id in the next level is the rank of its bit, which
a directory of counts every 512 bits gives without decoding what lies before.

A file is one row of a table in the shared folder (a Parquet binary column),
so that it is written and read by Spark on any store.  Files hold whole
documents in ascending id order and close at ``FILE_IDS`` ids.

Defined cases: a null or empty text has only its end id; repeated rows and
equal ids keep a row each, ordered by the text's start, then by its hash; a null
id comes first; an empty table makes no file; other columns play no part; a very
long text is cut between words to be encoded, and its ids are in one file, which
may so exceed ``FILE_IDS``.  The rows of one id, alike or not, are dealt to
several tasks where they are many.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import tokens
from marlstone.llm.shared import shards, written

FILE_IDS = 1 << 20
_BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)
_MAGIC = b"DAC1"
#: Characters of a text that order rows of one id before its hash does.
_START = 64


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """A file of the documents' ids in a row."""
    left, levels = ids.astype(np.uint32), []
    while True:
        more = left > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (_BLOCK // 8), np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(_ONES[bits].reshape(-1, _BLOCK // 8).sum(1))[:-1]]).astype("<u4") if len(bits) else np.zeros(0, "<u4")
        levels.append(((left & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        left = left[more] >> 8
        if not len(left):
            break
    known = np.array([d is not None for d in doc_ids])
    head = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(known).tobytes(), np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()]
    parts = [*head, *(p for level in levels for p in level)]
    return _MAGIC + struct.pack("<III", len(levels), len(doc_ids), len(parts)) + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


class DacFile:
    """A packed file, read in place."""

    def __init__(self, raw: bytes):
        if raw[:4] != _MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n_levels, n_docs, n_parts = struct.unpack_from("<III", raw, 4)
        sizes = struct.unpack_from(f"<{n_parts}Q", raw, 16)
        at = 16 + 8 * n_parts
        parts = []
        for size in sizes:
            parts.append(memoryview(raw)[at : at + size])
            at += size
        self.doc_ids, self.starts = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[2], "<u8").astype(np.int64)
        self.known = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=n_docs).astype(bool)
        self.levels = [(np.frombuffer(parts[3 + 3 * k], np.uint8), np.frombuffer(parts[4 + 3 * k], np.uint8), np.frombuffer(parts[5 + 3 * k], "<u4")) for k in range(n_levels)]

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, in any order; each costs a few reads a level."""
        place = np.asarray(places, np.int64)
        out, who = np.zeros(len(place), np.uint32), np.arange(len(place))
        for level, (chunk, bits, ranks) in enumerate(self.levels):
            out[who] |= chunk[place].astype(np.uint32) << np.uint32(8 * level)
            byte = bits[place >> 3]
            more = (byte >> (place & 7).astype(np.uint8)) & 1 == 1
            place, who = place[more], who[more]
            if not len(place):
                break
            block = place // _BLOCK
            inside = np.zeros(len(place), np.int64)
            first = block * (_BLOCK // 8)
            for k in range(_BLOCK // 8):
                use = first + k < place >> 3
                if not use.any():
                    break
                inside[use] += _ONES[bits[first[use] + k]]
            inside += _ONES[bits[place >> 3] & ((1 << (place & 7)) - 1).astype(np.uint8)]
            place = ranks[block].astype(np.int64) + inside
        return out

    def all(self) -> np.ndarray:
        """Every id; one pass over each level."""
        out = np.zeros(0, np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            mine = chunk.astype(np.uint32)
            more = np.unpackbits(bits, bitorder="little", count=len(chunk)).astype(bool)
            mine[more] |= out << np.uint32(8)
            out = mine
        return out


def files(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """(part, seq, before, n_ids, n_docs, file): the files of all texts, written to the shared folder.

    part, seq give their order, before the ids in the part's files before.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id"), F.substring("text", 1, _START), F.xxhash64("text"), F.col("row")]
    dealt = texts.repartitionByRange(shards(docs, text_col), *order).sortWithinPartitions(*order).select("id", "text", F.spark_partition_id().alias("part"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = tokens.library_encoder(path)
        part, seq, before, many = 0, 0, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, list[int | None]]] = []

        def close() -> pa.RecordBatch:
            ids, lengths = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            docs = [d for h in held for d in h[2]]
            row = [[part], [seq], [before], [len(ids)], [len(docs)], [pack(ids, docs, lengths)]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "before", "n_ids", "n_docs", "file"])

        for rows, ids, bounds in encoder.encoded(batches, "text", end_id):
            part, docs, at = rows.column(2)[0].as_py(), rows.column(0).to_pylist(), 0
            while at < len(docs):
                # up to the document that fills the file
                to = min(len(docs), int(np.searchsorted(bounds, bounds[at] + file_ids - many)))
                held.append((ids[bounds[at] : bounds[to]], np.diff(bounds[at : to + 1]), docs[at:to]))
                many += int(bounds[to] - bounds[at])
                at = to
                if many >= file_ids:
                    yield close()
                    held, many, seq, before = [], 0, seq + 1, before + many
        if held:
            yield close()

    return written(dealt.mapInArrow(run, "part int, seq int, before long, n_ids long, n_docs long, file binary"), "dac")


def with_starts(packed: DataFrame) -> DataFrame:
    """The files with ``first``, the ids in all files before. One number a partition goes through the driver."""
    spark = packed.sparkSession
    totals = sorted(map(tuple, packed.groupBy("part").agg(F.sum("n_ids")).collect()))
    before = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    firsts = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before[:-1], strict=True)], "part int, __part_first long")
    return packed.join(F.broadcast(firsts), "part").withColumn("first", F.col("__part_first") + F.col("before")).drop("__part_first")


def read(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document of the files."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = DacFile(raw)
                ids, starts = file.all().astype("<u4"), file.starts
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, mask=~file.known), pa.array(starts[:-1] + first), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return with_starts(packed).select("first", "file").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
