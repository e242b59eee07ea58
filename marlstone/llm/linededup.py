"""Lines that several documents share, dropped from all but the first, through a sharded index of line hashes.

A line's key is the line without white space at its ends, with A-Z folded.
Keys are hashed twice to 64 bits; the first hash deals them to shards.  Each
shard holds a minimal perfect hash of its distinct keys and, at a key's
number, a 32-bit fingerprint of the second hash, the number of documents with
the line, and the first of these documents.  Documents never meet in a join on
lines: they send their hashes to the shards in packed rows, and get back the
places of the lines to drop.  A shard that very many lines ask, because one of
them is everywhere, is copied, and each copy answers ``ASKED`` lines or so.

Keys whose first hashes collide are kept in a shard's small exact list.

Defined cases: a null or empty text is one empty line; keys shorter than
``LEAST_POINTS`` code points are never dropped; repeated rows with one id hold
their lines together; null ids come last and count as one document; a text
whose lines are all dropped is empty, its row stays; an empty table has an
empty index; a very long text is one piece, whose arrays take a small multiple
of its bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.mph import MinimalPerfectHash
from marlstone.llm.shared import shards, written
from marlstone.llm.spans import Piece, in_pieces

LEAST_POINTS = 10
#: Lines that one copy of a shard answers.
ASKED = 2_000_000
_LAST = np.iinfo(np.int64).max


def keys(piece: Piece, least: int = LEAST_POINTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with long enough keys: row, place in the document, and two hashes of the key."""
    starts, ends, bounds = piece.lines
    solid = np.flatnonzero(piece.solid)
    before = piece.solid_before
    some = before[ends] > before[starts]
    first, last = solid[before[starts[some]]], solid[before[ends[some]] - 1] + 1
    long = piece.points_before[last] - piece.points_before[first] >= least
    first, last, at = first[long], last[long], np.flatnonzero(some)[long]
    doc = piece.doc_of(bounds)[at]
    return doc, at - bounds[doc], piece.hash(first, last, 0), piece.hash(first, last, 1)


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))


def _first_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal rows together, and where each run of them starts."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, np.flatnonzero(new)


def index(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_POINTS) -> DataFrame:
    """(shard, n, asked, hash, fingerprints, counts, firsts, clashes), one row a shard, written to the shared folder; asked: its lines in all."""

    def lines(batches) -> Iterator[pa.RecordBatch]:
        for rows, piece in in_pieces(batches, "text", fold=True):
            doc, _, a, b = keys(piece, least)
            ids = rows.column("id").fill_null(_LAST).to_numpy(zero_copy_only=False)[doc]
            order, run = _first_of(a, b, ids)  # once for each document
            lines_of = np.diff(np.append(run, len(order)))
            a, b, ids = a[order][run], b[order][run], ids[order][run]
            order, run = _first_of(a % np.uint64(n_shards), a, b)
            counts = np.diff(np.append(run, len(order))).astype(np.int32)
            firsts = np.minimum.reduceat(ids[order], run) if len(run) else ids
            asked = np.add.reduceat(lines_of[order], run) if len(run) else lines_of
            a, b = a[order][run], b[order][run]
            shard = (a % np.uint64(n_shards)).astype(np.int32)
            cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]]), _lists(a.view(np.int64), cuts), _lists(b.view(np.int64), cuts), _lists(counts, cuts), _lists(firsts, cuts), pa.array(np.add.reduceat(asked, cuts[:-1]) if len(asked) else asked)], ["shard", "a", "b", "n", "first", "asked"])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        a, b, n, first = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("a", "b", "n", "first"))
        a, b = a.view(np.uint64), b.view(np.uint64)
        order, run = _first_of(a, b)
        n, first = np.add.reduceat(n[order].astype(np.int64), run), np.minimum.reduceat(first[order], run)
        a, b = a[order][run], b[order][run]
        clash = np.zeros(len(a), bool)
        clash[1:] = a[1:] == a[:-1]
        odd = [(x, y, m, f) for x, y, m, f in zip(a[clash].tolist(), b[clash].tolist(), n[clash].tolist(), first[clash].tolist(), strict=True)]
        a, b, n, first = a[~clash], b[~clash], n[~clash], first[~clash]
        hashed = MinimalPerfectHash.build(a)
        at = hashed.lookup(a)
        arrays = []
        for values, kind in (((b >> np.uint64(32)), "<u4"), (np.minimum(n, 2**32 - 1), "<u4"), (first, "<i8")):
            out = np.zeros(len(a), kind)
            out[at] = values
            arrays.append(out.tobytes())
        row = [key[0].as_py(), len(a), sum(table.column("asked").to_pylist()), hashed.to_bytes(), *arrays, b"".join(struct.pack("<QQQq", *o) for o in odd)]
        return pa.table([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5), strict=True)], names=["shard", "n", "asked", "hash", "fingerprints", "counts", "firsts", "clashes"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = texts.mapInArrow(lines, "shard int, a array<long>, b array<long>, n array<int>, first array<long>, asked long")
    return written(dealt.groupBy("shard").applyInArrow(build, "shard int, n long, asked long, hash binary, fingerprints binary, counts binary, firsts binary, clashes binary"), "line-index")


class Shard:
    """The arrays of one shard."""

    def __init__(self, row: dict):
        self.hash = MinimalPerfectHash.from_bytes(row["hash"])
        self.fingerprints, self.counts, self.firsts = np.frombuffer(row["fingerprints"], "<u4"), np.frombuffer(row["counts"], "<u4"), np.frombuffer(row["firsts"], "<i8")
        self.clashes = {(x, y): (m, f) for x, y, m, f in struct.iter_unpack("<QQQq", row["clashes"])}

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of documents with each key (0: not in the index) and the first of them."""
        at = self.hash.lookup(a)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == (b[known] >> np.uint64(32)).astype(np.uint32)
        n, first = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        n[known], first[known] = self.counts[at[known]], self.firsts[at[known]]
        if self.clashes:
            for i, pair in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                if pair in self.clashes:
                    n[i], first[i] = self.clashes[pair]
        return n, first


def dropped(docs: DataFrame, line_index: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_POINTS, asked: int = ASKED) -> DataFrame:
    """(__id, __text_hash, __dropped): places of the lines to drop, for documents that have any. One number for each much asked shard goes through the driver."""
    copies = {s: n for s, n in line_index.select("shard", (F.col("asked") / asked).cast("int") + 1).where(F.col("asked") >= asked).toLocalIterator()}

    def probes(batches) -> Iterator[pa.RecordBatch]:
        for number, (rows, piece) in enumerate(in_pieces(batches, "text", fold=True)):
            doc, place, a, b = keys(piece, least)
            order = np.argsort(a % np.uint64(n_shards), kind="stable")
            doc, place, a, b = doc[order], place[order], a[order], b[order]
            shard = (a % np.uint64(n_shards)).astype(np.int32)
            cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else np.zeros(1, np.int64)
            ids, known = rows.column("id").fill_null(_LAST).to_numpy(zero_copy_only=False)[doc], rows.column("key").to_numpy()[doc]
            turn = number + rows.column("part")[0].as_py() * 7919
            copy = pa.array([turn % copies.get(s, 1) for s in shard[cuts[:-1]].tolist()], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]]), copy, *(_lists(v, cuts) for v in (a.view(np.int64), b.view(np.int64), ids, known, place.astype(np.int32)))], ["shard", "copy", "a", "b", "id", "key", "place"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["__id", "__text_hash", "place"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int32())], names=names)
        shard = Shard(right.to_pylist()[0])
        a, b, ids, known, place = (left.column(c).combine_chunks().flatten().to_numpy() for c in ("a", "b", "id", "key", "place"))
        n, first = shard.probe(a.view(np.uint64), b.view(np.uint64))
        out = (n >= 2) & (first < ids)
        return pa.table([pa.array(v[out]) for v in (ids, known, place)], names=names)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    dealt = texts.mapInArrow(probes, "shard int, copy int, a array<long>, b array<long>, id array<long>, key array<long>, place array<int>")
    answering = line_index.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("asked") / asked).cast("int"))))
    found = dealt.groupBy("shard", "copy").cogroup(answering.groupBy("shard", "copy")).applyInArrow(answer, "__id long, __text_hash long, place int")
    return found.groupBy("__id", "__text_hash").agg(F.collect_set("place").alias("__dropped"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_POINTS, asked: int = ASKED) -> DataFrame:
    """The rows of docs, all columns kept, with the text that stays, and __n_lines, __n_dropped."""
    n_shards = shards(docs, text_col)
    found = dropped(docs, index(docs, n_shards, id_col, text_col, least), n_shards, id_col, text_col, least, asked)
    keyed = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LAST))), "__text_hash": F.xxhash64(text_col)})
    joined = keyed.join(found, ["__id", "__text_hash"], "left").drop("__id", "__text_hash")

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column("__text").to_pylist(), batch.column("__dropped").to_pylist(), strict=True):
                if drop:
                    gone, parts = set(drop), text.split("\n")
                    texts.append("\n".join([p for i, p in enumerate(parts) if i not in gone]))
                    n_lines.append(len(parts))
                    n_dropped.append(len(gone))
                else:
                    texts.append(text or "")
                    n_lines.append((text or "").count("\n") + 1)
                    n_dropped.append(0)
            rest = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*others, "__text", "__n_lines", "__n_dropped"])

    others = [c for c in docs.columns if c != text_col]
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    done = joined.withColumnRenamed(text_col, "__text").mapInArrow(cut, f"{kept}{', ' if kept else ''}__text string, __n_lines long, __n_dropped long")
    return done.withColumnRenamed("__text", text_col).select(*docs.columns, "__n_lines", "__n_dropped")
