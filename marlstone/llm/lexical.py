"""Ranked lexical search over document shards of postings with precomputed impacts.

A term is a run of digits, letters and characters beyond ASCII, with A-Z folded,
known by its 64-bit hash.  Documents are dealt to shards where they are read: a
shard has about ``HELD`` terms, and keeps its postings in compressed sparse rows,
that is the hashes of its terms in order, the number of its documents that hold
each, and for these the document's place and an impact.  The impact is the
integer that the document's length and the term's occurrences give; it is
worked out once, when the index is built, from the corpus's totals.  A term's
weight depends on the corpus's document frequencies, which are sums of the
shards' own; they are looked up for the terms that are asked for.

Queries are taken in blocks of at most ``BLOCK_TERMS`` terms, broadcast one after
another.  A task adds up the weighted impacts of one query term after the other
in a dense array over a shard's documents, partitions off the k best with all
that tie with the last of them, and keeps k for each query over all its shards.
The tasks' lists are merged as a tree.

Defined cases: a null or empty text, or one without terms, has no postings and is
never found; a query without terms has no rows; repeated rows are documents each;
a null document id comes behind all others of its score; of several rows of one
query id the least text is the query; only scores above 0 count; an empty table
gives no rows; other columns play no part; a very long text is a shard of its
own, whose arrays take a small multiple of its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import written
from marlstone.llm.spans import TERM, in_pieces
from marlstone.llm.topk import Best, merged

#: Terms of a shard.
HELD = 2_000_000
#: Distinct terms of the queries of a block, summed over its queries.
BLOCK_TERMS = 1_000_000
#: Share of a document's length in what its terms weigh, in hundredths.
LENGTH_SHARE = 75
_LAST = np.iinfo(np.int64).max
_SHARD = "n_docs long, n_terms long, ids array<long>, terms binary, counts binary, docs binary, impacts binary"


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents that hold a term, and all their terms."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        for _, piece in in_pieces(batches, "text", inside=TERM):
            n = np.diff(piece.word_bounds)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["n", "l"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return found[0] or 0, found[1] or 0


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of a term in a document, without the term's weight: at most a million."""
    m = 100 - LENGTH_SHARE + LENGTH_SHARE * length * n_docs // max(1, n_terms)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """One row a shard, written to the shared folder; n_docs and n_terms are the corpus's."""
    n_docs, n_terms = totals(docs, text_col)
    names = [c.split()[0] for c in _SHARD.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]

    def shard(hashes: list[np.ndarray], lengths: list[np.ndarray], ids: list) -> pa.RecordBatch:
        length = np.concatenate(lengths)
        term, doc = np.concatenate(hashes), np.repeat(np.arange(len(length), dtype=np.uint32), length)
        order = np.argsort(term, kind="stable")
        term, doc = term[order], doc[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        tf, term, doc = np.diff(np.append(first, len(new))), term[first], doc[first]
        start = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        counts = np.diff(np.append(start, len(term)))
        values = [n_docs, n_terms, ids, term[start].astype("<u8").tobytes(), counts.astype("<u4").tobytes(), doc.astype("<u4").tobytes(), impact(tf, length[doc], n_docs, n_terms).astype("<u4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        ids: list = []
        many = 0
        for rows, piece in in_pieces(batches, "text", fold=True, inside=TERM):
            n = np.diff(piece.word_bounds)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            hashes.append(piece.hash(*piece.words))
            lengths.append(n[some])
            ids += rows.column("id").take(pa.array(some)).to_pylist()
            many += len(hashes[-1])
            if many >= held:
                yield shard(hashes, lengths, ids)
                hashes, lengths, ids, many = [], [], [], 0
        if ids:
            yield shard(hashes, lengths, ids)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(texts.mapInArrow(run, _SHARD), "lexical-index")


class Shard:
    """Postings of one shard: those of term number t are places starts[t] to starts[t + 1]."""

    def __init__(self, row: dict):
        self.ids = np.array([_LAST if i is None else i for i in row["ids"]], np.int64)
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], "<u4"), dtype=np.int64)])
        self.docs, self.impacts = np.frombuffer(row["docs"], "<u4"), np.frombuffer(row["impacts"], "<u4")

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of every document, one term after the other."""
        out = np.zeros(len(self.ids), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        for t, w in zip(at[known].tolist(), weights[known].tolist(), strict=True):
            span = slice(self.starts[t], self.starts[t + 1])
            out[self.docs[span]] += w * self.impacts[span].astype(np.int64)
        return out


def highest(scores: np.ndarray, k: int, floor: int) -> np.ndarray:
    """Places of the k highest scores above 0 and not below floor, with all that tie with the last of them."""
    if len(scores) > k:
        floor = max(floor, int(scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]))
    return np.flatnonzero(scores >= max(1, floor))


def terms_of(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, terms, counts): the hashes of a query's distinct terms and how often it has each; written."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows, piece in in_pieces(batches, "text", fold=True, inside=TERM):
            hashes, bounds = piece.hash(*piece.words), piece.word_bounds
            found = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            lists = [pa.array([f[k].astype(np.uint64).view(np.int64) for f in found], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([rows.column("id"), *lists], ["id", "terms", "counts"])

    one = queries.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).groupBy("id").agg(F.min("text").alias("text"))
    return written(one.mapInArrow(run, "id long, terms array<long>, counts array<long>").where("size(terms) > 0"), "query-terms")


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def frequencies(shards: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How many documents hold each of the given terms, which are those of one block. Reads the shards' terms only."""
    shared = shards.sparkSession.sparkContext.broadcast(terms)

    def run(batches) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(shared.value), np.int64)
        for row in _rows(batches):
            mine, counts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["counts"], "<u4")
            at = np.minimum(np.searchsorted(mine, shared.value), len(mine) - 1)
            found += np.where(mine[at] == shared.value, counts[at], 0)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(shared.value[some].view(np.int64)), pa.array(found[some])], ["term", "n"])

    done = shards.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    return dict(zip(done.column("term").to_numpy().view(np.uint64).tolist(), done.column("n").to_pylist(), strict=True))


def _partials(shards: DataFrame, block: pa.Table, n_docs: int, k: int) -> DataFrame:
    """(item_id, part, id, score): each task's k best documents for each query of the block."""
    terms = [np.array(t, np.int64).view(np.uint64) for t in block.column("terms").to_pylist()]
    distinct = np.unique(np.concatenate([*terms, np.zeros(0, np.uint64)]))
    df = frequencies(shards, distinct)
    weights = [np.array([weight(n_docs, df[x]) * c if x in df else 0 for x, c in zip(t.tolist(), counts, strict=True)], np.int64) for t, counts in zip(terms, block.column("counts").to_pylist(), strict=True)]
    asked = [(t[w > 0], w[w > 0]) for t, w in zip(terms, weights, strict=True)]
    shared = shards.sparkSession.sparkContext.broadcast((block.column("id"), asked))

    def run(batches) -> Iterator[pa.RecordBatch]:
        items, queries = shared.value
        best, part = Best(len(queries), k), 0
        for row in _rows(batches):
            part, shard = row["part"], Shard(row)
            rows, scores, ids = [], [], []
            for q, (terms, weights) in enumerate(queries):
                found = shard.scores(terms, weights)
                at = highest(found, k, int(best.scores[q, k - 1]))
                rows.append(np.full(len(at), q))
                scores.append(found[at])
                ids.append(shard.ids[at])
            if sum(map(len, rows)):
                best.add(np.concatenate(rows), np.concatenate(scores), np.concatenate(ids))
        rows, ids, scores = best.rows()
        yield pa.RecordBatch.from_arrays([items.take(pa.array(rows)).combine_chunks() if len(items) else pa.array([], pa.int64()), pa.array(np.full(len(rows), part, np.int32)), pa.array(ids, mask=ids == _LAST), pa.array(scores)], ["item_id", "part", "id", "score"])

    done = written(shards.withColumn("part", F.spark_partition_id()).mapInArrow(run, "item_id long, part int, id long, score long"), "found")
    shared.destroy()
    return done


def search(shards: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", query_id: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(query id, rank, document id, score): the k documents of highest score above 0 for each query, from shards as ``index`` makes them.

    Blocks of queries pass through the driver one after another, each of bounded size.
    """
    asked = terms_of(queries, query_id, text_col)
    many = asked.agg(F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0))).first()[0]
    n_docs = shards.agg(F.coalesce(F.max("n_docs"), F.lit(0))).first()[0]
    blocks, out = max(1, -(-many // block_terms)), None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        found = _partials(shards, block, n_docs, k)
        out = found if out is None else out.unionByName(found)
    parts = 1 + (out.agg(F.max("part")).first()[0] or 0)
    return merged(out, parts, "item_id", k).select(F.col("item_id").alias(query_id), "rank", F.col("id").alias(id_col), "score")
