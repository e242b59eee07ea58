"""Exact top-k search by integer inner products: tiles of queries times candidates, merged as a tree.

Vectors become integers, floor(scale * x) of every component.  Queries are taken
in blocks of at most ``BLOCK_BYTES``, which are broadcast one after another; the
candidates stay where they are read, sorted by id within a partition.
A task multiplies a tile of the block by a tile of candidates, selects from the
product what can still be among a query's k best, and keeps k for each query.
The tasks' lists meet in groups of ``FAN``, and the lists of these in groups
again, until each query has one list.

Sums are exact.  With Cauchy and Schwarz, no partial sum exceeds the product of
two lengths: below 2**24 the tiles are multiplied in single precision, below
2**53 in double precision, and otherwise as Python integers, whose result is cut
to the range of 64 bits.

Defined cases: vectors that are null, or hold null or non-finite components,
take no part; vectors of different lengths are not compared; an id's rows are
all its own, so that none is a candidate of a query of that id; of several rows
of one id the least vector (as an array of numbers) is the query, while each row
is a candidate; a null id is a candidate behind all others of its score and
never a query; equal scores go by ascending id; fewer candidates than k are all
returned; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import written

SCALE = 1024
#: Bytes of the queries of a block, as 64-bit numbers.
BLOCK_BYTES = 32 << 20
#: Queries and candidates of a tile.
TILE_QUERIES, TILE = 512, 4096
#: Lists that meet in one group of the tree.
FAN = 32
_LAST = np.iinfo(np.int64).max
_LEAST = np.iinfo(np.int64).min


def whole(vectors: Column | str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as doubles; null for a vector that takes no part."""
    v = F.col(vectors) if isinstance(vectors, str) else vectors
    v = F.transform(v, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Spark's floor of a double is a long, which would cut what is beyond its range.
    ample = lambda x: F.least(F.greatest(x * scale, F.lit(-1e300)), F.lit(1e300))
    return F.when(F.coalesce(~bad, F.lit(False)), F.transform(v, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(ample(x))))


def merged(found: DataFrame, parts: int, query: str, k: int, fan: int = FAN) -> DataFrame:
    """The k best of each query, from lists of (query, part, id, score) with parts numbered from 0; null ids come last.

    A group holds at most ``fan`` lists of k rows, however many parts there are.
    """
    while True:
        order = (F.desc("score"), F.asc_nulls_last("id"))
        parts = -(-parts // fan)
        group = [query] if parts <= 1 else [query, "part"]
        found = found.withColumn("part", F.floor(F.col("part") / fan).cast("int"))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
        if parts <= 1:
            return found.drop("part")
        found = found.drop("rank")


class Best:
    """The k best candidates so far of each query of a block, by (score, less id)."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), _LEAST), np.full((n, k), _LAST)
        self.filled = np.zeros(n, np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (row of the query, score, id), sorted by nothing."""
        mine = np.unique(rows)
        held = np.repeat(mine, self.filled[mine])
        at = np.arange(len(held)) - np.repeat(np.cumsum(self.filled[mine]) - self.filled[mine], self.filled[mine])
        rows, scores, ids = np.concatenate([held, rows]), np.concatenate([self.scores[held, at], scores]), np.concatenate([self.ids[held, at], ids])
        order = np.lexsort((ids, ~scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        edges = np.searchsorted(rows, mine)
        place = np.arange(len(rows)) - edges[np.searchsorted(mine, rows)]
        kept = place < self.k
        self.scores[rows[kept], place[kept]], self.ids[rows[kept], place[kept]] = scores[kept], ids[kept]
        self.filled[mine] = np.minimum(np.diff(np.append(edges, len(rows))), self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, score) of all that is held."""
        rows = np.repeat(np.arange(len(self.filled)), self.filled)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(self.filled) - self.filled, self.filled)
        return rows, self.ids[rows, at], self.scores[rows, at]


def product(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all rows of integers held as doubles, exact, as numbers that compare as 64-bit integers do."""
    bound = np.sqrt((queries**2).sum(1).max(initial=0) * (candidates**2).sum(1).max(initial=0)) * (1 + 1e-9)
    if bound < 2**24:
        return queries.astype(np.float32) @ candidates.astype(np.float32).T
    if bound < 2**53:
        return queries @ candidates.T
    q, c = (np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape) for m in (queries, candidates))
    return np.clip(q @ c.T, int(_LEAST), int(_LAST)).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, best: Best, first: int) -> None:
    """Adds to best what a tile has; ids ascend over the tiles of a task, so that an equal score of a later one loses.

    own: the queries' ids. Where more than a few of a row's scores can still count, the k best of the row are partitioned
    off, ties by place.
    """
    n, k = len(own), best.k
    full = best.filled[first : first + n] == k
    # what doesn't fit the tile's type exactly is beyond all its scores
    floor = best.scores[first : first + n, k - 1].astype(scores.dtype)
    mask = scores > floor[:, None]
    mask[~full] = True
    mask[_same(ids, own)] = False
    many = mask.sum(1)
    for i in np.flatnonzero(many > 4 * k).tolist():
        at = np.flatnonzero(mask[i])
        row = scores[i, at]
        least = np.partition(row, len(row) - k)[len(row) - k]
        above = at[row > least]
        tied = at[row == least][: k - len(above)]
        mask[i] = False
        mask[i, above] = mask[i, tied] = True
    rows, at = np.nonzero(mask)
    if len(rows):
        best.add(rows + first, scores[rows, at].astype(np.int64), ids[at])


def _same(ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of queries and places of candidates, which ascend, that have one id."""
    left = np.searchsorted(ids, own, "left")
    many = np.searchsorted(ids, own, "right") - left
    rows = np.repeat(np.arange(len(own)), many)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(left, many)


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Components in a row, and bounds, of a list column."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]] if len(lists) else np.zeros(0), bounds - bounds[0]


def _by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each length of vectors."""
    flat, bounds = _matrix(lists)
    lengths = np.diff(bounds)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        yield n, rows, flat[(bounds[rows][:, None] + np.arange(n)).reshape(-1)].reshape(len(rows), n)


def _partials(candidates: DataFrame, block: pa.Table, k: int, name: str) -> DataFrame:
    """(query_id, part, id, score): each task's k best candidates of each query of the block."""
    ids = block.column("id").to_numpy()
    shared = candidates.sparkSession.sparkContext.broadcast({n: (ids[rows], matrix) for n, rows, matrix in _by_length(block.column("v"))})

    def run(batches) -> Iterator[pa.RecordBatch]:
        best = {n: Best(len(own), k) for n, (own, _) in shared.value.items()}
        part = 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            theirs = batch.column("id").fill_null(_LAST).to_numpy(zero_copy_only=False)
            for n, rows, matrix in _by_length(batch.column("v")):
                if n not in best:
                    continue
                own, queries = shared.value[n]
                for a in range(0, len(rows), TILE):
                    tile, tile_ids = matrix[a : a + TILE], theirs[rows[a : a + TILE]]
                    for q in range(0, len(own), TILE_QUERIES):
                        select(product(queries[q : q + TILE_QUERIES], tile), tile_ids, own[q : q + TILE_QUERIES], best[n], q)
        for n, b in best.items():
            rows, found, scores = b.rows()
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[n][0][rows]), pa.array(np.full(len(rows), part, np.int32)), pa.array(found, mask=found == _LAST), pa.array(scores)], ["query_id", "part", "id", "score"])

    ordered = candidates.sortWithinPartitions(F.asc_nulls_last("id")).withColumn("part", F.spark_partition_id())
    done = written(ordered.mapInArrow(run, "query_id long, part int, id long, score long"), name)
    shared.destroy()
    return done


def nearest(items: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the k rows of items with the highest inner products, for each id of queries.

    Blocks of queries pass through the driver one after another, each of bounded size; the candidates of every block are
    all items.
    """
    vectors = items.select(F.col(id_col).cast("long").alias("id"), whole(vec_col, scale).alias("v")).where("v is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), whole(vec_col, scale).alias("v")).where("v is not null and id is not null")
    asked = written(asked.groupBy("id").agg(F.min("v").alias("v")), "queries")
    components = asked.agg(F.coalesce(F.sum(F.size("v").cast("long") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-components * 8 // block_bytes))
    out = None
    for b in range(blocks):
        found = _partials(vectors, asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow(), k, "top")
        out = found if out is None else out.unionByName(found)
    parts = 1 + (out.agg(F.max("part")).first()[0] or 0)
    return merged(out, parts, "query_id", k).select("query_id", "rank", F.col("id").alias(id_col), "score")
