"""A vector index in cells: points are kept by cell with short codes, and a search reads and scores a few cells.

Fitting takes a sample of at most ``SAMPLE_ROWS`` points, chosen by a hash of their
ids: cell centres by k-means, and for each part of the vector a book of 256 codes
for what is left after the centre.  Every point is then indexed.  A search looks
for each query in the cells whose centres are nearest, ranks these cells' points by
their codes, and scores the best of them by their full vectors.  With all cells and
all points rescored a search is exact, in the same way: a matrix product of queries
and points leaves out pairs that can't be among the best, by more than rounding.
A task holds k answers a query and scores ``TILE`` pairs at a time, however many
queries and points meet in it.

The index is a keyed table, so that points are added, replaced and deleted by id.
Points of one cell stand together in its files, which are read by cell.  Vectors of
the metric "cosine" are brought to length 1, and scores are inner products of
these; scores of "euclid" are negative distances.

Defined cases: null vectors, those that hold null or no finite number, and, for the
cosine, those of length 0 are left out; another size than the index has is an error;
of repeated ids one row stays; equal scores go by ascending id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.sources.store import KeyedTable, checked_vectors

SAMPLE_ROWS = 50_000
#: Cells: as many as the root of the number of points, but no more.
MOST_CELLS = 4096
CODES = 256
#: Numbers of a vector that one code stands for.
PART = 4
#: Queries that the number of probes is measured on.
TUNED_ROWS = 200
#: Pairs of a query and a point, or of a row and a centre, that are compared at once.
TILE = 1 << 20
#: Bytes of the queries, and of the lists of those that look into each cell, that are broadcast at once.
BLOCK_BYTES = 32 << 20
_SCHEMA = "id long, cell int, codes binary, embedding array<float>, changed long"


def _sound(vec: Column, cosine: bool) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vec, lambda x: x != 0) if cosine else F.size(vec) > 0
    return F.coalesce(~bad & some, F.lit(False))


def _matrix(column: pa.Array, cosine: bool) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True) if cosine and rows.size else rows


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the centre nearest to each row."""
    sizes, step = (centres**2).sum(1), max(1, TILE // len(centres))
    return np.concatenate([np.argmin(sizes - 2 * rows[a : a + step] @ centres.T, axis=1) for a in range(0, max(1, len(rows)), step)])


def k_means(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of at most k groups of a sample; a group that loses all its rows keeps its centre."""
    distinct = np.unique(rows, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        of = _nearest(rows, centres)
        many = np.bincount(of, minlength=len(centres))
        sums = np.stack([np.bincount(of, column, minlength=len(centres)) for column in rows.T], axis=1)
        centres[many > 0] = (sums[many > 0] / many[many > 0, None]).astype(np.float32)
    return centres


class Model:
    """Cell centres, and the code books of the parts of what is left."""

    def __init__(self, metric: str, centres: np.ndarray, books: list[np.ndarray]):
        self.metric, self.centres, self.books = metric, centres, books

    @classmethod
    def fit(cls, sample: np.ndarray, metric: str, cells: int) -> Model:
        centres = k_means(sample, cells)
        rest = sample - centres[_nearest(sample, centres)]
        return cls(metric, centres, [k_means(rest[:, a : a + PART], CODES, seed=a) for a in range(0, sample.shape[1], PART)])

    def coded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row, and its codes, a byte a part."""
        cell = _nearest(rows, self.centres)
        rest = rows - self.centres[cell]
        return cell, np.stack([_nearest(rest[:, i * PART : (i + 1) * PART], book) for i, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def to_json(self) -> str:
        return json.dumps({"metric": self.metric, "centres": self.centres.tolist(), "books": [b.tolist() for b in self.books]})

    @classmethod
    def from_json(cls, text: str) -> Model:
        found = json.loads(text)
        return cls(found["metric"], np.array(found["centres"], np.float32), [np.array(b, np.float32) for b in found["books"]])


class VectorIndex:
    """A stored index: ``build`` makes one, ``VectorIndex(spark, path)`` opens it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.model = Model.from_json(spark.read.text(f"{path}/model", wholetext=True).first()[0])
        self.table = KeyedTable(spark, f"{path}/points", ["id"], _SCHEMA)
        self.size = self.model.centres.shape[1]

    @classmethod
    def build(cls, points: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "cosine", cells: int | None = None, buckets: int = 32, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
        spark = points.sparkSession
        rows = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("embedding")).where(F.col("id").isNotNull() & _sound(F.col("embedding"), metric == "cosine"))
        if not checked_vectors(rows):
            raise ValueError("an index needs points to fit its cells")
        cells = cells or min(MOST_CELLS, max(1, round(rows.count() ** 0.5)))
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("embedding").toArrow()
        model = Model.fit(_matrix(sample.column(0), metric == "cosine").astype(np.float32), metric, cells)
        spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
        KeyedTable(spark, f"{path}/points", ["id"], _SCHEMA, buckets, sort=["cell"]).replace(_keyed(model, rows.dropDuplicates(["id"]), 0))
        return cls(spark, path)

    def upsert(self, points: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", change: int = 1) -> None:
        """New and changed points by id, into the cells that are there; ``change`` numbers the writes, of equal ids the later one stays."""
        rows = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("embedding")).where(F.col("id").isNotNull() & _sound(F.col("embedding"), self.model.metric == "cosine"))
        checked_vectors(rows, size=self.size)
        self._sorted().upsert(_keyed(self.model, rows, change), "changed", kept=())

    def delete(self, condition: str) -> None:
        self._sorted().delete(condition)

    def _sorted(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.path}/points", ["id"], _SCHEMA, sort=["cell"])

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, rescored: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", skip_own: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """(query_id, rank, id, score): about the k best points of each query.

        probes: cells that a query looks into, all if None; rescored: points of each batch of a cell that get a full
        score, all if None; with both None the result is exact. skip_own: a query's own id is no answer.
        """
        cosine = self.model.metric == "cosine"
        asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & _sound(F.col("v"), cosine)).dropDuplicates(["id"])
        checked_vectors(asked, "v", self.size)
        probes = None if probes is None or probes >= len(self.model.centres) else probes
        blocks = max(1, -(-asked.count() * (self.size + (probes or 0)) * 8 // block_bytes))
        out = None
        for b in range(blocks):
            found = self._block(asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow(), k, probes, rescored, skip_own)
            out = found if out is None else out.unionByName(found)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    def probes_for(self, queries: DataFrame, share: float = 0.95, k: int = 10, most: int = TUNED_ROWS, id_col: str = "vec_id", vec_col: str = "embedding", skip_own: bool = False) -> int:
        """Cells to look into so that this share of exact answers lies in them, measured on at most ``most`` of the queries.

        How many that is is a matter of the points: few where they lie in groups, most cells where all directions are alike.
        """
        some = queries.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(most)
        answers = self.search(some, k, id_col=id_col, vec_col=vec_col, skip_own=skip_own).select("query_id", "id")
        found = answers.join(self.table.read().select("id", "cell"), "id").join(some.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<float>").alias("v")).dropDuplicates(["query_id"]), "query_id").select("cell", "v").toArrow()
        if not found.num_rows:
            return 1
        far = (self.model.centres**2).sum(1) - 2 * _matrix(found.column("v"), self.model.metric == "cosine") @ self.model.centres.T
        own = far[np.arange(len(far)), found.column("cell").to_numpy()]
        return int(np.quantile((far < own[:, None]).sum(1), share, method="higher")) + 1

    def _block(self, block: pa.Table, k: int, probes: int | None, rescored: int | None, skip_own: bool) -> DataFrame:
        model, cosine = self.model, self.model.metric == "cosine"
        ids, wanted = block.column("id").to_numpy(), _matrix(block.column("v"), cosine)
        wanted = wanted.reshape(len(ids), self.size)
        asking = None if probes is None else _asking(wanted, model.centres, probes)
        shared = self.spark.sparkContext.broadcast((ids, wanted, asking))
        rows = self.table.read()
        rows = rows if asking is None else rows.where(F.col("cell").isin([c for c, q in enumerate(asking) if len(q)]))

        def run(batches) -> Iterator[pa.RecordBatch]:
            ids, wanted, asking = shared.value
            best = Best(len(ids), k)
            every = np.arange(len(ids))
            for batch in batches:
                of, points = batch.column("cell").to_numpy(), batch.column("id").to_numpy()
                full = _matrix(batch.column("embedding"), cosine)
                if not rescored and asking is None:
                    _score(best, cosine, every, wanted, full, points, ids, skip_own)
                    continue
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(of), -1)
                order = np.lexsort((points, of))  # equal codes go by id
                cells, starts = np.unique(of[order], return_index=True)
                for c, here in zip(cells.tolist(), np.split(order, starts[1:]), strict=True):
                    q = every if asking is None else asking[c]
                    if rescored and max(k + 1, rescored) < len(here):
                        _score_coded(best, model, c, q, wanted, codes[here], full[here], points[here], ids, max(k + 1, rescored), skip_own)
                    else:
                        _score(best, cosine, q, wanted, full[here], points[here], ids, skip_own)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows(ids)], ["query_id", "id", "score"])

        return rows.select("id", "cell", "codes", "embedding").mapInArrow(run, "query_id long, id long, score double")


def _keyed(model: Model, rows: DataFrame, change: int) -> DataFrame:
    """Points with their cell and codes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = _matrix(batch.column("embedding"), model.metric == "cosine").reshape(batch.num_rows, -1)
            if not batch.num_rows:
                continue
            cell, codes = model.coded(full)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("embedding"), pa.array(np.full(len(cell), change))], ["id", "cell", "codes", "embedding", "changed"])

    return rows.select("id", "embedding").mapInArrow(run, _SCHEMA)


def _asking(wanted: np.ndarray, centres: np.ndarray, probes: int) -> list[np.ndarray]:
    """For each cell, the queries that look into it: those that have it among their nearest ``probes``."""
    step = max(1, TILE // len(centres))
    looked = [np.zeros((0, probes), np.int32)]
    for a in range(0, len(wanted), step):
        far = (centres**2).sum(1) - 2 * wanted[a : a + step] @ centres.T
        looked.append(np.argpartition(far, probes - 1, axis=1)[:, :probes].astype(np.int32))
    cells = np.concatenate(looked).reshape(-1)
    order = np.argsort(cells, kind="stable")
    return np.split((order // probes).astype(np.int32), np.searchsorted(cells[order], np.arange(1, len(centres))))


class Best:
    """The k best points so far of each query, by (score, less id)."""

    def __init__(self, n: int, k: int):
        self.k = max(1, k)
        self.scores, self.ids = np.full((n, self.k), -np.inf), np.zeros((n, self.k), np.int64)

    def add(self, rows: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        mine = np.unique(rows)
        at, place = np.nonzero(self.scores[mine] > -np.inf)
        held = mine[at]
        rows, found, scores = np.concatenate([held, rows]), np.concatenate([self.ids[held, place], found]), np.concatenate([self.scores[held, place], scores])
        order = np.lexsort((found, -scores, rows))
        rows, found, scores = rows[order], found[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        self.ids[rows[kept], place[kept]], self.scores[rows[kept], place[kept]] = found[kept], scores[kept]

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, place = np.nonzero(self.scores > -np.inf)
        return ids[at], self.ids[at, place], self.scores[at, place]


def _score(best: Best, cosine: bool, q: np.ndarray, wanted: np.ndarray, full: np.ndarray, points: np.ndarray, ids: np.ndarray, skip_own: bool) -> None:
    """Adds what the points are to the queries q. The products tell who can be among the best; scores, and so ties, don't depend on the tile."""
    if not len(points):
        return
    sizes, step = (full**2).sum(1), max(1, TILE // len(points))
    for a in range(0, len(q), step):
        of = q[a : a + step]
        near, own = wanted[of] @ full.T, (wanted[of] ** 2).sum(1)
        floor = best.scores[of, -1]
        # of sums of n products, in any order
        slack = 4 * (full.shape[1] + 4) * np.finfo(np.float64).eps * (np.sqrt(own) + np.sqrt(sizes.max())) ** 2
        if not cosine:
            near, floor = 2 * near - sizes - own[:, None], -(floor**2)
        mask = near >= (floor - slack)[:, None]
        if skip_own:
            mask &= ids[of][:, None] != points
        many = np.flatnonzero(mask.sum(1) > 4 * best.k)
        if len(many):
            some = np.where(mask[many], near[many], -np.inf)
            least = np.partition(some, len(points) - best.k, axis=1)[:, len(points) - best.k]
            mask[many] &= some >= (least - 2 * slack[many])[:, None]
        rows, at = np.nonzero(mask)
        _add(best, cosine, of[rows], at, wanted, full, points)


def _score_coded(best: Best, model: Model, cell: int, q: np.ndarray, wanted: np.ndarray, codes: np.ndarray, full: np.ndarray, points: np.ndarray, ids: np.ndarray, most: int, skip_own: bool) -> None:
    """Adds the ``most`` points of a cell, in the order of their ids, that their codes put nearest to each of the queries q."""
    step = max(1, TILE // len(points))
    for a in range(0, len(q), step):
        of = q[a : a + step]
        about = np.zeros((len(of), len(points)), np.float32)
        rest = wanted[of] - model.centres[cell]
        for i, book in enumerate(model.books):
            part = rest[:, i * PART : (i + 1) * PART]
            about += ((book**2).sum(1) - 2 * part @ book.T).astype(np.float32)[:, codes[:, i]]
        at = np.argsort(about, axis=1, kind="stable")[:, :most].reshape(-1)
        rows = np.repeat(of, most)
        if skip_own:
            other = points[at] != ids[rows]
            rows, at = rows[other], at[other]
        _add(best, model.metric == "cosine", rows, at, wanted, full, points)


def _add(best: Best, cosine: bool, rows: np.ndarray, at: np.ndarray, wanted: np.ndarray, full: np.ndarray, points: np.ndarray) -> None:
    """Adds pairs of a query and a place of a point, with their full scores."""
    step = max(1, TILE // full.shape[1])
    for a in range(0, len(rows), step):
        of, to = rows[a : a + step], at[a : a + step]
        vectors, each = full[to], wanted[of]
        best.add(of, points[to], (vectors * each).sum(1) if cosine else -np.sqrt(((vectors - each) ** 2).sum(1)))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact answers (query_id, id) that are found."""
    both = exact.join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return both.agg(F.coalesce(F.count("hit") / F.count("*"), F.lit(1.0))).first()[0]
