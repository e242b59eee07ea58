"""Quality rules: plain text statistics and a target-against-raw likelihood ratio for every document.

Words and word pairs (letters A-Z folded) are hashed into a fixed number of
buckets.  Two multinomials over the buckets are counted: one over a trusted
sample, one over all documents.  A document's score is the mean, over its own
features, of log p_target - log p_raw; a document below the model's threshold is
rejected, so the verdict depends on nothing but its text and the model.

Neither prior nor threshold has a size in it.  The prior is a fixed part of the
trusted features.  For the threshold, labelled documents are scored as unlabelled
ones are: a trusted one by the model without its own words.  The threshold is
the cut that separates trusted from bad ones best, and it never rejects more
than the share ``MOST_LOST`` of the trusted ones.

Both multinomials have ``BUCKETS`` entries whatever the input's size.  Every
document is counted in the raw one; the trusted one is fitted on at most
``TRUSTED_ROWS`` labelled documents, chosen by a hash of their id, and the
threshold on these and as many bad ones.

Defined cases: a null or empty text has no words and fails the base rules; a
null id keeps its row; repeated rows are scored each on its own and counted
each; without trusted documents the ratio is 0 for all and only the base rules
speak; without bad ones the threshold is the trusted ones' lowest score but for
``MOST_LOST``; a labelled id of several rows has its least score there, so that
the driver gets one for each id of the samples; other columns of the input are ignored or, in ``filtered``, kept; an empty table gives no rows; a very long text
is one piece, whose arrays take a small multiple of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.spans import Piece, in_pieces, mix

BUCKETS = 1 << 14
TRUSTED_ROWS = 20_000
#: Weight of the raw model in the trusted one, as a part of the trusted features: what the trusted sample hasn't seen is doubted, not ruled out.
PRIOR = 0.25
#: Largest share of trusted documents that the threshold may reject.
MOST_LOST = 0.01
LEAST_WORDS = 50
MOST_REPEATED = 50
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def features(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of the words and word pairs of a piece."""
    words = piece.hash(*piece.words)
    doc = piece.doc_of(piece.word_bounds)
    same = doc[1:] == doc[:-1]
    with np.errstate(over="ignore"):
        pairs = mix(words[:-1] * np.uint64(3) + words[1:])[same]
    return np.concatenate([doc, doc[1:][same]]), (np.concatenate([words, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def _seen_before(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (document, hash) pairs: which equal an earlier one, and which occur more than once."""
    with np.errstate(over="ignore"):
        key = mix(h + mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    earlier, often = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order[1:]] = same
    often[order[1:]] = same
    often[order[:-1]] |= same
    return earlier, often


def statistics(piece: Piece) -> dict[str, np.ndarray]:
    """The base statistics of each document of a piece; lines and words compare as they stand, without folding."""
    piece = Piece(piece.first, piece.data, piece.offsets)
    n_words = np.diff(piece.word_bounds)
    starts, ends, bounds = piece.lines
    line_doc = piece.doc_of(bounds)
    worded = piece.solid_before[ends] > piece.solid_before[starts]
    repeated, _ = _seen_before(line_doc[worded], piece.hash(starts[worded], ends[worded]))
    word, doc = piece.hash(*piece.words), piece.doc_of(piece.word_bounds)
    inside = doc[2:] == doc[:-2]
    with np.errstate(over="ignore"):
        three = mix(mix(word[:-2] * np.uint64(3) + word[1:-1]) * np.uint64(5) + word[2:])[inside]
    _, often = _seen_before(doc[2:][inside], three)
    covered = np.zeros(len(word), bool)
    at = np.flatnonzero(inside)[often]
    for k in range(3):
        covered[at + k] = True
    return {
        "n_words": n_words,
        "word_chars": piece.count(((piece.data & 0xC0) != 0x80) & piece.solid),
        "n_symbols": piece.count(_SYMBOLS[piece.data]),
        "n_dup_lines": np.bincount(line_doc[worded][repeated], minlength=piece.n),
        "n_repeat_words": np.bincount(doc[covered], minlength=piece.n),
    }


@dataclass(frozen=True)
class Model:
    """Log ratio of each bucket, and the mean log ratio, in nats a feature, below which a document is rejected."""

    ratio: np.ndarray
    least_score: float = 0.0

    def any(self) -> bool:
        return bool(self.ratio.any())


def log_ratio(target: np.ndarray, total: np.ndarray | float, p_raw: np.ndarray) -> np.ndarray:
    """Of counts in a trusted sample of so many features; 0 where it has none."""
    some = np.maximum(total, 1)
    return np.where(np.asarray(total) > 0, np.log((target + PRIOR * some * p_raw) / ((1 + PRIOR) * some)) - np.log(p_raw), 0.0)


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the least sum of the shares of good scores below it and bad ones not below, in the middle of its gap."""
    good, bad = np.sort(good), np.sort(bad)
    if not len(good):
        return -np.inf
    most = good[int(MOST_LOST * len(good))]
    if not len(bad):
        return float(most)
    scores = np.unique(np.concatenate([good, bad]))
    cuts = scores[scores <= most]
    cost = np.searchsorted(good, cuts) / len(good) - np.searchsorted(bad, cuts) / len(bad)
    k = int(np.argmin(cost))
    return float((cuts[k] + cuts[k - 1]) / 2 if k else cuts[k])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", trusted_rows: int = TRUSTED_ROWS) -> Model:
    """labels: (id, quality); an id is trusted if all its labels say 1, and bad otherwise."""
    spark = docs.sparkSession
    labelled = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"))

    def sample(which: str) -> np.ndarray:
        return np.array(sorted(r[0] for r in labelled.where(which).orderBy(F.xxhash64(id_col), id_col).limit(trusted_rows).select(id_col).collect()), np.int64)

    chosen, bad = sample("q = 1"), sample("q <> 1")

    def count(batches) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for rows, piece in in_pieces(batches, "text", fold=True):
            doc, bucket = features(piece)
            ids = rows.column("id")
            good = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), chosen) & ids.is_valid().to_numpy(zero_copy_only=False)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[doc]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "n_raw", "n_target"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = texts.mapInArrow(count, "bucket long, n_raw long, n_target long").groupBy("bucket").agg(F.sum("n_raw"), F.sum("n_target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, a, b in rows:
        raw[bucket], target[bucket] = a, b
    if not target.sum():
        return Model(np.zeros(BUCKETS))
    total, p_raw = target.sum(), (raw + 1) / (raw.sum() + BUCKETS)

    def held_out(batches) -> Iterator[pa.RecordBatch]:
        """Scores of labelled documents that pass the base rules, each by the trusted sample without it."""
        for rows, piece in in_pieces(batches, "text", fold=True):
            good = np.isin(rows.column("id").to_numpy(zero_copy_only=False), chosen)
            doc, bucket = features(piece)
            n = np.bincount(doc, minlength=piece.n)
            pair, own = np.unique(doc * BUCKETS + bucket, return_counts=True)
            doc, bucket = pair // BUCKETS, pair % BUCKETS
            ratio = log_ratio(target[bucket] - own * good[doc], (total - n * good)[doc], p_raw[bucket])
            scores = np.bincount(doc, ratio * own, minlength=piece.n) / np.maximum(n, 1)
            passed = ~base_failed(statistics(piece))
            yield pa.RecordBatch.from_arrays([rows.column("id").filter(pa.array(passed)), pa.array(good[passed]), pa.array(scores[passed])], ["id", "good", "score"])

    asked = spark.createDataFrame([(int(i),) for i in np.concatenate([chosen, bad])], "id long")
    scores = texts.join(F.broadcast(asked), "id", "left_semi").select("id", "text").mapInArrow(held_out, "id long, good boolean, score double").groupBy("id", "good").agg(F.min("score").alias("score")).collect()
    of = lambda good: np.array([r["score"] for r in scores if r["good"] == good])
    return Model(log_ratio(target, total, p_raw), threshold(of(True), of(False)))


def base_failed(of: dict[str, np.ndarray]) -> np.ndarray:
    return (of["n_words"] < LEAST_WORDS) | (100 * of["n_repeat_words"] > MOST_REPEATED * of["n_words"])


def judge(piece: Piece, model: Model) -> dict[str, np.ndarray]:
    """Statistics, score and verdict of each document of a piece."""
    out = statistics(piece)
    doc, bucket = features(piece)
    n = np.bincount(doc, minlength=piece.n)
    out["base_failed"] = base_failed(out)
    out["score"] = np.bincount(doc, model.ratio[bucket], minlength=piece.n) / np.maximum(n, 1)
    out["kept"] = ~out["base_failed"] & (out["score"] >= model.least_score)
    return out


def annotated(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and METRICS."""
    texts = docs.select(id_col, F.col(text_col).alias("__text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows, piece in in_pieces(batches, "__text", fold=True):
            found = judge(piece, model)
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, found.values())], [id_col, *found])

    order = "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept".split(", ")
    kind = docs.schema[id_col].dataType.simpleString()
    return texts.mapInArrow(run, f"`{id_col}` {kind}, {METRICS}").select(id_col, *order)


def filtered(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose document is kept, with all their columns."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows, piece in in_pieces(batches, text_col, fold=True):
            yield rows.filter(pa.array(judge(piece, model)["kept"]))

    return docs.mapInArrow(run, docs.schema)
