"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting.  Documents are tokenised once into batches (word hashes of the batch,
and each document's tokens as places in that list), written to the shared
folder.  Distinct words and word pairs of every batch are dealt to shards by
hash and counted there, over all training documents.

The filter.  A pair counted c times is stored at levels 1 to q, where q is the
highest of the fixed thresholds 1, 2, 3, 4, 5, 8, 11, ... that c reaches.  Asking
level after level until one is absent gives q back, and the threshold is the
count that the model uses, never more than the true one but for the filter's
false positives (a few in a hundred of absent pairs, one level up).  Words are
stored in the same way.  Each shard makes its own segment of the filter.

The model.  P(w | v) = (1 - u) c(vw) / c(v) + u P(w).  u is the share of pairs
seen once, among contexts of about the same count (Good and Turing's estimate
of what is new).  P(w) is c(w) / N, reduced by the share of words seen once,
which goes to one class of all unknown words.  Counts of single words are
exact; they come back from the shards to the batches in packed rows.

The filter is broadcast while its size, known before, is at most
``FILTER_BYTES``; a larger one stays in its shards, and the batches send their
pairs there.

Defined cases: a null or empty text is its end token alone; repeated rows are
counted and scored each; a null id has the text "" for its checksum; without
training documents every score is that of an empty corpus, log10(1) a token;
an empty table gives no rows; other columns play no part; a batch is closed after a
whole document, so that a very long text sets its task's memory, a small multiple
of its bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import shards, written
from marlstone.llm.spans import in_pieces, mix

FOLDS = 10
#: Tokens a batch.
HELD = 500_000
BITS_PER_ENTRY = 8
HASHES = 5
#: Largest filter that is broadcast.
FILTER_BYTES = 256 << 20
_END, _BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_THRESHOLDS = np.array(sorted({int(2 ** (k / 2)) for k in range(2, 100)} | {1, 3}), np.int64)
_CUT = np.uint64(16)


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers byte plane by byte plane, which compresses well."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unplanes(raw: bytes, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).reshape(-1).view(kind)


def _sorted_out(ascending: np.ndarray) -> bytes:
    return planes(np.diff(ascending, prepend=np.uint64(0)).astype("<u8"))


def _sorted_in(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, "<u8"), dtype=np.uint64)


def is_held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


class Batch:
    """Documents as places in a list of word hashes, which is sorted by shard and hash."""

    COLUMNS = "batch long, ids array<long>, held binary, ends binary, places binary, words binary"

    def __init__(self, row: dict):
        self.name, self.ids = row["batch"], row["ids"]
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.ends = unplanes(row["ends"], "<u8").astype(np.int64)
        self.places = unplanes(row["places"], "<u4").astype(np.int64)
        self.words = unplanes(row["words"], "<u8")
        self.begins = np.concatenate([[0], self.ends[:-1]])
        self.trained = np.repeat(~self.held, self.ends - self.begins)

    def pairs(self) -> np.ndarray:
        """48-bit hash of each token and the one before it (a document's first has a begin mark before it)."""
        word = self.words[self.places]
        before = np.empty(len(word), np.uint64)
        before[1:] = word[:-1]
        before[self.begins] = _BEGIN
        with np.errstate(over="ignore"):
            return mix(before * np.uint64(3) + word) >> _CUT


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def batches_of(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """The tokenised documents, written to the shared folder."""
    names = [c.split()[0] for c in Batch.COLUMNS.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ids: list = []
        lengths: list[np.ndarray] = []
        many = 0

        def close() -> pa.RecordBatch:
            words, places = np.unique(np.concatenate(held), return_inverse=True)
            order = np.argsort(words % np.uint64(n_shards), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            parts = [np.array([is_held_out(i, folds) for i in ids], np.uint8).tobytes(), planes(np.cumsum(np.concatenate(lengths)).astype("<u8")), planes(rank[places].astype("<u4")), planes(words[order].astype("<u8"))]
            name = hashlib.blake2b(repr(ids).encode() + parts[1] + parts[2] + parts[3], digest_size=7).digest()
            row = [int.from_bytes(name, "big"), ids, *parts]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for rows, piece in in_pieces(batches, "text", fold=True):
            n = np.diff(piece.word_bounds)
            held.append(np.insert(piece.hash(*piece.words), piece.word_bounds[1:], _END))
            lengths.append(n + 1)
            ids += rows.column("id").to_pylist()
            many += len(held[-1])
            if many >= HELD:
                yield close()
                held, ids, lengths, many = [], [], [], 0
        if ids:
            yield close()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(texts.mapInArrow(run, Batch.COLUMNS), "lm-batches")


def _dealt_words(n_shards: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Batch(row)
            counts = np.bincount(b.places[b.trained], minlength=len(b.words)).astype("<u8")
            cuts = np.searchsorted(b.words % np.uint64(n_shards), np.arange(n_shards + 1))
            out = [(s, b.name, _sorted_out(b.words[x:y]), planes(counts[x:y])) for s, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "batch", "words", "counts"])

    return run


def word_counts(batches: DataFrame, n_shards: int) -> DataFrame:
    """(batch, shard, counts, levels) for every batch: its words' counts over all training documents and their levels in the filter, in its order; written.

    One more row a shard, with a null batch, has totals (all tokens, distinct words, words seen once) and the shard's
    segment of the filter of words.
    """

    def total(key: tuple, table: pa.Table) -> pa.Table:
        words = [_sorted_in(w) for w in table.column("words").to_pylist()]
        counts = [unplanes(c, "<u8") for c in table.column("counts").to_pylist()]
        distinct, at = np.unique(np.concatenate(words), return_inverse=True)
        sums = np.bincount(at, np.concatenate(counts).astype(np.float64), minlength=len(distinct)).astype(np.int64)
        some = sums > 0
        segment = Segment.of(distinct[some], sums[some])
        levels = segment.levels(distinct)
        rows, first = [], 0
        for name, w in zip(table.column("batch").to_pylist(), words, strict=True):
            mine = at[first : first + len(w)]
            rows.append((name, key[0].as_py(), planes(sums[mine].astype("<u8")), levels[mine].tobytes(), None, None))
            first += len(w)
        numbers = [int(sums.sum()), int(some.sum()), int((sums == 1).sum())]
        rows.append((None, key[0].as_py(), None, None, numbers, segment.bits.tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["batch", "shard", "counts", "levels", "totals", "bits"])

    dealt = batches.mapInArrow(_dealt_words(n_shards), "shard int, batch long, words binary, counts binary")
    return written(dealt.groupBy("shard").applyInArrow(total, "batch long, shard int, counts binary, levels binary, totals array<long>, bits binary"), "lm-words")


def _positions(keys: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        a = mix(keys * np.uint64(64) + np.uint64(level))
        b = mix(a) | np.uint64(1)
        for k in range(HASHES):
            yield ((a + np.uint64(k) * b) % np.uint64(size)).astype(np.int64)


class Segment:
    """One shard's part of the filter."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, len(bits) * 8

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Segment:
        levels = np.searchsorted(_THRESHOLDS, counts, "right")
        size = -(-max(64, int(levels.sum()) * BITS_PER_ENTRY) // 8) * 8
        flags = np.zeros(size, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            for at in _positions(keys[levels >= level], level, size):
                flags[at] = True
        return cls(np.packbits(flags, bitorder="little"))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The quantised level of each key, by asking level after level until one is absent."""
        out, who = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        for level in range(1, len(_THRESHOLDS) + 1):
            who = who[self._all_set(keys[who], level)]
            if not len(who):
                break
            out[who] = level
        return out

    def _all_set(self, keys: np.ndarray, level: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            a = mix(keys * np.uint64(64) + np.uint64(level))
            b = mix(a) | np.uint64(1)
            left = np.arange(len(keys))
            for k in range(HASHES):
                at = ((a[left] + np.uint64(k) * b[left]) % np.uint64(self.size)).astype(np.int64)
                left = left[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out


def pair_filter(batches: DataFrame, n_shards: int) -> DataFrame:
    """(shard, bits): the filter's segments, over the pairs of all training documents; written."""

    def deal(batches) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Batch(row)
            keys, counts = np.unique(b.pairs()[b.trained], return_counts=True)
            order = np.argsort(keys % np.uint64(n_shards), kind="stable")
            keys, counts = keys[order], counts[order].astype("<u4")
            cuts = np.searchsorted(keys % np.uint64(n_shards), np.arange(n_shards + 1))
            out = [(s, _sorted_out(keys[x:y]), planes(counts[x:y])) for s, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "pairs", "counts"])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        pairs = np.concatenate([_sorted_in(p) for p in table.column("pairs").to_pylist()])
        counts = np.concatenate([unplanes(c, "<u4") for c in table.column("counts").to_pylist()])
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        bits = Segment.of(pairs[starts], np.add.reduceat(counts[order].astype(np.int64), starts)).bits
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["shard", "bits"])

    dealt = batches.mapInArrow(deal, "shard int, pairs binary, counts binary")
    return written(dealt.groupBy("shard").applyInArrow(build, "shard int, bits binary"), "lm-filter")


def _probed(batches: DataFrame, segments: DataFrame, n_shards: int) -> DataFrame:
    """(batch, shard, levels), for a filter too large to broadcast: each batch's distinct pairs, sorted by shard and hash, asked for in the shards; written."""

    def deal(batches) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Batch(row)
            keys = np.unique(b.pairs())
            keys = keys[np.argsort(keys % np.uint64(n_shards), kind="stable")]
            cuts = np.searchsorted(keys % np.uint64(n_shards), np.arange(n_shards + 1))
            out = [(s, b.name, _sorted_out(keys[x:y])) for s, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["shard", "batch", "pairs"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        segment = Segment(np.frombuffer(right.column("bits")[0].as_py(), np.uint8)) if right.num_rows else None
        found = []
        for pairs in left.column("pairs").to_pylist():
            keys = _sorted_in(pairs)
            found.append((segment.levels(keys) if segment else np.zeros(len(keys), np.uint8)).tobytes())
        return pa.table([left.column("batch"), left.column("shard"), pa.array(found, pa.binary())], names=["batch", "shard", "levels"])

    dealt = batches.mapInArrow(deal, "shard int, batch long, pairs binary")
    return written(dealt.groupBy("shard").cogroup(segments.groupBy("shard")).applyInArrow(answer, "batch long, shard int, levels binary"), "lm-levels")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    n_shards = shards(docs, text_col)
    batches = batches_of(docs, n_shards, id_col, text_col, folds)
    counted = word_counts(batches, n_shards)
    sums = counted.where("batch is null").select(*(F.coalesce(F.sum(F.col("totals")[k]), F.lit(0)) for k in range(3))).first()
    n, v, once = (int(x) for x in sums)
    segments = pair_filter(batches, n_shards)
    word_segments = counted.where("batch is null").select("shard", "bits")
    both = word_segments.select("shard", F.lit(0).alias("kind"), "bits").unionByName(segments.select("shard", F.lit(1).alias("kind"), "bits"))
    size = both.select(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
    answers = counted.where("batch is not null").select("batch", F.lit(0).alias("kind"), "shard", F.col("counts").alias("found"))
    shared = None
    if size <= filter_bytes:
        shared = spark.sparkContext.broadcast({(r["kind"], r["shard"]): bytes(r["bits"]) for r in both.toLocalIterator()})
    else:
        answers = answers.unionByName(_probed(batches, segments, n_shards).select("batch", F.lit(1).alias("kind"), "shard", F.col("levels").alias("found")))
        answers = answers.unionByName(counted.where("batch is not null").select("batch", F.lit(2).alias("kind"), "shard", F.col("levels").alias("found")))
    train_docs = docs.select(F.col(id_col).cast("string").alias("i")).where(F.crc32(F.coalesce("i", F.lit("")).cast("binary")) % folds != 0).count()
    train_level = int(np.searchsorted(_THRESHOLDS, train_docs, "right"))
    opened: dict = {}

    def ask(kind: int, keys: np.ndarray) -> np.ndarray:
        """Levels of keys in the broadcast filter."""
        if "segments" not in opened:
            opened["segments"] = {k: Segment(np.frombuffer(bits, np.uint8)) for k, bits in shared.value.items()}
        out, shard = np.zeros(len(keys), np.uint8), (keys % np.uint64(n_shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(n_shards + 1))
        for s, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if y > x and (kind, s) in opened["segments"]:
                out[order[x:y]] = opened["segments"][kind, s].levels(keys[order[x:y]])
        return out

    def found(row: dict, kind: int) -> list[bytes]:
        return [a["found"] for a in row.get("answers") or [] if a["kind"] == kind]

    def pair_levels(b: Batch, row: dict) -> np.ndarray:
        pairs = b.pairs()
        if shared is not None:
            return ask(1, pairs)
        keys = np.unique(pairs)
        keys = keys[np.argsort(keys % np.uint64(n_shards), kind="stable")]
        levels = np.frombuffer(b"".join(found(row, 1)), np.uint8)
        order = np.argsort(keys)
        return levels[order][np.searchsorted(keys[order], pairs)]

    def before(b: Batch, of_words: np.ndarray, of_begin: int) -> np.ndarray:
        """What the token before each token has."""
        out = np.empty(len(b.places), of_words.dtype)
        out[1:] = of_words[b.places[:-1]]
        out[b.begins] = of_begin
        return out

    def answered(answers: DataFrame) -> DataFrame:
        # equal batches have one name and equal answers
        return batches.join(answers.groupBy("batch").agg(F.array_sort(F.collect_set(F.struct("kind", "shard", "found"))).alias("answers")), "batch")

    def novelty(rows) -> Iterator[pa.RecordBatch]:
        kinds = len(_THRESHOLDS) + 1
        for row in _rows(rows):
            b = Batch(row)
            levels = ask(0, b.words) if shared is not None else np.frombuffer(b"".join(found(row, 2)), np.uint8)
            kind = before(b, levels.astype(np.int64), train_level)[b.trained]
            pair = pair_levels(b, row)
            seen, new = np.bincount(kind, minlength=kinds), np.bincount(kind[pair[b.trained] <= 1], minlength=kinds)
            yield pa.RecordBatch.from_arrays([pa.array([b.name]), pa.array([pair.tobytes()], pa.binary()), pa.array([seen.tolist()]), pa.array([new.tolist()])], ["batch", "levels", "seen", "new"])

    # what every token's pair has, kept for the scores
    asked = written((batches if shared is not None else answered(answers)).mapInArrow(novelty, "batch long, levels binary, seen array<long>, new array<long>"), "lm-pairs")
    answers = answers.where("kind = 0").unionByName(asked.select("batch", F.lit(3).alias("kind"), F.lit(0).alias("shard"), F.col("levels").alias("found")))
    share = np.ones(len(_THRESHOLDS) + 1)
    by_kind = asked.select(F.posexplode(F.arrays_zip("seen", "new"))).groupBy("pos").agg(F.sum("col.seen"), F.sum("col.new"))
    for kind, seen, new in by_kind.collect():
        share[kind] = min(1.0, (new + 1) / (seen + 2)) if seen else 1.0
    values = np.concatenate([[0], _THRESHOLDS]).astype(np.float64)
    unknown = min(0.5, (once + 1) / (n + 2))

    def score(rows) -> Iterator[pa.RecordBatch]:
        for row in _rows(rows):
            b = Batch(row)
            counts = np.concatenate([unplanes(x, "<u8") for x in found(row, 0)]).astype(np.int64)
            c, context = counts[b.places], before(b, counts, train_docs)
            level = np.frombuffer(found(row, 3)[0], np.uint8)
            base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            alone = np.where(c > 0, c / max(n, 1) * (1 - unknown), unknown) if n else np.ones(len(c))
            u = np.where(context > 0, share[np.searchsorted(_THRESHOLDS, context, "right")], 1.0)
            together = np.minimum(values[level], np.minimum(np.maximum(c, 1), np.maximum(context, 1))) / np.maximum(context, 1)
            p = np.log10((1 - u) * np.where((c > 0) & (context > 0), together, 0) + u * alone)
            add = lambda x: np.add.reduceat(x, b.begins)
            columns = [pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.ends - b.begins), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(b.ids), n)), pa.array(add(base)), pa.array(add(p))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return answered(answers).mapInArrow(score, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
