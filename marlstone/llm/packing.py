"""Packing token ids into fixed windows whose mixture of sources follows target proportions.

Every source is a queue of its documents' tokens.  Windows are filled by
deficit round-robin: each window adds to every queue's deficit its share of the
window, queues give tokens in order of their deficits, and what a queue is owed
or has given too much is carried to the next window.

The carry crosses partitions without any task waiting for another: how many
tokens each queue has given by the start of any block of windows is fixed in
closed form (its target, rounded), so a block starts from known queue positions
and known deficits, and ends at those of the next block.  Blocks are therefore
independent groups of nearly equal size however skewed the sources are; a
window on the border of two blocks is filled by both.

By default a queue's target is its share of all tokens, so all queues last to
the end.  Given targets are kept while they can be: a queue that has run dry
leaves its share to the others.

Defined cases: a null or empty text has only its end id; a null source is the
source "", repeated rows are packed each; an empty table gives no rows.  Every
source has its own queue, however many there are; a target without a source of
its name is an error.  A queue has its documents in the order in which their rows
are read; where an exchange comes before, Spark doesn't fix that order, and
another run may put a document into another window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import tokens
from marlstone.llm.shared import written

WINDOW = 1024
#: Windows a block.
BLOCK = 1024
#: With more queues, a task works out the block borders of those it meets only.
QUEUES = 256
#: A queue owed less than this waits for a later window, so that documents are cut into few pieces.
LEAST_PIECE = 48
#: Rows of queue positions that may be broadcast.
BROADCAST_ROWS = 1_000_000


class Plan:
    """How many tokens each queue has given after the first x tokens of all."""

    def __init__(self, totals: list[int], targets: list[Fraction] | None = None):
        self.totals, self.total = totals, sum(totals)
        weights = list(targets) if targets else [Fraction(t) for t in totals]
        given, x = [Fraction(0)] * len(totals), Fraction(0)
        #: Phases (start, what was given by then, rates); each ends where a queue runs dry.
        self.phases: list[tuple[Fraction, list[Fraction], list[Fraction]]] = []
        while x < self.total:
            active = [w if t > g else Fraction(0) for w, t, g in zip(weights, totals, given, strict=True)]
            if not sum(active):
                active = [t - g for t, g in zip(totals, given, strict=True)]
            rates = [a / sum(active) for a in active]
            length = min((t - g) / r for t, g, r in zip(totals, given, rates, strict=True) if r)
            self.phases.append((x, given, rates))
            given = [g + r * length for g, r in zip(given, rates, strict=True)]
            x += length

    def phase(self, x: int) -> tuple[Fraction, list[Fraction], list[Fraction]]:
        return next(p for p in reversed(self.phases) if p[0] <= x or not p[0])

    def targets(self, x: int) -> list[Fraction]:
        start, given, rates = self.phase(x)
        return [g + r * (x - start) for g, r in zip(given, rates, strict=True)]

    def rates(self, x: int) -> list[float]:
        return [float(r) for r in self.phase(x)[2]]

    def given_by(self, q: int, x: int) -> int:
        """given(x)[q], without the other queues."""
        if x >= self.total:
            return self.totals[q]
        start, given, rates = self.phase(x)
        return int(given[q] + rates[q] * (x - start) + Fraction(1, 2))

    def given(self, x: int) -> list[int]:
        """In whole tokens, which may add up to a few more or less than x; all tokens at the end."""
        return [int(t + Fraction(1, 2)) for t in self.targets(x)] if x < self.total else list(self.totals)


def fill(plan: Plan, x: int, y: int) -> list[tuple[int, int, int, int]]:
    """Deficit round-robin from the plan's state at x to that at y: (queue, window, offset, length), each queue's in its order."""
    before, after = plan.given(x), plan.given(y)
    left = [b - a for a, b in zip(before, after, strict=True)]
    owed = [float(t - g) for t, g in zip(plan.targets(x), before, strict=True)]
    begin, last = sum(before), sum(after)
    queues, out, phase, rates = [q for q, n in enumerate(left) if n], [], None, []
    while begin < last:
        window, offset = divmod(begin, WINDOW)
        size = room = min(WINDOW - offset, last - begin)
        if plan.phase(begin) is not phase:
            phase, rates = plan.phase(begin), plan.rates(begin)
        for q in queues:
            owed[q] += rates[q] * room
        queues = [q for q in queues if left[q]]
        order = sorted(queues, key=owed.__getitem__, reverse=True)
        gives = dict.fromkeys(order, 0)
        for q in order:
            n = min(int(owed[q]), left[q], room)
            if n >= LEAST_PIECE or n == left[q] > 0:
                gives[q], room = n, room - n
        for q in order:  # deficits below the least piece leave room: those owed most lend
            if not room:
                break
            n = min(left[q] - gives[q], room, max(LEAST_PIECE, size // 8))
            gives[q] += n
            room -= n
        for q in order:
            if not room:
                break
            n = min(left[q] - gives[q], room)
            gives[q] += n
            room -= n
        for q, n in gives.items():
            if n:
                out.append((q, window, offset, n))
                offset, left[q], owed[q] = offset + n, left[q] - n, owed[q] - n
        begin += size
    return out


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(part, queue, before, id, n, ids), written: ids of each text with its end id; before counts its queue's ids earlier in the part."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), source.alias("queue"), F.spark_partition_id().alias("part"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder, so_far = tokens.library_encoder(path), {}
        for rows, ids, bounds in encoder.encoded(batches, "text", end_id):
            n, before = np.diff(bounds), []
            for q, k in zip(rows.column("queue").to_pylist(), n.tolist(), strict=True):
                before.append(so_far.get(q, 0))
                so_far[q] = before[-1] + k
            yield pa.RecordBatch.from_arrays([rows.column("part"), rows.column("queue"), pa.array(before, pa.int64()), rows.column("id"), pa.array(n), tokens.binaries(ids, bounds)], ["part", "queue", "before", "id", "n", "ids"])

    return written(texts.mapInArrow(run, "part int, queue string, before long, id long, n long, ids binary"), "packing-ids")


def packed(ids: DataFrame, wide: int = 2, targets: dict[str, float] | None = None, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a window, from what ``encoded`` has written."""
    spark = ids.sparkSession
    schema = f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    by_part = ids.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    totals = sorted(map(tuple, by_part.groupBy("queue").agg(F.sum("n")).collect()))
    if not totals:
        return spark.createDataFrame([], schema)
    names = [q for q, _ in totals]
    if unknown := set(targets or ()) - set(names):
        raise ValueError(f"targets of sources that aren't there: {sorted(unknown)[:5]}")
    shares = [Fraction(targets.get(q, 0)).limit_denominator(10**6) for q in names] if targets else None
    plan = Plan([n for _, n in totals], shares)
    number = {q: k for k, q in enumerate(names)}
    earlier = by_part.selectExpr("queue", "part", "coalesce(sum(n) over (partition by queue order by part rows between unbounded preceding and 1 preceding), 0) as part_before")
    positions = written(earlier, "packing-parts")
    if positions.count() <= BROADCAST_ROWS:
        positions = F.broadcast(positions)
    span, kind = WINDOW * BLOCK, f"<u{wide}"

    def deal(batches) -> Iterator[pa.RecordBatch]:
        edges: dict = {}

        def edge(block: int, k: int) -> int:
            if len(names) > QUEUES:
                if (block, k) not in edges:
                    edges[block, k] = plan.given_by(k, block * span)
                return edges[block, k]
            if block not in edges:
                edges[block] = plan.given(block * span)
            return edges[block][k]

        blocks = -(-plan.total // span)
        for batch in batches:
            columns = [[] for _ in range(8)]
            for q, at, doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("queue", "at", "id", "n", "ids")), strict=True):
                k = number[q]
                low, high = 0, blocks - 1
                guess = min(high, at * plan.total // (plan.totals[k] * span))
                if edge(guess, k) <= at < edge(guess + 1, k):
                    low = guess
                else:
                    while low < high:
                        mid = (low + high + 1) // 2
                        low, high = (mid, high) if edge(mid, k) <= at else (low, mid - 1)
                start = 0
                while start < n:
                    stop = min(n, edge(low + 1, k) - at)
                    if stop > start:
                        for c, v in zip(columns, (low, k, at + start, doc, start, stop - start, n, raw[start * wide : stop * wide]), strict=True):
                            c.append(v)
                    start, low = max(start, stop), low + 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["block", "queue", "at", "id", "start", "length", "n", "ids"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("queue", "ascending"), ("at", "ascending")]).combine_chunks()
        block = table.column("block")[0].as_py()
        takes: dict[int, list[tuple[int, int, int]]] = {}
        for q, window, offset, n in fill(plan, block * span, min(plan.total, (block + 1) * span)):
            takes.setdefault(q, []).append((window, offset, n))
        out = [[] for _ in range(8)]
        queue, starts, lengths, docs, sizes, raws = (table.column(c).to_pylist() for c in ("queue", "start", "length", "id", "n", "ids"))
        row = 0
        for q in sorted(takes):
            given = iter(takes[q])
            window, offset, room = next(given)
            while row < len(queue) and queue[row] == q:
                done, raw = 0, np.frombuffer(raws[row], kind).astype("<u4")
                while done < lengths[row]:
                    if not room:
                        window, offset, room = next(given)
                    n = min(room, lengths[row] - done)
                    some = raw[done : done + n].tobytes()
                    for c, v in zip(out, (docs[row], starts[row] + done, n, zlib.crc32(some), sizes[row], window, offset, some), strict=True):
                        c.append(v)
                    done, offset, room = done + n, offset + n, room - n
                row += 1
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        kinds = [pa.int64()] * 7 + [pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names).select(names if with_ids else names[:-1])

    dealt = ids.join(positions, ["queue", "part"]).select("queue", (F.col("part_before") + F.col("before")).alias("at"), "id", "n", "ids")
    items = dealt.mapInArrow(deal, "block long, queue int, at long, id long, start long, length long, n long, ids binary")
    return items.groupBy("block").applyInArrow(pack, schema)
