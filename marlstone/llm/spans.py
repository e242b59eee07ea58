"""Vectorised spans over the bytes of Arrow string columns.

Text operators here work on the UTF-8 bytes of a whole Arrow batch at once:
numpy finds the words or lines of all documents together and hashes every span
eight bytes at a time, so nothing loops over characters or words in Python.

A span's eight-byte words are mixed each with a key of its place, and the sum is
mixed again with the length.  Mixing is not linear, so that regular texts (long
words over two letters, say) collide no more often than others: two spans of a
corpus with n different ones share a 64-bit hash with probability n**2 / 2**65.
The hashes are not secret; who must exclude collisions compares both of them.

Null texts count as empty.  A batch is cut into pieces of about
``PIECE_BYTES`` and ``PIECE_DOCS`` (one document is never cut), which bounds the working memory
to a small multiple of the piece, or of the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
PIECE_DOCS = 1 << 14

#: Seeds of two independent hashes, and what tells a span's eight-byte words apart by their place.
_SEEDS = np.random.default_rng(20240607).integers(1 << 62, 1 << 63, 2).astype(np.uint64)
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space of the contracts: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_SOLID = ~SPACE
#: Bytes of terms: digits, letters, and all of what lies beyond ASCII.
TERM = np.arange(256) >= 128
TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


@dataclass
class Piece:
    """Some consecutive documents of a batch: rows [first, first + n), their bytes, and n + 1 byte offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    fold: bool = False
    #: Bytes that words consist of; the rest is between them.
    inside: np.ndarray = field(default_factory=lambda: _SOLID)

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def lowered(self) -> np.ndarray:
        return _LOWER[self.data]

    @cached_property
    def solid(self) -> np.ndarray:
        """True at bytes of words."""
        return self.inside[self.data]

    @cached_property
    def solid_before(self) -> np.ndarray:
        return _before(self.solid)

    @cached_property
    def points_before(self) -> np.ndarray:
        """Code points that start before each byte position."""
        return _before((self.data & 0xC0) != 0x80)

    @cached_property
    def _eights(self) -> np.ndarray:
        """The eight bytes from each position on, as one integer; zeros follow the last."""
        padded = np.concatenate([self.lowered if self.fold else self.data, np.zeros(8, np.uint8)])
        return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))

    def hash(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """64-bit hashes of byte spans; equal bytes have equal hashes wherever they stand."""
        starts, lengths = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - starts
        seed = _SEEDS[which]
        with np.errstate(over="ignore"):
            out = mix((self._eights.take(starts) & _KEPT[np.minimum(lengths, 8)]) + seed)
            long = np.flatnonzero(lengths > 8)
            if len(long):
                many = (lengths[long] - 1) // 8
                before = np.cumsum(many) - many
                place = np.arange(int(many.sum())) - np.repeat(before, many) + 1
                left = np.repeat(lengths[long], many) - 8 * place
                words = self._eights.take(np.repeat(starts[long], many) + 8 * place) & _KEPT[np.minimum(left, 8)]
                key = mix(place.astype(np.uint64) * _PLACE + seed)
                out[long] += np.add.reduceat(mix(mix(words + key) ^ key), before)
            return mix(out + lengths.astype(np.uint64) * _PLACE)

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words, which never span two documents."""
        solid = self.solid
        start, end = solid.copy(), solid.copy()
        start[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        edge = self.offsets[:-1][np.diff(self.offsets) > 0]
        last = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        start[edge] |= solid[edge]
        end[last] |= solid[last]
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    @cached_property
    def word_bounds(self) -> np.ndarray:
        """n + 1 positions in the list of words at which each document's words begin."""
        return np.searchsorted(self.words[0], self.offsets)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines between line feeds, and n + 1 bounds by document. An empty text is one empty line."""
        feeds = np.flatnonzero(self.data == 10)
        per_doc = np.diff(np.searchsorted(feeds, self.offsets)) + 1
        bounds = np.concatenate([[0], np.cumsum(per_doc)])
        starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
        first, last = np.zeros(bounds[-1], bool), np.zeros(bounds[-1], bool)
        first[bounds[:-1]] = True
        last[bounds[1:] - 1] = True
        starts[first], ends[last] = self.offsets[:-1], self.offsets[1:]
        starts[~first], ends[~last] = feeds + 1, feeds
        return starts, ends, bounds

    def doc_of(self, bounds: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(bounds))

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each document has."""
        return np.diff(_before(flags)[self.offsets])


def _before(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def pieces(column: pa.Array, fold: bool = False, inside: np.ndarray = _SOLID) -> Iterator[Piece]:
    """The documents of an Arrow string column in pieces of at most PIECE_BYTES, or of one document."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, raw = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = min(at + PIECE_DOCS, max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1), len(column))
        yield Piece(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], fold, inside)
        at = to


def in_pieces(batches, column: str, fold: bool = False, inside: np.ndarray = _SOLID) -> Iterator[tuple[pa.RecordBatch, Piece]]:
    """Every piece of every batch, with the rows of the batch that it covers."""
    for batch in batches:
        for piece in pieces(batch.column(column), fold, inside):
            yield batch.slice(piece.first, piece.n), piece
