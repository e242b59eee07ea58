"""Token ids of whole texts: chunks are found and looked up by numpy, and the library encodes those not met before.

A chunk is a word with the space before it, or white space, so that no token of
the tokenizers used here crosses a chunk's border; the ids of a text are those
of its chunks in a row.  A piece of a column is cut into chunks at once, every
chunk is hashed twice to 64 bits, and a worker keeps the ids of the chunks it has
met, by both hashes, in arrays of at most ``CACHE_BYTES``.  New chunks go to the
library: plain words straight to its model, others through its whole chain.  A
text with a chunk that shares just its first hash with another one is seen whole.

Texts with white space beyond ASCII, or with the string of an added token, go to
the library as they are.  A text of several ``PIECE_BYTES`` is cut between two
words, so that its length doesn't set the memory.

Defined cases: a null text is empty; an empty text has no ids but the end id;
the strings of added tokens are those tokens, as the library takes them, unless
``specials`` is off.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from marlstone.llm import spans
from marlstone.llm.spans import Piece, in_pieces

#: Most bytes of a worker's cache; it starts anew beyond them.
CACHE_BYTES = 48 << 20
#: Longer chunks (in bytes) are not kept.
CACHED_LENGTH = 64
_ENTRY_BYTES = 28
#: Punctuation that ends many words; after a letter or digit it is a token boundary of every pattern used here.
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?*%$#&")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
#: Second bytes of Latin-1's letters after 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_PLAIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: First bytes of white space beyond ASCII in UTF-8, and, as numbers, all of it.
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE = np.array([int.from_bytes(chr(i).encode(), "big") for i in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
#: Where a long text may be cut: before the space.
_CUT = re.compile(rb"[A-Za-z0-9](?= [A-Za-z])")


class ChunkEncoder:
    """Texts to ids by what a subclass has: the ids of chunks, and those of texts that must be seen whole."""

    #: Texts that differ in ASCII case or in white space have the same ids.
    folds = False
    #: Strings (in lower case) whose texts must be seen whole.
    added: tuple[bytes, ...] = ()

    def __init__(self, vocabulary: int, cache_bytes: int = CACHE_BYTES):
        self.kind = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
        self.cache_bytes = cache_bytes
        self._forget()

    def of_chunks(self, chunks: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def of_texts(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _forget(self) -> None:
        self._keys, self._seconds, self._starts, self._lengths = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._ids, self._used = np.zeros(1 << 16, self.kind), 1  # the first place is for the end id

    def _chunks(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the chunks, in order."""
        data, (starts, ends) = piece.data, piece.words
        last = ends - 1
        long = np.flatnonzero(_TAIL[data[last]] & (ends - starts > 1))
        before = last[long] - 1
        latin = (before > starts[long]) & _LATIN[data[before]] & (data[before - 1] == 0xC3)
        tails = last[long[_ALNUM[data[before]] | latin]]
        if self.folds:
            return np.sort(np.concatenate([starts, tails])), np.sort(np.concatenate([ends, tails]))
        mark = np.zeros(len(data) + 1, bool)
        mark[piece.offsets] = True
        inner = starts[~mark[starts]]
        mark[starts] = mark[ends] = mark[tails] = True
        spaced = data[inner - 1] == 32
        mark[inner[spaced]] = False
        mark[inner - 1] = True
        at = np.flatnonzero(mark[:-1])
        return at, np.append(at[1:], len(data))

    def _hashes(self, piece: Piece, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [piece.hash(starts, ends, which) for which in (0, 1)]
        if self.folds:
            high = spans._before(piece.data >= 0x80)
            wide = high[ends] > high[starts]
            if wide.any():
                plain = Piece(piece.first, piece.data, piece.offsets)
                for which in (0, 1):
                    found[which][wide] = plain.hash(starts[wide], ends[wide], which) ^ np.uint64(1)
        return found[0], found[1]

    def _odd(self, piece: Piece) -> np.ndarray:
        """Documents that the library must see whole."""
        data = piece.data
        at = np.flatnonzero(_WIDE_LEAD[data[:-1]])
        two = data[at].astype(np.int64) << 8 | data[at + 1]
        three = two << 8 | data[np.minimum(at + 2, len(data) - 1)]
        places = at[np.isin(two, _WIDE) | np.isin(three, _WIDE)].tolist()
        if self.added:
            lowered = piece.lowered.tobytes()
            for content in self.added:
                found = lowered.find(content)
                while found >= 0:
                    places.append(found)
                    found = lowered.find(content, found + 1)
        return np.unique(np.searchsorted(piece.offsets, np.array(places, np.int64), "right") - 1)

    def _learn(self, piece: Piece, keys: np.ndarray, seconds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths of the ids of new chunks. Short ones stay."""
        order = np.argsort(ends - starts > CACHED_LENGTH, kind="stable")
        data = piece.data.tobytes()
        lists = self.of_chunks([data[a:b].decode() for a, b in zip(starts[order].tolist(), ends[order].tolist(), strict=True)])
        places, lengths = self._put(lists)
        kept = int((ends - starts <= CACHED_LENGTH).sum())
        at = np.searchsorted(self._keys, keys[order[:kept]])
        by_key = np.argsort(keys[order[:kept]], kind="stable")
        for name, values in (("_keys", keys[order[:kept]]), ("_seconds", seconds[order[:kept]]), ("_starts", places[:kept]), ("_lengths", lengths[:kept].astype(np.int32))):
            setattr(self, name, np.insert(getattr(self, name), at[by_key], values[by_key]))
        self._used += int(lengths[:kept].sum())
        self._beyond -= int(lengths[:kept].sum())
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return places[back], lengths[back]

    def _put(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids stored behind those in use, until the piece is done."""
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        first, total = self._used + self._beyond, int(lengths.sum())
        if first + total > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(max(len(self._ids), total), self.kind)])
        self._ids[first : first + total] = np.fromiter(chain.from_iterable(lists), self.kind, total)
        self._beyond += total
        return first + np.cumsum(lengths) - lengths, lengths

    def _encode(self, piece: Piece, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self._keys) * _ENTRY_BYTES + self._used * self.kind.itemsize > self.cache_bytes:
            self._forget()
        self._beyond = 0
        starts, ends = self._chunks(piece)
        doc = np.searchsorted(piece.offsets, starts, "right") - 1
        key, second = self._hashes(piece, starts, ends)
        odd = self._odd(piece)
        while True:
            if len(odd):
                usual = ~np.isin(doc, odd)
                starts, ends, doc, key, second = starts[usual], ends[usual], doc[usual], key[usual], second[usual]
            distinct, first, at = np.unique(key, return_index=True, return_inverse=True)
            near = np.minimum(np.searchsorted(self._keys, distinct), max(0, len(self._keys) - 1))
            new = self._keys[near] != distinct if len(self._keys) else np.ones(len(distinct), bool)
            other = second != second[first][at]
            if len(self._keys):
                other |= (~new & (self._seconds[near] != second[first]))[at]
            if not other.any():
                break
            odd = np.union1d(odd, doc[other])
        places, lengths = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        places[~new], lengths[~new] = self._starts[near[~new]], self._lengths[near[~new]]
        if new.any():
            places[new], lengths[new] = self._learn(piece, distinct[new], second[first[new]], starts[first[new]], ends[first[new]])
        places, lengths = places[at], lengths[at]
        bounds = np.searchsorted(doc, np.arange(piece.n + 1))
        if len(odd):
            texts = [piece.data[piece.offsets[i] : piece.offsets[i + 1]].tobytes().decode() for i in odd]
            odd_places, odd_lengths = self._put(self.of_texts(texts))
            places, lengths = np.insert(places, bounds[odd], odd_places), np.insert(lengths, bounds[odd], odd_lengths)
            bounds = bounds + np.searchsorted(odd, np.arange(piece.n + 1))
        if end_id is not None:
            self._ids[0] = end_id
            places, lengths = np.insert(places, bounds[1:], 0), np.insert(lengths, bounds[1:], 1)
            bounds = bounds + np.arange(piece.n + 1)
        to = np.concatenate([[0], np.cumsum(lengths)])
        ids = self._ids[np.repeat(places - to[:-1], lengths) + np.arange(to[-1])]
        return ids, to[bounds]

    def encode(self, piece: Piece, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a piece's texts in a row, each text's with the end id if given, and n + 1 bounds."""
        if piece.n > 1 or len(piece.data) <= 2 * spans.PIECE_BYTES:
            return self._encode(piece, end_id)
        raw, cuts = piece.data.tobytes(), [0]
        while found := _CUT.search(raw, cuts[-1] + spans.PIECE_BYTES):
            cuts.append(found.end())
        parts = [self._encode(Piece(0, piece.data[a:b], np.array([0, b - a]), piece.fold), None)[0] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
        ids = np.concatenate([*parts, np.array([] if end_id is None else [end_id], self.kind)])
        return ids, np.array([0, len(ids)])

    def encoded(self, batches: Iterable[pa.RecordBatch], column: str, end_id: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Rows of the batches, a piece at a time, with their texts' ids and bounds."""
        for rows, piece in in_pieces(batches, column, fold=self.folds):
            yield rows, *self.encode(piece, end_id)


class LibraryEncoder(ChunkEncoder):
    """By a file of the tokenizers library."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES, specials: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = t = Tokenizer.from_file(path)
        t.encode_special_tokens = not specials
        super().__init__(t.get_vocab_size(), cache_bytes)
        self.added = tuple(sorted({a.content.lower().encode() for a in t.get_added_tokens_decoder().values()})) if specials else ()
        one, other = self.of_texts([" A", "a"])
        self.folds = one == other
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._shown = {i: as_bytes.pre_tokenize_str(chr(i))[0][0] for i in range(256) if _PLAIN.fullmatch(f"{chr(i)}a")}
        #: Whether the model alone gives plain words their ids.
        self.direct = True
        words = [w for w in (" Hello", "hello", "straße", " Éa", "x", "Zzyxq", " ÿÀ") if w[0] != " " or not self.folds]
        self.direct = self.of_chunks(words) == self.of_texts(words)

    def of_texts(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def of_chunks(self, chunks: list[str]) -> list[list[int]]:
        if not self.direct:
            return self.of_texts(chunks)
        tokenize, out, other = self.library.model.tokenize, [], []
        for i, chunk in enumerate(chunks):
            if _PLAIN.fullmatch(chunk):
                out.append([x.id for x in tokenize((chunk.lower() if self.folds else chunk).translate(self._shown))])
            else:
                out.append([])
                other.append(i)
        for i, ids in zip(other, self.of_texts([chunks[i] for i in other]), strict=True):
            out[i] = ids
        return out


_loaded: dict[tuple, LibraryEncoder] = {}


def library_encoder(path: str, specials: bool = True) -> LibraryEncoder:
    """One for each file and worker process."""
    if (path, specials) not in _loaded:
        _loaded[path, specials] = LibraryEncoder(path, specials=specials)
    return _loaded[path, specials]


def binaries(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The ids of each text as a binary value."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
