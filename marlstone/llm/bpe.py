"""Byte-level BPE by a rank table: whole pre-tokens by a minimal perfect hash, the rest by merging.

First tier: the table's entries are numbered by a minimal perfect hash; a
pre-token whose entry has the same bytes is one token.  Second tier: the
remaining pre-tokens are linked lists of bytes, and a heap of adjacent pairs
joins the pair of least rank, leftmost first, until no pair is in the table.

Texts are cut into chunks, and ids of chunks met before are kept, as in
``tokens``; a long text is cut between two words.

Defined cases: a null or empty text has no ids and decodes to nothing; strings
of special tokens are ordinary text; an id outside the table raises KeyError;
null ids and repeated rows keep their rows; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import tokens
from marlstone.llm.mph import MinimalPerfectHash
from marlstone.llm.spans import Piece


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _hashes(items: list[bytes]) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)
    piece = Piece(0, np.frombuffer(b"".join(items), np.uint8), ends)
    return piece.hash(ends[:-1], ends[1:])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token by repeated joining."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, i, end = heapq.heappop(heap)
        if gone[i] or after[i] >= n or after[after[i]] != end:
            continue
        gone[after[i]] = 1
        after[i] = end
        before[end] = i
        if end < n and (r := ranks.get(piece[i : after[end]])) is not None:
            heapq.heappush(heap, (r, i, after[end]))
        left = before[i]
        if left >= 0 and (r := ranks.get(piece[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class ByteBPE(tokens.ChunkEncoder):
    """Encoder and decoder of one rank table and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_bytes: int = tokens.CACHE_BYTES):
        import regex

        super().__init__(max(ranks.values(), default=0) + 1, cache_bytes)
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.table = {i: token for token, i in ranks.items()}
        items = list(ranks)
        hashes = _hashes(items)
        self.hash = MinimalPerfectHash.build(hashes)
        at = self.hash.lookup(hashes)
        self.entry: list[bytes] = [b""] * len(items)
        self.id_at = np.zeros(len(items), np.int64)
        for k, item in zip(at, items, strict=True):
            self.entry[k], self.id_at[k] = item, ranks[item]

    def _resolve(self, new: list[str]) -> Iterator[list[int]]:
        raw = [x.encode() for x in new]
        for item, k in zip(raw, self.hash.lookup(_hashes(raw)).tolist(), strict=True):
            yield [int(self.id_at[k])] if k >= 0 and self.entry[k] == item else merge(item, self.ranks)

    def of_chunks(self, chunks: list[str]) -> list[list[int]]:
        split = [self.pattern.findall(c) for c in chunks]
        new = list(set().union(*split))
        known = dict(zip(new, self._resolve(new), strict=True))
        return [known[parts[0]] if len(parts) == 1 else [i for p in parts for i in known[p]] for parts in split]

    of_texts = of_chunks

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


_loaded: dict[tuple[str, str], ByteBPE] = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """One for each table and worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return _loaded[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): token ids of each text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows, ids, bounds in codec(path, pattern).encoded(batches, "__text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))], [id_col, "ids"])

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decoded(ids: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded): the bytes that the ids stand for."""
    kind = ids.schema[id_col].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        decimal = [str(i) for i in range(max(bpe.table) + 1)]
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            n, digests, raw = [], [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                some = flat[a:b].tolist()
                n.append(len(some))
                digests.append(hashlib.sha256(",".join(map(decimal.__getitem__, some)).encode()).hexdigest())
                raw.append(bpe.decode(some))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(raw, pa.binary())], [id_col, "n_tokens", "ids_sha256", "decoded"])

    return ids.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded binary")
