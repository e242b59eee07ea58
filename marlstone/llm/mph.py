"""Minimal perfect hashing of 64-bit keys by cascading bit arrays, in numpy.

Each level hashes the keys that are left into twice as many bits; a key alone
at its bit stays there, the others go to the next level.  A key's number is
the rank of its bit over all levels, so n distinct keys get 0 to n - 1.  A
key that was not in the set gets -1 or some key's number: callers compare a
fingerprint kept at that number.
"""

from __future__ import annotations

import struct

import numpy as np

from marlstone.llm.spans import mix

_SPREAD = 2


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


class MinimalPerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.concatenate([[0], np.cumsum(bits)]) for bits in levels]
        self.ranks, total = [], 0
        for c in counts:
            self.ranks.append((c[:-1] + total).astype(np.int64))
            total += int(c[-1])
        self.n = total

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """keys: distinct 64-bit integers."""
        levels: list[np.ndarray] = []
        left = np.asarray(keys, np.uint64)
        while len(left):
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
            size = max(64, _SPREAD * len(left))
            slot = _slot(left, len(levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[slot]]
        return cls(levels)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            slot = _slot(keys[left], level, len(bits))
            hit = bits[slot]
            out[left[hit]] = ranks[slot[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(b)) for b in self.levels)
        return head + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> MinimalPerfectHash:
        (n,) = struct.unpack_from("<I", raw)
        sizes = struct.unpack_from(f"<{n}Q", raw, 4)
        at, levels = 4 + 8 * n, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(levels)
