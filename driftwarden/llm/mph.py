"""Minimal perfect hash of 64-bit keys, as numpy arrays.

Keys are hashed into a bit table of ``GAMMA`` bits per key; a key alone on its bit keeps it, the rest
go on to a smaller table with another seed. The slot of a key is the number of set bits before its
own, so n keys get the slots 0..n-1 and a lookup reads one word per level. A stored fingerprint
tells a known key from a stranger.
"""

from __future__ import annotations

import numpy as np

GAMMA = 1.6
ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("ordinal", "<u8"), ("copies", "<u4"), ("runs", "<u4")])


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h, 1000) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        """``levels``: the bit table of each level as 64-bit words."""
        self.levels = levels
        self.ranks, total = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct unsigned 64-bit numbers."""
        levels, left = [], keys
        while len(left):
            words = -(-int(GAMMA * len(left) + 1) // 64)
            at = mix(left, len(levels)) % np.uint64(words * 64)
            alone = np.bincount(at.astype(np.int64), minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot per key; -1 where no level holds it. A strange key may get some slot."""
        out = np.full(len(keys), -1, np.int64)
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            open_ = np.flatnonzero(out < 0)
            if not len(open_):
                break
            at = mix(keys[open_], level) % np.uint64(len(words) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (ranks[word] + below)[hit]
        return out


def index_bytes(keys: np.ndarray, entries: np.ndarray) -> bytes:
    """One bucket of the index: number of levels, their word counts, the words, then one entry per slot."""
    table = PerfectHash.build(keys)
    placed = np.zeros(table.size, ENTRY)
    placed[table.slots(keys)] = entries
    placed["print"][table.slots(keys)] = fingerprint(keys)
    head = np.array([len(table.levels), *[len(w) for w in table.levels]], "<u8")
    return b"".join([head.tobytes(), *[w.tobytes() for w in table.levels], placed.tobytes()])


class Bucket:
    """A bucket of the index read back."""

    def __init__(self, raw: bytes):
        n = int(np.frombuffer(raw, "<u8", 1)[0])
        sizes = np.frombuffer(raw, "<u8", n, 8).tolist()
        at, levels = 8 * (n + 1), []
        for size in sizes:
            levels.append(np.frombuffer(raw, "<u8", size, at))
            at += 8 * size
        self.table = PerfectHash(levels)
        self.entries = np.frombuffer(raw, ENTRY, self.table.size, at)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the index, and the entries of those."""
        slots = self.table.slots(keys)
        known = slots >= 0
        known[known] = self.entries["print"][slots[known]] == fingerprint(keys[known])
        return known, self.entries[slots[known]]
