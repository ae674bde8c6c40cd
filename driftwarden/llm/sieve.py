"""Which 64-bit hashes may be in a large set: a Bloom filter of bounded size, one slice per part of the hash space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.mph import mix

# Bits per hash, and in all at most (32 MB); a set too large for that lets more strangers pass, but none of its own is lost.
BITS_PER_HASH = 16
MOST_BITS = 1 << 28
SLICE_BITS = 1 << 20


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Sieve:
    """Two bits per hash, in the slice of its part."""

    def __init__(self, parts: int, slice_bits: int, bits: np.ndarray):
        self.parts, self.slice_bits, self.bits = parts, slice_bits, bits

    def places(self, hashes: np.ndarray, which: int) -> np.ndarray:
        inside = mix(hashes, 61 + which) % np.uint64(self.slice_bits)
        return part_of(hashes, self.parts) * self.slice_bits + inside.astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for which in (0, 1):
            at = self.places(hashes, which)
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out

    def slice_of(self, part: int, hashes: np.ndarray) -> bytes:
        """The filled slice of a part from the hashes that lie in it."""
        bits = np.zeros(self.slice_bits, bool)
        for which in (0, 1):
            bits[self.places(hashes, which) - part * self.slice_bits] = True
        return np.packbits(bits, bitorder="little").tobytes()


def shape(count: int, parts: int, bits_per_hash: int, most_bits: int) -> Sieve:
    """An empty sieve for ``count`` hashes, without its bits."""
    bits = min(most_bits, max(1 << 10, count * bits_per_hash))
    return Sieve(parts, -(-bits // parts // 8) * 8, np.zeros(0, np.uint8))


def filled(empty: Sieve, slices: DataFrame) -> Sieve:
    """The sieve whose slices are the rows (part, bits): at most ``MOST_BITS``, whatever the input."""
    whole, size = np.zeros(empty.parts * empty.slice_bits // 8, np.uint8), empty.slice_bits // 8
    for row in slices.toLocalIterator():
        whole[row.part * size : (row.part + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return Sieve(empty.parts, empty.slice_bits, whole)


def sieve_of(stored: DataFrame, column: str, bits_per_hash: int = BITS_PER_HASH, most_bits: int = MOST_BITS) -> Sieve:
    """A sieve of a stored table's long column, which holds even 64-bit hashes."""
    count = stored.count()
    parts = max(1, -(-min(most_bits, count * bits_per_hash) // SLICE_BITS))
    empty = shape(count, parts, bits_per_hash, most_bits)
    upper = F.shiftrightunsigned(F.col(column), 32)
    dealt = stored.select(F.shiftright(upper * parts, 32).cast("int").alias("part"), F.col(column).alias("hash"))

    def fill(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        return pa.table({"part": pa.array([part], pa.int32()), "bits": [empty.slice_of(part, rows.column("hash").to_numpy().view(np.uint64))]})

    # A group holds the hashes of one slice: SLICE_BITS / BITS_PER_HASH of them, or more where MOST_BITS is reached.
    return filled(empty, dealt.groupBy("part").applyInArrow(fill, "part int, bits binary"))
