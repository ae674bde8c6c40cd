"""Words of many texts as arrays: places, hashes, hashes of word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from driftwarden.llm.mph import mix

ODD_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
SLICE_BYTES = 1 << 20

SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 12)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= SLICE_BYTES + (1 << 16):  # tables for one very long text are not kept
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, seed: int) -> np.ndarray:
    """64-bit hashes of values[start:end] for each pair, in time linear in all of them."""
    up, down = powers(len(values) + 1, base)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts], seed)


class Words:
    """Words of a few texts: bytes between separators, with the text each word belongs to."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACE_BYTES):
        self.raw = b"\n".join(texts)
        buf = np.frombuffer(self.raw, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], separators[buf], [True]]).view(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        # First word of each text, and one past its last.
        self.first = np.searchsorted(self.starts, begins)
        self.past = np.append(self.first[1:], len(self.starts))
        self.counts = self.past - self.first
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.buf = buf

    def hashes(self) -> np.ndarray:
        return run_hashes(self.buf.astype(np.uint64) + np.uint64(1), self.starts, self.ends, ODD_BASES[0], 11)

    def windows(self, hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
        """Hash of the k words from each place; at places where k words don't fit in the whole array, 0."""
        n = len(hashes)
        out = np.zeros(n, np.uint64)
        if n >= k:
            at = np.arange(n - k + 1)
            source = hashes if not which else mix(hashes, 77 + which)
            out[: n - k + 1] = run_hashes(source, at, at + k, ODD_BASES[1 + which], 12 + which)
        return out

    def fits(self, k: int) -> np.ndarray:
        """Places from which k words lie inside one text."""
        return np.arange(len(self.doc)) + k <= self.past[self.doc]


def running_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] (shorter at the end)."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def slices(batch: pa.RecordBatch, text: str = "text"):
    """(texts as bytes, place of the first) for runs of rows of at most SLICE_BYTES, or of one row."""
    texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= SLICE_BYTES:
            size += len(texts[to])
            to += 1
        yield texts[at:to], at
        at = to


def cut_slices(texts: list[bytes], most: int, ends: np.ndarray) -> Iterator[tuple[list[bytes], list[int]]]:
    """(texts, number of each) of about ``most`` bytes; a longer text is cut behind bytes marked in ``ends``."""
    held, numbers, size = [], [], 0
    for number, text in enumerate(texts):
        at = 0
        while at < len(text) or (not text and at == 0):
            part = text[at : at + most]
            if len(text) - at > most:
                here = np.flatnonzero(ends[np.frombuffer(part, np.uint8)])
                if len(here):
                    part = part[: here[-1] + 1]
                else:
                    later = ends[np.frombuffer(text, np.uint8, offset=at)]
                    part = text[at : at + int(later.argmax()) + 1] if later.any() else text[at:]
            at += max(len(part), 1)
            if held and size + len(part) > most:
                yield held, numbers
                held, numbers, size = [], [], 0
            held.append(part)
            numbers.append(number)
            size += len(part)
    if held:
        yield held, numbers
