"""FM-index over a shard of words.

The shard is one array of symbols: the documents' words as numbers, 0 between them. Its suffixes are
sorted by doubling; the Burrows-Wheeler transform lies in a wavelet matrix whose ranks drive
backward search; every ``SAMPLE``-th place of the text keeps its suffix position, from which the
other places follow by stepping back. All phrases of one length are searched at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text``; a shorter suffix comes before a longer one it begins."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    todo = np.arange(n)  # places in the order that are not told apart yet
    step = 1
    first = np.ones(n, bool)  # where a new rank begins
    first[1:] = rank[order][1:] != rank[order][:-1]
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = starts
    while True:
        # Only places that share a rank with a neighbour need another look.
        tied = np.zeros(n, bool)
        tied[1:] |= ~first[1:]
        tied[:-1] |= ~first[1:]
        todo = np.flatnonzero(tied)
        if not len(todo):
            return order
        at = order[todo]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        inside = np.lexsort((after, rank[at]))
        order[todo] = at[inside]
        now, key = rank[at][inside], after[inside]
        new = np.ones(len(todo), bool)
        new[1:] = (now[1:] != now[:-1]) | (key[1:] != key[:-1])
        first[todo] = new
        starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[order[todo]] = starts[todo]
        step *= 2


class WaveletMatrix:
    """Ranks over a sequence of symbols below ``2 ** bits``, one bit plane per bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.planes = []
        for b in reversed(range(bits)):
            on = (symbols >> b) & 1 == 1
            padded = np.zeros(-(-(len(on) + 1) // 64) * 64, bool)
            padded[: len(on)] = on
            words = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.planes.append((b, words, np.cumsum(ones) - ones, int(len(on) - on.sum())))
            symbols = np.concatenate([symbols[~on], symbols[on]])

    @staticmethod
    def _ones(plane, at: np.ndarray) -> np.ndarray:
        _, words, before, _ = plane
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place that goes with it."""
        low = np.zeros(len(at), np.int64)
        for plane in self.planes:
            b, _, _, zeros = plane
            high = (symbol >> b) & 1 == 1
            ones_at, ones_low = self._ones(plane, at), self._ones(plane, low)
            at = np.where(high, zeros + ones_at, at - ones_at)
            low = np.where(high, zeros + ones_low, low - ones_low)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at these places."""
        out = np.zeros(len(at), np.int64)
        for plane in self.planes:
            b, words, _, zeros = plane
            on = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            out |= on.astype(np.int64) << b
            ones = self._ones(plane, at)
            at = np.where(on, zeros + ones, at - ones)
        return out


class FMIndex:
    def __init__(self, text: np.ndarray):
        """``text``: symbols, 0 between documents. An end mark below all symbols is added."""
        whole = np.concatenate([text.astype(np.int64) + 1, [0]])
        order = suffix_array(whole)
        top = int(whole.max())
        self.size = len(whole)
        self.bwt = WaveletMatrix(whole[order - 1], max(1, top.bit_length()))
        counts = np.bincount(whole, minlength=top + 2)
        self.below = np.cumsum(counts) - counts  # symbols smaller than each one
        marked = order % SAMPLE == 0
        self.marked = marked
        self.before = np.cumsum(marked) - marked
        self.samples = order[marked]
        self.top = top

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of the rows of ``phrases``, all of one length."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            symbol = phrases[open_, column].astype(np.int64) + 1
            known = symbol <= self.top
            safe = np.where(known, symbol, 0)
            new_low = self.below[safe] + self.bwt.rank(safe, low[open_])
            new_high = self.below[safe] + self.bwt.rank(safe, high[open_])
            low[open_] = new_low
            high[open_] = np.where(known, new_high, new_low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of these rows of the suffix order."""
        out, steps, left, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(left):
            found = self.marked[at]
            out[left[found]] = self.samples[self.before[at[found]]] + steps
            left, at = left[~found], at[~found]
            symbol = self.bwt.access(at)
            at = self.below[symbol] + self.bwt.rank(symbol, at)
            steps += 1
        return out
