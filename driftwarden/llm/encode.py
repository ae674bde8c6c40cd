"""Encoding of whole texts with a public tokenizer, fast for text whose words repeat.

Both vocabularies split a text into pre-tokens before any merge, and a pre-token never reaches over
a single space between two visible characters, over a single line break, or from a letter or digit
to a full stop or comma. Cutting there and encoding the pieces gives the ids of the whole text.
Pieces repeat, so each worker keeps the ids of pieces it has met; only new ones go to the
tokenizer, many in one call. Where ids spell their text byte by byte, words with their leading space go one behind the
other and the ids' lengths in bytes tell them apart; else a mark stands between. A text with other white space is cut at single spaces alone.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pieces kept by one worker (about 150 MB); beyond it the memory starts anew.
KEPT_PIECES = 600_000
SLICE_BYTES = 2 << 20
GROUP = 64

# White space other than lone spaces and line breaks before something visible, and the two marks used here.
ODD = (
    r"[\x00\x01\x09\x0B-\x0D\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}"
    r"\x{205F}-\x{2064}\x{3000}\x{FEFF}]|[ \n][ \n]|[ \n]\z"
)
SAFE_CUT = re.compile(r"(?<=[^\s\x00-\x20])(?= [^\s\x00-\x20])")
SEPARATOR = "\n\x01\n"


class Encoder:
    """Ids of texts by ``tokenizers`` with ``add_special_tokens=False``.

    As there, a special token's string in a text gives that token's id. No cut falls inside such a string: they
    hold no white space, full stop or comma.
    """

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept = kept
        one = self._plain("a")
        both = self._plain(f"a{SEPARATOR}a")
        self.between = both[len(one) : len(both) - len(one)]
        marks = [i for i in self.between if i not in self._plain("a\n\na")]
        self.mark = marks[0] if len(marks) == 1 else None
        self.bytes = self._id_bytes()
        self._reset()

    def _id_bytes(self) -> np.ndarray | None:
        """How many bytes of text each id stands for; None if the vocabulary changes texts or does not split them by bytes."""
        from tokenizers import pre_tokenizers

        split = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is not None or not isinstance(split, pre_tokenizers.ByteLevel) or split.add_prefix_space or not split.use_regex:
            return None
        added = self.tokenizer.get_added_tokens_decoder()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        sizes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, i in vocab.items():
            # A byte of a token is a character of its name; added tokens are named by their text.
            sizes[i] = len(token.encode()) if i in added else len(token)
        return sizes

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.start = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def _append(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m, end = len(self.place), len(pieces), self.used + len(ids)
        if n + m > len(self.start):
            more = np.zeros(max(m, n), np.int64)
            self.start, self.length = np.concatenate([self.start, more]), np.concatenate([self.length, more])
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(ids), len(self.flat)), np.uint32)])
        self.place.update(zip(pieces, range(n, n + m)))
        self.start[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + m] = lengths
        self.flat[self.used : end] = ids
        self.used = end

    def _learn_rows(self, pieces: list[str]) -> bool:
        """Encode words that begin with a space, one behind the other; False if an id reaches over a word's end."""
        rows = ["".join(pieces[i : i + GROUP]) for i in range(0, len(pieces), GROUP)]
        encoded = self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in encoded), np.uint32)
        ends = np.cumsum(self.bytes[ids])
        wanted = np.cumsum(np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)))
        last = np.searchsorted(ends, wanted)
        if not len(ends) or ends[-1] != wanted[-1] or (ends[last] != wanted).any():
            return False
        self._append(pieces, ids, np.diff(last, prepend=-1))
        return True

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces, many in one call, where need be with a mark between them."""
        alone, joint = [], []
        if self.bytes is not None:
            # The cut between two such words is one that no pre-token reaches over.
            rows = [p for p in pieces if p[:1] == " " < p[1:2] and " " < p[-1] and not p[1].isspace() and not p[-1].isspace()]
            if rows and self._learn_rows(rows):
                pieces = [p for p in pieces if p not in self.place]
        for p in pieces:
            # White space at either end would meet the line break of the mark; a space before a word does not.
            word = p[1:] if p[:1] == " " else p
            lonely = self.mark is None or "\x01" in p or not word or word[0] <= " " or word[0].isspace() or p[-1].isspace()
            (alone if lonely else joint).append(p)
        groups = [joint[i : i + GROUP] for i in range(0, len(joint), GROUP)]
        encoded = self.tokenizer.encode_batch_fast([SEPARATOR.join(g) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, encoded):
            ids = np.array(encoding.ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(group) - 1:
                alone += group
                continue
            before = self.between.index(self.mark)
            after = len(self.between) - before
            starts = np.concatenate([[0], marks + after])
            ends = np.concatenate([marks - before, [len(ids)]])
            keep = np.ones(len(ids), bool)
            for shift in range(-before, after):
                keep[marks + shift] = False
            self._append(group, ids[keep], ends - starts)
        for piece in alone:
            ids = np.array(self._plain(piece), np.uint32)
            self._append([piece], ids, np.array([len(ids)]))

    def _pieces_to_ids(self, lists: pa.ListArray) -> list[np.ndarray]:
        units = lists.flatten().dictionary_encode()
        words = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [w for w in words if w not in self.place]
        if len(self.place) + len(fresh) > self.kept:
            self._reset()
            fresh = words
        if fresh:
            self._learn(fresh)
        slots = np.fromiter((self.place[w] for w in words), np.int64, len(words))[units.indices.to_numpy()]
        starts, lengths = self.start[slots], self.length[slots]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        odd = pc.match_substring_regex(texts, ODD)
        out: list[np.ndarray | None] = [None] * len(texts)
        where = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        if len(where):
            plain = texts.filter(pc.invert(odd))
            cut = pc.replace_substring(pc.replace_substring(plain, " ", "\x00 "), "\n", "\x00\n\x00")
            cut = pc.replace_substring_regex(cut, r"([0-9A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{00FF}])([.,])", "\\1\x00\\2")
            for i, ids in zip(where, self._pieces_to_ids(pc.split_pattern(cut, "\x00"))):
                out[i] = ids
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(where):
            pieces = [SAFE_CUT.split(t) for t in texts.filter(odd).to_pylist()]
            for i, ids in zip(where, self._pieces_to_ids(pa.array(pieces, pa.list_(pa.string())))):
                out[i] = ids
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """One id array per text (null: empty), a few MB of text at a time."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        out, at = [], 0
        while at < len(texts):
            base = int(sizes[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, "right")))
            out += self._slice(texts.slice(at, to - at))
            at = to
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
