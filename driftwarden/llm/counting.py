"""Token counts that follow edits.

A document's text is cut into segments of some hundred characters at places where no pre-token reaches over.
A binary tree per document keeps the characters and tokens of every segment and the sums above
them. An edit is looked up by the sums; the segments it touches, and neighbours as long as the
border between them is no such place any more, are encoded anew, and the sums on their way to the
root are brought up to date. All other segments keep their counts. A segment that has grown past
LEAF_CHARS is split; the sums are then added up over one more leaf, without encoding anything else.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.llm.common import fresh, map_batches
from driftwarden.llm.encode import Encoder, encoder

SEGMENT_CHARS = 256
# A segment may grow to this length by edits before it is split (where it can be cut at all).
LEAF_CHARS = 2 * SEGMENT_CHARS
CUT = re.compile(r"(?<=[^\s\x00-\x20]) (?=[^\s\x00-\x20])")


def segments(text: str, size: int = SEGMENT_CHARS) -> list[str]:
    """The text in pieces of at least ``size`` characters, cut where pre-tokens end in any case."""
    out, at = [], 0
    while at < len(text):
        found = CUT.search(text, at + size)
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


def is_cut(text: str, at: int) -> bool:
    return at in (0, len(text)) or CUT.match(text, at) is not None


class Tree:
    """Sums of characters and tokens over segments, root at 1, leaves from ``room`` on."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens
        self.room = len(chars) // 2

    @classmethod
    def build(cls, chars: list[int] | np.ndarray, tokens: list[int] | np.ndarray) -> Tree:
        room = 1 << max(0, len(chars) - 1).bit_length()
        sums = []
        for leaves in (chars, tokens):
            a = np.zeros(2 * room, np.int64)
            a[room : room + len(leaves)] = leaves
            width = room
            while width > 1:
                a[width // 2 : width] = a[width : 2 * width : 2] + a[width + 1 : 2 * width : 2]
                width //= 2
            sums.append(a)
        return cls(*sums)

    def find(self, at: int) -> tuple[int, int]:
        """The segment that holds character ``at`` (the last one for the end), and where it starts."""
        node, before = 1, 0
        while node < self.room:
            node *= 2
            if at - before >= self.chars[node] and self.chars[node + 1] > 0:
                before += int(self.chars[node])
                node += 1
        return node - self.room, before

    def put(self, segment: int, chars: int, tokens: int) -> None:
        node = self.room + segment
        d_chars, d_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += d_chars
            self.tokens[node] += d_tokens
            node //= 2

    def spliced(self, first: int, last: int, chars: list[int], tokens: list[int]) -> Tree:
        """A tree with other leaves in place of ``first`` to ``last``; emptied leaves are left out."""
        old = slice(self.room, self.room + first), slice(self.room + last + 1, 2 * self.room)
        sizes = np.concatenate([self.chars[old[0]], chars, self.chars[old[1]]])
        held = np.concatenate([self.tokens[old[0]], tokens, self.tokens[old[1]]])
        return Tree.build(sizes[sizes > 0], held[sizes > 0])

    def size(self, segment: int) -> int:
        return int(self.chars[self.room + segment])


def counts(encode: Encoder, texts: list[str]) -> list[int]:
    return [len(x) for x in encode.encode(pa.array(texts, pa.string()))]


def build_trees(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and: seg_chars, seg_tokens (the tree, as little-endian 64-bit numbers), n_tokens.

    A null text counts as empty and stays null. Null and repeated ids don't matter: the tree goes with
    its row. Columns of any other name are kept; an empty table stays empty.
    """
    new = ("seg_chars", "seg_tokens", "n_tokens")
    names = [c for c in docs.columns if c not in new]
    (cut_from,) = fresh(docs.columns, "cut_from")
    rows = docs.select(*names, F.col(text).alias(cut_from))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut = [segments(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
        flat = counts(encoder(vocabulary), [s for pieces in cut for s in pieces])
        trees, at = [], 0
        for pieces in cut:
            trees.append(Tree.build([len(s) for s in pieces], flat[at : at + len(pieces)]))
            at += len(pieces)
        added = [
            pa.array([t.chars.astype("<i8").tobytes() for t in trees], pa.binary()),
            pa.array([t.tokens.astype("<i8").tobytes() for t in trees], pa.binary()),
            pa.array([int(t.tokens[1]) for t in trees], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*names, *new])

    fields = [T.StructField("seg_chars", T.BinaryType()), T.StructField("seg_tokens", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    return map_batches(rows, run, T.StructType([*rows.drop(cut_from).schema.fields, *fields]))


class Edited:
    """A document while its edits are applied."""

    def __init__(self, text: str, chars: bytes, tokens: bytes):
        self.text, self.encoded = text, 0
        self.tree = Tree(np.frombuffer(chars, "<i8").copy(), np.frombuffer(tokens, "<i8").copy())

    def edit(self, start: int, end: int, put: str) -> tuple[int, int, str]:
        """Change the text; the touched segments (first, last) and their text now."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        tree = self.tree
        first, begin = tree.find(start)
        last, at = tree.find(max(start, end - 1))
        stop = at + tree.size(last) + len(put) - (end - start)
        self.text = self.text[:start] + put + self.text[end:]
        while not is_cut(self.text, begin):
            first -= 1
            begin -= tree.size(first)
        while not is_cut(self.text, stop):
            last += 1
            stop += tree.size(last)
        return first, last, self.text[begin:stop]

    def recount(self, first: int, last: int, pieces: list[str], tokens: list[int]) -> None:
        sizes = [len(p) for p in pieces]
        self.encoded += sum(sizes)
        spare = last - first + 1 - len(pieces)
        if spare < 0:
            self.tree = self.tree.spliced(first, last, sizes, tokens)
            return
        for k, (size, held) in enumerate(zip(sizes + [0] * spare, tokens + [0] * spare), first):
            self.tree.put(k, size, held)


def fitted(region: str, slots: int) -> list[str]:
    """The region in pieces: as many as there are segments for it, more if the last one would grow past LEAF_CHARS."""
    pieces = segments(region)
    if len(pieces) <= slots or sum(map(len, pieces[slots - 1 :])) > LEAF_CHARS:
        return pieces
    return [*pieces[: slots - 1], "".join(pieces[slots - 1 :])]


def apply_edits(trees: DataFrame, vocabulary: str, edits: str = "edits", text: str = "text") -> DataFrame:
    """All columns of ``trees`` but the edits, with text, tree and n_tokens after them, and n_encoded: the
    characters that were encoded again.

    ``edits`` is an array of (start, end, put): characters [start, end) are replaced by ``put``, one edit
    after another, each on the text that the earlier ones left; places beyond the text are moved to its end. A null array,
    or null members of an edit, change nothing, nor does a null start; a null ``put`` deletes.
    A null text counts as empty; it becomes a text by its first edit.
    """
    names = [c for c in trees.columns if c not in (edits, "n_encoded")]
    (todo_of,) = fresh(trees.columns, "todo")
    rows = trees.select(*names, F.col(edits).alias(todo_of))
    place = {c: names.index(c) for c in (text, "seg_chars", "seg_tokens", "n_tokens")}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column(place[text]).to_pylist()
        columns = (batch.column(place[c]).to_pylist() for c in ("seg_chars", "seg_tokens"))
        docs = [Edited(t or "", c, k) for t, c, k in zip(old, *columns)]
        todo = [[e for e in es or [] if e and e["start"] is not None] for es in batch.column(batch.num_columns - 1).to_pylist()]
        # One edit of every document at a time, so that their regions are encoded together.
        for turn in range(max(map(len, todo))):
            open_ = [i for i, es in enumerate(todo) if len(es) > turn]
            touched = []
            for i in open_:
                e = todo[i][turn]
                first, last, region = docs[i].edit(e["start"], e["end"] if e["end"] is not None else e["start"], e["put"] or "")
                touched.append((first, last, fitted(region, last - first + 1)))
            flat = counts(encoder(vocabulary), [s for _, _, pieces in touched for s in pieces])
            at = 0
            for i, (first, last, pieces) in zip(open_, touched):
                docs[i].recount(first, last, pieces, flat[at : at + len(pieces)])
                at += len(pieces)
        out = list(batch.columns[:-1])
        out[place[text]] = pa.array([d.text if es or t is not None else None for d, es, t in zip(docs, todo, old)], pa.string())
        out[place["seg_chars"]] = pa.array([d.tree.chars.tobytes() for d in docs], pa.binary())
        out[place["seg_tokens"]] = pa.array([d.tree.tokens.tobytes() for d in docs], pa.binary())
        out[place["n_tokens"]] = pa.array([int(d.tree.tokens[1]) for d in docs], pa.int64())
        return pa.RecordBatch.from_arrays([*out, pa.array([d.encoded for d in docs], pa.int64())], names=[*names, "n_encoded"])

    fields = [*rows.drop(todo_of).schema.fields, T.StructField("n_encoded", T.LongType())]
    return map_batches(rows, run, T.StructType(fields))
