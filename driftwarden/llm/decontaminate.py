"""Finding benchmark passages in training documents.

The benchmark's windows are the phrases. Each task cuts its documents into shards, builds an FM-index per
shard, searches all phrases in it, and marks the words they cover. Words that no phrase has
cannot lie in an occurrence, so only runs of known words as long as the shortest phrase are
indexed. Phrases are a stated query set: they go to the tasks in blocks of bounded size, each
block against all documents, and the hits of the blocks are joined per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.common import map_batches, row_key
from driftwarden.llm.fm_index import FMIndex
from driftwarden.llm.words import SLICE_BYTES

WINDOW = 13
# Words of benchmark items that go to the tasks at once (some 100 MB in a worker).
BLOCK_WORDS = 500_000
SHARD_WORDS = 400_000

# Lower case for A-Z; every byte that is no digit, letter or part of a longer character separates words.
FOLD = bytes(
    (c | 0x20) if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def fold_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Phrases:
    """Distinct windows of a block of items, with numbers for words, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in fold_words(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + window]), set()).add(item)
        self.owners = list(owners.values())
        by_length: dict[int, list[int]] = {}
        phrases = list(owners)
        for i, p in enumerate(phrases):
            by_length.setdefault(len(p), []).append(i)
        self.groups = [(np.array(i), np.array([phrases[k] for k in i], np.int64)) for i in by_length.values()]
        self.shortest = min(by_length, default=0)

    def occurrences(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, phrase) of every occurrence in an array of word numbers, 0 for unknown words."""
        known = np.concatenate([[False], symbols > 0, [False]])
        edges = np.flatnonzero(np.diff(known.view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        starts, sizes = starts[long], (ends - starts)[long]
        if not len(starts):
            return (np.empty(0, np.int64),) * 3
        # The runs one after another with a 0 behind each, and where each word came from.
        room = sizes + 1
        offset = np.cumsum(room) - room
        origin = np.repeat(starts - offset, room) + np.arange(room.sum())
        text = symbols[np.minimum(origin, len(symbols) - 1)]
        text[offset + sizes] = 0
        index = FMIndex(text)
        out = []
        for numbers, phrases in self.groups:
            low, high = index.search(phrases)
            count = np.maximum(high - low, 0)
            total = int(count.sum())
            if total:
                base = np.cumsum(count) - count
                rows = np.repeat(low - base, count) + np.arange(total)
                place = origin[index.locate(rows)]
                out.append((place, np.full(total, phrases.shape[1]), np.repeat(numbers, count)))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = "key {kind}, rk long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def block_hits(docs: DataFrame, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    """(key, rk, n_words, spans, items) for every row of (key, rk, text): hits of one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    made: list[Phrases] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Phrases(shared.value, window))
        phrases = made[0]
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        number = phrases.vocabulary.get
        found: list[tuple[list, set]] = []
        counts: list[int] = []

        def search(shard: list[np.ndarray]) -> None:
            sizes = np.array([len(s) + 1 for s in shard])
            begin = np.cumsum(sizes) - sizes
            symbols = np.zeros(int(sizes.sum()), np.int64)
            for at, s in zip(begin.tolist(), shard):
                symbols[at : at + len(s)] = s
            place, length, which = phrases.occurrences(symbols)
            doc = np.searchsorted(begin, place, "right") - 1
            order = np.argsort(doc, kind="stable")
            bounds = np.searchsorted(doc[order], np.arange(len(shard) + 1))
            for i in range(len(shard)):
                rows = order[bounds[i] : bounds[i + 1]]
                start = place[rows] - begin[i]
                names = set().union(*(phrases.owners[w] for w in set(which[rows].tolist())))
                found.append((merge(start, start + length[rows]), names))

        shard: list[np.ndarray] = []
        held = 0
        for text in texts:
            words = fold_words(text or b"")
            counts.append(len(words))
            shard.append(np.fromiter(map(number, words, repeat(0)), np.int64, len(words)))
            held += len(words)
            if held >= SHARD_WORDS:
                search(shard)
                shard, held = [], 0
        if shard:
            search(shard)
        spans = [[{"start": a, "end": b} for a, b in s] for s, _ in found]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                batch.column("rk"),
                pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([sorted(n) for _, n in found], pa.list_(pa.string())),
            ],
            names=["key", "rk", "n_words", "spans", "items"],
        )

    return map_batches(docs, run, SPANS.format(kind=docs.schema["key"].dataType.simpleString()))


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of at most BLOCK_WORDS words, or one item each, read one partition at a time."""
    block: list[tuple[str, bytes]] = []
    held = 0
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).filter("t is not null")
    for row in rows.toLocalIterator():
        raw = row.t.encode()
        size = len(fold_words(raw))
        if block and held + size > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((row.i if row.i is not None else "", raw))
        held += size
    yield block


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
) -> DataFrame:
    """Per row of ``docs``: key, rk (hash of the text), n_words, n_hit, spans (merged, in words), items.

    A phrase is ``window`` consecutive words of an item, or the whole item if it has fewer, but some;
    an item of fewer words than that, with none, has no phrase. Words are runs of digits, letters and
    non-ASCII characters, A-Z lowered. ``items`` are the ids, sorted as strings, of the items with a
    phrase in the text; a null id counts as the empty string, repeated items count once per id.
    A null text has no words. Null and repeated keys keep their rows. An empty benchmark hits nothing;
    an empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), row_key(text).alias("rk"), F.col(text).alias("text"))
    parts = [block_hits(rows, b, window) for b in blocks(benchmark, item, text)]
    found = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            found = found.unionByName(part)
        # A text's spans from several blocks meet in one row, then overlap-free again.
        found = found.groupBy("key", "rk").agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_set("spans")).alias("spans"),
            F.flatten(F.collect_set("items")).alias("items"),
        )
        found = found.withColumns({"spans": merged_spans("spans"), "items": F.array_sort(F.array_distinct("items"))})
        copies = rows.groupBy("key", "rk").agg(F.count(F.lit(1)).alias("copies"))
        same = F.col("l.key").eqNullSafe(F.col("r.key")) & (F.col("l.rk") == F.col("r.rk"))
        found = (
            found.alias("l")
            .join(copies.alias("r"), same)
            .select("l.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
            .drop("copy")
        )
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(F.col("key").alias(key), "rk", "n_words", hit.alias("n_hit"), "spans", "items")


def merged_spans(name: str):
    """Column: union of the spans of an array, in order."""
    kind = "array<struct<start:bigint,end:bigint>>"
    return F.aggregate(
        F.array_sort(name),
        F.array().cast(kind),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )


def contaminated():
    """The rule for a row of ``find_items``: one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
