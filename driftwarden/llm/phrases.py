"""Collocations: phrases whose words stand together more often than their parts would by chance.

1. Level by level (one word, two words, ...), each task counts the phrases of its texts by 64-bit hash and
   sends them as summaries, one per part of the hash space.
2. The summaries of a part are merged as Misra-Gries summaries: beyond the capacity, the largest count left
   outside is taken off all counters and the empty ones go. The capacity exceeds the part's mass divided by
   the threshold, so what is taken off in all stays below the threshold and every frequent phrase survives.
3. A phrase can only be frequent if the shorter ones inside it are; a filter of a level's survivors keeps
   the others out of the next level. Its size is bounded; where it is too small, more phrases pass.
4. A last pass counts what passes the filters exactly, by language and words, and the counts are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.llm.common import small_batches, stored, top_rows
from driftwarden.llm.mph import mix
from driftwarden.llm.sieve import Sieve, filled, part_of, shape
from driftwarden.llm.words import Words, cut_slices

# Bytes of text per part of the hash space, and the most parts there are.
PART_BYTES = 8 << 20
MOST_PARTS = 1 << 16
# Phrases that a task holds before it sends a summary, and counters that it holds in the exact count.
HELD = 1_000_000
HELD_PHRASES = 100_000
# Bytes of text that are cut into words together.
TOGETHER_BYTES = 512 << 10
# Bits of a level's filter per survivor, and in all at most (32 MB).
FILTER_BITS = 16
FILTER_MOST = 1 << 28

PIECE_BYTES = np.zeros(256, bool)
PIECE_BYTES[list(b".,;:!?\n\x0b\x0c\r")] = True
WORD_BYTES = PIECE_BYTES.copy()
WORD_BYTES[list(b" \t")] = True
LOWER = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c for c in range(256))
UNKNOWN = "und"


class Phrases:
    """Phrases of a few texts: windows of words inside one piece."""

    def __init__(self, texts: list[bytes], languages: np.ndarray):
        """``languages``: the hash of each text's language."""
        self.words = Words([t.translate(LOWER) for t in texts], WORD_BYTES)
        breaks = np.cumsum(PIECE_BYTES[self.words.buf])
        self.piece = breaks[self.words.starts] if len(self.words.starts) else np.empty(0, np.int64)
        self.language = languages[self.words.doc]
        self.plain = self.words.hashes()

    def hashes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, whether it lies in one piece) of the k words from each place."""
        n = len(self.plain)
        fits = np.zeros(n, bool)
        if n >= k:
            fits[: n - k + 1] = self.piece[: n - k + 1] == self.piece[k - 1 :]
        return mix(self.words.windows(self.plain, k) ^ self.language, 20 + k), fits

    def level(self, k: int, filters: list[Sieve]) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the phrases of k words whose two parts of k - 1 words pass their filter."""
        found, fits = self.hashes(k)
        if k > 1 and len(found) >= k:
            shorter, inside = self.hashes(k - 1)
            passing = np.zeros(len(shorter), bool)
            passing[inside] = filters[k - 2].has(shorter[inside])
            fits[:-1] &= passing[:-1] & passing[1:]
        at = np.flatnonzero(fits)
        return at, found[at]

    def text(self, place: int, k: int) -> str:
        w = self.words
        return b" ".join(w.raw[w.starts[i] : w.ends[i]] for i in range(place, place + k)).decode("utf-8")


def batch_phrases(batch: pa.RecordBatch) -> Iterator[tuple[Phrases, list[str]]]:
    """Phrases of a batch (lang, text) and the language of each of their texts."""
    names = batch.column("lang").fill_null(UNKNOWN).to_pylist()
    hashed = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(names)}
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    for some, numbers in cut_slices(texts, TOGETHER_BYTES, PIECE_BYTES):
        here = [names[i] for i in numbers]
        yield Phrases(some, np.array([hashed[x] for x in here], np.uint64)), here


SUMMARY = "part int, mass long, hashes binary, counts binary"


def summaries(rows: DataFrame, k: int, parts: int, filters: list) -> DataFrame:
    """Counts of the phrases of ``k`` words, as one row per part of the hash space and HELD phrases of a task."""

    def split(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        part = part_of(hashes, parts)
        edges = np.searchsorted(part, np.arange(parts + 1))
        some = np.flatnonzero(edges[1:] > edges[:-1])
        cut = [(int(edges[p]), int(edges[p + 1])) for p in some]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(some.astype(np.int32)),
                pa.array([int(counts[a:b].sum()) for a, b in cut], pa.int64()),
                pa.array([hashes[a:b].tobytes() for a, b in cut], pa.binary()),
                pa.array([counts[a:b].astype("<i8").tobytes() for a, b in cut], pa.binary()),
            ],
            names=["part", "mass", "hashes", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        held, size = [], 0
        for batch in batches:
            for phrases, _ in batch_phrases(batch):
                held.append(phrases.level(k, known)[1])
                size += len(held[-1])
                if size >= HELD:
                    yield split(held)
                    held, size = [], 0
        if size:
            yield split(held)

    return rows.mapInArrow(run, SUMMARY)


class Summary:
    """Misra-Gries counters of one part. ``taken`` is what any count may lack."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.hashes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Take in another summary; merged once as many counters wait as there are."""
        self.waiting.append((hashes, counts))
        self.size += len(hashes)
        if self.size > max(len(self.hashes), 1 << 16):
            self.merge()

    def merge(self) -> None:
        every = np.concatenate([self.hashes, *[h for h, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.hashes, where = np.unique(every, return_inverse=True)
        self.counts = np.zeros(len(self.hashes), np.int64)
        np.add.at(self.counts, where, counts)
        self.waiting, self.size = [], 0
        if len(self.hashes) > self.capacity:
            outside = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            self.counts = self.counts - outside
            left = self.counts > 0
            self.hashes, self.counts = self.hashes[left], self.counts[left]
            self.taken += outside

    def survivors(self, threshold: int) -> np.ndarray:
        """All phrases that may have occurred ``threshold`` times, among them every one that has."""
        self.merge()
        return self.hashes[self.counts + self.taken >= threshold]


def merged(found: DataFrame, threshold: int) -> DataFrame:
    """(part, n, hashes): the survivors of each part."""
    mass = F.sum("mass").over(Window.partitionBy("part")).alias("whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary = None, None

        def close() -> pa.RecordBatch:
            left = summary.survivors(threshold)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "n": pa.array([len(left)], pa.int64()), "hashes": [left.tobytes()]}
            )

        for batch in batches:
            parts, whole = batch.column("part").to_pylist(), batch.column("whole").to_pylist()
            hashes, counts = batch.column("hashes"), batch.column("counts")
            for i, p in enumerate(parts):
                if p != part:
                    if summary is not None:
                        yield close()
                    part, summary = p, Summary(whole[i] // threshold + 1)
                summary.add(np.frombuffer(hashes[i].as_py(), "<u8"), np.frombuffer(counts[i].as_py(), "<i8"))
        if summary is not None:
            yield close()

    # One row per part and task; the window leaves the rows of a part next to each other.
    return found.select("part", mass, "hashes", "counts").mapInArrow(run, "part int, n long, hashes binary")


def survivor_sieve(survivors: DataFrame, parts: int) -> Sieve:
    """The sieve of a level, from stored (part, n, hashes). It has at most FILTER_MOST bits, whatever the input."""
    total = survivors.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    empty = shape(total, parts, FILTER_BITS, FILTER_MOST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("hashes")):
                bits = empty.slice_of(part, np.frombuffer(raw.as_py(), "<u8"))
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": [bits]})

    return filled(empty, survivors.mapInArrow(run, "part int, bits binary"))


def exact_counts(rows: DataFrame, longest: int, filters: list) -> DataFrame:
    """(lang, k, phrase, n): each task's counts of the phrases that pass every filter; k = 0 counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        place: dict[int | str, int] = {}  # a phrase's hash, or the name of a language
        said: list[tuple[str, int, str]] = []
        counts = np.zeros(1024, np.int64)

        def close() -> pa.RecordBatch:
            lang, k, phrase = zip(*said)
            return pa.RecordBatch.from_arrays(
                [pa.array(lang), pa.array(k, pa.int32()), pa.array(phrase), pa.array(counts[: len(said)])],
                names=["lang", "k", "phrase", "n"],
            )

        def slots(keys: list, tell) -> np.ndarray:
            nonlocal counts
            out = np.empty(len(keys), np.int64)
            for i, key in enumerate(keys):
                at = place.get(key, -1)
                if at < 0:
                    at = place[key] = len(said)
                    said.append(tell(i))
                out[i] = at
            if len(said) > len(counts):
                counts = np.concatenate([counts, np.zeros(max(len(said), len(counts)), np.int64)])
            return out

        for batch in batches:
            for phrases, names in batch_phrases(batch):
                doc = phrases.words.doc
                words = np.bincount(doc, minlength=len(names)).tolist()
                at = slots(names, lambda i: (names[i], 0, ""))
                np.add.at(counts, at, words)
                for k in range(1, longest + 1):
                    where, hashes = phrases.level(k, known)
                    passing = known[k - 1].has(hashes)
                    found, first, n = np.unique(hashes[passing], return_index=True, return_counts=True)
                    first = where[passing][first]
                    at = slots(found.tolist(), lambda i: (names[doc[first[i]]], k, phrases.text(int(first[i]), k)))
                    np.add.at(counts, at, n)
                if len(said) >= HELD_PHRASES:
                    yield close()
                    place, said, counts = {}, [], np.zeros(1024, np.int64)
        if said:
            yield close()

    return rows.mapInArrow(run, "lang string, k int, phrase string, n long")


def cut_after(k: Column) -> tuple[Column, Column]:
    words = F.split("phrase", " ")
    return F.array_join(F.slice(words, F.lit(1), k), " "), F.array_join(F.slice(words, k + 1, F.size(words) - k), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, k, phrase, a, l, r, score) of every phrase of two words or more in ``counts`` (lang, k, phrase, n)."""
    cuts = counts.filter("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    first, rest = cut_after(F.col("cut"))
    cuts = cuts.withColumns({"first": first, "rest": rest})
    # Parts of a frequent phrase are frequent, so both joins find them.
    known = counts.filter("k > 0").select("lang", "phrase", "n")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    wide = {c: F.col(c).cast("decimal(15,0)") for c in "alr"}
    above = F.lit(1_000_000).cast("decimal(7,0)") * wide["a"] * wide["a"]
    cuts = cuts.withColumns({"above": above, "below": wide["l"] * wide["r"]}).withColumn("score", F.expr("above div below"))
    least = cuts.groupBy("lang", "k", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("s"))
    return least.select("lang", "k", "phrase", "s.a", "s.l", "s.r", "s.score")


def absorbed(counts: DataFrame, longest: int, percent: int) -> DataFrame:
    """(lang, phrase) of the candidates inside a longer one with ``percent`` of their occurrences or more."""
    longer = counts.filter("k > 2").select("lang", "k", "phrase", F.col("n").alias("over"))
    words = F.split("phrase", " ")

    def runs(k: int) -> Column:
        """Runs of k words of a phrase of more than k."""
        found = F.transform(F.sequence(F.lit(1), F.col("k") - (k - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
        return F.when(F.col("k") > k, found).otherwise(F.array().cast("array<string>"))

    shorter = [runs(k) for k in range(2, longest)]
    if not shorter:
        return counts.limit(0).select("lang", "phrase")
    parts = longer.select("lang", "over", F.explode(F.concat(*shorter)).alias("phrase"))
    most = parts.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    both = counts.filter("k > 1").select("lang", "phrase", "n").join(most, ["lang", "phrase"])
    return both.filter(100 * F.col("over") >= percent * F.col("n")).select("lang", "phrase")


def collocations(
    docs: DataFrame, threshold: int = 10, longest: int = 3, top: int = 2000, percent: int = 50, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lowered (A-Z) and cut into pieces at ``.,;:!?`` and line breaks, and pieces into words at spaces
    and tabs. A candidate has 2 to ``longest`` words and occurs ``a >= threshold`` times within pieces; l
    and r count its parts at the cut that gives the least score 1000000 * a * a div (l * r) (of several, the
    first); n counts all words of the language. Candidates inside a longer one with ``percent`` of their
    occurrences or more are left out. Order: score, then a, both descending, then phrase.

    A null language is "und"; a null or empty text has no words. Rows that repeat count
    each time; other columns are ignored; an empty table gives no rows. Counts are exact; products
    hold for counts below 10^15.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_PARTS, max(1, -(-size // PART_BYTES)))
    filters = []
    for k in range(1, longest + 1):
        left = stored(merged(summaries(rows, k, parts, filters), threshold), f"survivors-{k}")
        filters.append(spark.sparkContext.broadcast(survivor_sieve(left, parts)))
    found = exact_counts(rows, longest, filters).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    counts = stored(found.filter((F.col("k") == 0) | (F.col("n") >= threshold)), "phrase-counts")
    ranked = scored(counts).join(absorbed(counts, longest, percent), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    best = top_rows(ranked, ["lang"], order, top, spread="phrase")
    totals = counts.filter("k = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
