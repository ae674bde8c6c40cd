"""Ranked search for a set of items by scanning the documents, without an index of them.

The terms of the items are built into Aho-Corasick automata, each term between two guards, so it is found as
a whole term only. An automaton's outputs are numbers of terms, and a table leads from these to the items that
hold them. Items are dealt into blocks of bounded size, and blocks lie in the shared folder; a task holds
one automaton at a time. A first scan counts the documents that hold each term, a second one scores: a
task keeps the best documents per item, and these few meet in the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.common import small_batches, stored, texts_bytes, top_rows
from driftwarden.llm.shards import open_fs
from driftwarden.llm.words import SLICE_BYTES, Words, cut_slices
from driftwarden.plans.scale import scratch_path

# Bytes of item terms per block, and texts that a task holds while it goes through several blocks.
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 32 << 20
# Scores (documents x items) that a task holds at a time.
CELLS = 2_000_000

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _is_term(c: int) -> bool:
    return c >= 0x80 or chr(c).isalnum()


# A-Z lowered, every byte outside terms a space.
GUARD = np.array([not _is_term(c) for c in range(256)])
FOLD = bytes((c | 0x20 if 0x41 <= c <= 0x5A else c) if _is_term(c) else 0x20 for c in range(256))


# Terms of more bytes stand in automaton and texts as 128 bits of their hash, behind a capital letter, which folding leaves nowhere.
LONG_TERM = re.compile(rb"[^ ]{201,}")


def shortened(text: bytes) -> bytes:
    return LONG_TERM.sub(lambda m: b"H" + xxhash.xxh3_128_hexdigest(m[0]).encode(), text)


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term, times): the terms of each item; rows that share a key are one item, equal rows count once."""
    rows = items.select(F.col(key).alias("item"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    terms = F.split(F.translate("text", UPPER, LOWER), SEPARATORS)
    return rows.select("item", F.explode(terms).alias("term")).filter("term <> ''").groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def write_blocks(terms: DataFrame, path: str) -> int:
    """One row per block: its items, its terms, and per term the places of its items. Returns the number of blocks."""
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    count = -(-size // BLOCK_BYTES)
    kind = terms.schema["item"].dataType.simpleString()
    named = terms.select(F.pmod(F.xxhash64("item"), F.lit(max(count, 1))).alias("block"), "item", "term", "times")

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        items = rows.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
        words = rows.column("term").combine_chunks().dictionary_encode()
        term, item = words.indices.to_numpy(), items.indices.to_numpy()
        order = np.lexsort((item, term))
        ends = np.cumsum(np.bincount(term, minlength=len(words.dictionary)))
        columns = {
            "block": pa.array([key[0].as_py()], pa.int64()),
            "items": one_list(items.dictionary),
            "terms": one_list(words.dictionary),
            "ends": one_list(pa.array(ends.astype(np.int64))),
            "item": one_list(pa.array(item[order].astype(np.int64))),
            "times": one_list(pa.array(rows.column("times").to_numpy()[order])),
        }
        return pa.table(columns)

    schema = f"block long, items array<{kind}>, terms array<string>, ends array<long>, item array<long>, times array<long>"
    named.groupBy("block").applyInArrow(build, schema).write.partitionBy("block").parquet(path)
    return count


def one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def read_block(path: str, block: int, columns: list[str]) -> dict[str, pa.Array] | None:
    """The columns of one block, read from the shared folder; None if the block is empty."""
    filesystem, base = open_fs(path)
    found = filesystem.get_file_info(fs.FileSelector(f"{base}/block={block}", allow_not_found=True))
    for f in found:
        if f.path.endswith(".parquet"):
            table = pq.read_table(f.path, filesystem=filesystem, columns=columns, partitioning=None)
            if table.num_rows:
                return {c: table.column(c).combine_chunks().flatten() for c in columns}
    return None


class Block:
    """The automaton over a block's terms and the items behind them."""

    def __init__(self, path: str, weights: str | None, block: int):
        self.number = block
        found = read_block(path, block, ["items", "terms", "ends", "item", "times"])
        self.empty = found is None
        if self.empty:
            return
        self.items, self.size = found["items"], len(found["terms"])
        self.ends, self.item, self.times = (found[c].to_numpy() for c in ("ends", "item", "times"))
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(found["terms"].to_pylist()):
            self.automaton.add_word(f" {shortened(term.encode()).decode()} ", i)
        self.automaton.make_automaton()
        self.weights = np.zeros(self.size, np.int64)
        known = read_block(weights, block, ["term", "weight"]) if weights else None
        if known is not None:
            self.weights[known["term"].to_numpy()] = known["weight"].to_numpy()

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, times) of the block's terms in folded texts."""
        keys, times, split = [], [], False
        for some, numbers in cut_slices(texts, SLICE_BYTES, GUARD):
            pieces = [t.decode("utf-8") for t in some]
            ends = np.cumsum([len(p) + 1 for p in pieces])
            flat = np.fromiter(chain.from_iterable(self.automaton.iter(f" {' '.join(pieces)} ")), np.int64)
            where = np.searchsorted(ends, flat[::2] - 1, "left")
            key, n = np.unique(np.array(numbers)[where] * self.size + flat[1::2], return_counts=True)
            split = split or (bool(keys) and len(key) > 0 and len(keys[-1]) > 0 and keys[-1].max() // self.size == key.min() // self.size)
            keys.append(key)
            times.append(n)
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        n = np.concatenate(times) if times else np.empty(0, np.int64)
        if split:
            key, where = np.unique(key, return_inverse=True)
            n = np.bincount(where, n).astype(np.int64)
        return key // max(self.size, 1), key % max(self.size, 1), n

    def scores(self, doc: np.ndarray, term: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Scores (documents x items) in 64-bit integers; ``length`` is m of each document."""
        part = self.weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * length[doc]))
        count = self.ends[term] - self.starts[term]
        ends = np.cumsum(count)
        at = np.repeat(self.starts[term] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
        out = np.zeros(len(length) * len(self.items), np.int64)
        np.add.at(out, np.repeat(doc, count) * len(self.items) + self.item[at], np.repeat(part, count) * self.times[at])
        return out.reshape(len(length), len(self.items))


class Best:
    """The first ``top`` documents of each item of a block: by score, then by key, null keys last."""

    def __init__(self, items: int, top: int):
        self.items, self.top = items, top
        self.least = np.ones(items, np.int64)
        self.rows = [np.empty((0, 4), np.int64)]  # item, -score, whether the key is null, key
        self.size = 0

    def add(self, scores: np.ndarray, keys: np.ndarray, nulls: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least)
        self.rows.append(np.stack([item, -scores[doc, item], nulls[doc], keys[doc]], 1))
        self.size += len(doc)
        if self.size > 4 * self.top * self.items + 10_000:
            self.cut()

    def cut(self) -> np.ndarray:
        every = np.concatenate(self.rows)
        every = every[np.lexsort((every[:, 3], every[:, 2], every[:, 1], every[:, 0]))]
        first = np.searchsorted(every[:, 0], every[:, 0])
        place = np.arange(len(every)) - first
        kept = every[place < self.top]
        full = place == self.top - 1
        self.least[every[full, 0]] = -every[full, 1]
        self.rows, self.size = [kept], len(kept)
        return kept


def chunks(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.Table]:
    """The batches as they are, or, where each is gone through for several blocks, put together."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if blocks == 1 or size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def folded(rows: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Folded texts and the number of terms in each."""
    texts = [shortened(t.translate(FOLD)) for t in texts_bytes(rows)]
    counts = [Words(some, GUARD).counts for some in by_size(texts)]
    return texts, np.concatenate(counts).astype(np.int64)


def by_size(texts: list[bytes]) -> Iterator[list[bytes]]:
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= SLICE_BYTES:
            size += len(texts[to])
            to += 1
        yield texts[at:to]
        at = to


def block_of(made: dict[int, Block], path: str, weights: str | None, number: int) -> Block:
    """The block, the only one that is held."""
    if number not in made:
        made.clear()
        made[number] = Block(path, weights, number)
    return made[number]


def document_counts(docs: DataFrame, path: str, blocks: int) -> DataFrame:
    """(block, term, n) per task: documents that hold a term; block -1 counts documents (0) and terms (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Block] = {}
        totals, seen = [0, 0], {}
        for rows in chunks(batches, blocks):
            texts, counts = folded(rows)
            totals[0] += int((counts > 0).sum())
            totals[1] += int(counts.sum())
            for number in range(blocks):
                block = block_of(made, path, None, number)
                if not block.empty:
                    found = np.bincount(block.scan(texts)[1], minlength=block.size)
                    if blocks == 1:
                        seen[number] = seen.get(number, 0) + found
                    else:
                        yield count_rows(number, found)
        for number, found in seen.items():
            yield count_rows(number, found)
        yield pa.RecordBatch.from_pydict({"block": pa.array([-1, -1], pa.int64()), "term": pa.array([0, 1], pa.int64()), "n": pa.array(totals, pa.int64())})

    return docs.select("text").mapInArrow(run, "block long, term long, n long")


def count_rows(block: int, found: np.ndarray) -> pa.RecordBatch:
    term = np.flatnonzero(found)
    return pa.RecordBatch.from_pydict(
        {"block": pa.array(np.full(len(term), block)), "term": pa.array(term), "n": pa.array(found[term].astype(np.int64))}
    )


def best_documents(docs: DataFrame, path: str, weights: str, blocks: int, all_docs: int, all_terms: int, top: int, kind: str) -> DataFrame:
    """(item, doc, score) per task: for each item the ``top`` best of the task's documents, or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Block] = {}
        best: dict[int, Best] = {}

        def said(number: int) -> pa.RecordBatch:
            kept = best[number].cut()
            items = block_of(made, path, weights, number).items.take(pa.array(kept[:, 0]))
            return pa.RecordBatch.from_pydict(
                {"item": items, "doc": pa.array(kept[:, 3], mask=kept[:, 2] > 0), "score": pa.array(-kept[:, 1])}
            )

        for rows in chunks(batches, blocks):
            texts, counts = folded(rows)
            column = rows.column("doc").combine_chunks()
            keys, nulls = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
            length = np.array([100 - 75 + (75 * n * all_docs) // all_terms for n in counts.tolist()], np.int64)
            for number in range(blocks):
                block = block_of(made, path, weights, number)
                if block.empty:
                    continue
                if number not in best:
                    best[number] = Best(len(block.items), top)
                step = max(1, CELLS // len(block.items))
                for at in range(0, len(texts), step):
                    found = block.scan(texts[at : at + step])
                    scores = block.scores(*found, length[at : at + step])
                    best[number].add(scores, keys[at : at + step], nulls[at : at + step].astype(np.int64))
                if blocks > 1:
                    yield said(number)
                    del best[number]
        for number in list(best):
            yield said(number)

    return docs.select("doc", "text").mapInArrow(run, f"item {kind}, doc long, score long")


def search(
    docs: DataFrame, items: DataFrame, top: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id"
) -> DataFrame:
    """The ``top`` best documents per item: item, rank (int, from 1), key, score; scores above 0 alone.

    A term is a run of ASCII letters, digits and characters outside ASCII, A-Z lowered. A document's score sums, over
    the item's terms, weight * (1000000000 * tf div (1000 * tf + 8 * m)): the weight falls with the number
    of documents that hold the term, m grows with the document's length against the mean. Equal scores
    rank by key, null keys last. Rows that repeat a document's key are documents of their own; rows that repeat
    an item's key are one item, equal ones once. Null and empty texts have no terms; an item
    without terms, and an empty table on either side, give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    path, weights = scratch_path(spark, "blocks"), scratch_path(spark, "weights")
    terms = stored(item_terms(items, item, text), "terms")
    kind = terms.schema["item"].dataType.simpleString()
    blocks = write_blocks(terms, path)
    nothing = spark.createDataFrame([], f"`{item}` {kind}, rank int, `{key}` long, score long")
    if not blocks:
        return nothing
    counted = document_counts(rows, path, blocks).groupBy("block", "term").agg(F.sum("n").alias("n"))
    counted = stored(counted, "holding")
    totals = {r.term: r.n for r in counted.filter("block = -1").collect()}
    all_docs, all_terms = totals.get(0, 0), totals.get(1, 0)
    if not all_terms:
        return nothing
    weight = F.floor(1000 * F.log(F.lit(2.0 * all_docs + 2) / (2 * F.col("n") + 1))).cast("long")
    weighed = counted.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("w"))
    weighed.select("block", F.col("w.term").alias("term"), F.col("w.weight").alias("weight")).write.partitionBy("block").parquet(weights)
    found = best_documents(rows, path, weights, blocks, all_docs, all_terms, top, kind)
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    ranked = top_rows(found, ["item"], order, top, spread="doc")
    return ranked.select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score")
