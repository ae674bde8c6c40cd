"""Removal of word passages that an earlier document has too.

Windows of a short length are judged first; only where they repeat are windows of twice that
length made, level by level, until the asked length is reached or nothing is left. Below the asked
length a level keeps, of each run of windows that lie inside one window of the next level, the one
with the least hash. The choice depends on the words alone, so two equal windows of the next
level keep the same ones, and no repeat is lost. At the last level every window counts, by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.common import list_array, map_batches, split_join
from driftwarden.llm.words import Words, running_min, slices


def level_lengths(window: int, shortest: int) -> list[int]:
    lengths = [window]
    while -(-lengths[0] // 2) >= shortest:
        lengths.insert(0, -(-lengths[0] // 2))
    return lengths


def chosen(words: Words, hashes: np.ndarray, length: int, longer: int) -> np.ndarray:
    """Per place, the least hash among the ``length``-windows inside the ``longer``-window there."""
    return running_min(words.windows(hashes, length), longer - length + 1)


def first_level(rows: DataFrame, length: int, longer: int) -> DataFrame:
    """(doc, key, marks): the hashes that stand for the document's windows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks, counts = [], []
        for texts, _ in slices(batch):
            words = Words(texts)
            ok = words.fits(longer)
            least, doc = chosen(words, words.hashes(), length, longer)[ok], words.doc[ok]
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            marks.append(least[new])
            counts.append(np.bincount(doc[new], minlength=len(texts)))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("key"), list_array(np.concatenate(marks).view(np.int64), np.concatenate(counts), pa.int64())],
            names=["doc", "key", "marks"],
        )

    return map_batches(rows, run, "doc long, key binary, marks array<long>")


def candidate_windows(rows: DataFrame, lengths: list[int], at: int) -> DataFrame:
    """From (doc, part, text, marks): the windows of level ``at`` whose mark repeats.

    Below the last level (doc, part, mark); at the last (doc, part, h1, h2, pos).
    """
    short, length = lengths[at - 1], lengths[at]
    last = at == len(lengths) - 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, parts, marks = batch.column("doc").to_numpy(), batch.column("part").to_numpy(), batch.column("marks")
        out = []
        for texts, first in slices(batch):
            words = Words(texts)
            hashes = words.hashes()
            known = marks.slice(first, len(texts)).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            open_ = words.fits(length) & np.isin(chosen(words, hashes, short, length), known)
            if last:
                where = np.flatnonzero(open_)
                h1, h2 = words.windows(hashes, length)[where], words.windows(hashes, length, 1)[where]
                row = first + words.doc[where]
                out.append((docs[row], parts[row], h1, h2, where - words.first[words.doc[where]]))
            else:
                longer = lengths[at + 1]
                shut = running_min(open_.astype(np.int8), longer - length + 1) == 0
                ok = words.fits(longer) & ~shut
                least, row = chosen(words, hashes, length, longer)[ok], first + words.doc[ok]
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                out.append((docs[row[new]], parts[row[new]], least[new]))
        columns = [np.concatenate(c) for c in zip(*out)]
        columns = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64), pa.int64()) for c in columns]
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc", "part", "h1", "h2", "pos"] if last else ["doc", "part", "mark"]
    return map_batches(rows, run, ", ".join(f"{c} long" for c in names))


def repeated_marks(marks: DataFrame) -> DataFrame:
    """(doc, part, marks): per text those of its marks that at least two documents have."""
    spans = marks.groupBy("mark").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    shared = spans.filter("low < high").select("mark")
    return split_join(marks, shared, ["mark"]).groupBy("doc", "part").agg(F.collect_list("mark").alias("marks"))


def repeated_windows(docs: DataFrame, window: int, shortest: int) -> DataFrame:
    """(doc, key, positions): word places from which ``window`` words also stand in a smaller doc.

    ``docs`` has (doc, key, text) with no null doc; ``key`` names the text's content. Copies of a text are
    judged once, in the row of its smallest doc; other rows of the text are not listed.
    """
    lengths = level_lengths(window, shortest)
    if len(lengths) == 1:
        lengths.insert(0, -(-window // 2))
    level = first_level(docs, lengths[0], lengths[1])
    # Texts that share a document's id are told apart by `part`.
    whole = level.groupBy("key").agg(F.min("doc").alias("doc"), F.first("marks").alias("marks"))
    whole = whole.withColumn("part", F.hash("key").cast("long"))
    found = repeated_marks(whole.select("doc", "part", F.explode("marks").alias("mark")))
    least = whole.select("doc", "part", "key")
    for at in range(1, len(lengths)):
        asked = found.join(least, ["doc", "part"])
        open_ = candidate_windows(docs.join(asked, ["doc", "key"]).select("doc", "part", "text", "marks"), lengths, at)
        if at < len(lengths) - 1:
            found = repeated_marks(open_)
    minima = open_.groupBy("h1", "h2").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    earlier = minima.filter("low < high").select("h1", "h2", "low")
    again = split_join(open_, earlier, ["h1", "h2"]).filter("low < doc")
    places = again.groupBy("doc", "part").agg(F.collect_list("pos").alias("positions"))
    return places.join(least, ["doc", "part"]).drop("part")


def remove_repeats(docs: DataFrame, window: int = 50, shortest: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every word that lies in a window of ``window`` words whose sequence also starts in a
    document with a smaller ``key``. Windows are judged on the input.

    Returns per row: key, n_words, n_removed, spans (array of (start, end) in words), kept (the
    words left, joined by one space). Words are cut at ASCII white space. A null text has no words. Rows with a null
    key are returned whole and are compared with nothing. Rows that share a key are one document:
    they don't remove each other's words. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    # Both joins with the texts ask for the same rows, so the texts are dealt once.
    named = rows.filter(F.col("doc").isNotNull() & F.col("key").isNotNull())
    least = named.groupBy("key").agg(F.min("doc").alias("low"))
    spans = repeated_windows(named, window, shortest)
    # Copies of a text go whole if the text has a window at all; the row of the smallest doc is judged by its windows.
    marked = named.join(spans, ["doc", "key"], "left")
    copies = named.select("doc", "key").join(least, "key").filter("low < doc")
    copied = copies.select("doc", "key", F.lit(True).alias("copy")).distinct()
    marked = marked.join(copied, ["doc", "key"], "left")
    loose = rows.filter(F.col("doc").isNull()).withColumns(
        {"positions": F.lit(None).cast("array<long>"), "copy": F.lit(None).cast("boolean")}
    )

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, copy = batch.column("positions"), batch.column("copy").to_pylist()
        total, gone, kept, begins, ends, counts = [], [], [], [], [], []
        for i, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            words = raw.split()
            n = len(words)
            total.append(n)
            if copy[i] and n >= window:
                places = np.arange(n - window + 1)
            else:
                places = at[i].values.to_numpy() if at[i].is_valid else None
            if places is None or not len(places):
                gone.append(0)
                counts.append(0)
                kept.append(b" ".join(words))
                continue
            steps = np.zeros(n + 1, np.int64)
            places = np.unique(places)
            steps[places] += 1
            steps[places + window] -= 1
            out = np.cumsum(steps[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).view(np.int8)))
            begins.append(edges[::2])
            ends.append(edges[1::2])
            counts.append(len(edges) // 2)
            gone.append(int(out.sum()))
            kept.append(b" ".join([w for w, o in zip(words, out.tolist()) if not o]))
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (begins, ends)]
        pairs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], ["start", "end"])
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc"),
                pa.array(total, pa.int64()),
                pa.array(gone, pa.int64()),
                pa.ListArray.from_arrays(offsets, pairs),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            names=["doc", "n_words", "n_removed", "spans", "kept"],
        )

    every = marked.select("doc", "text", "positions", "copy").unionByName(loose.select("doc", "text", "positions", "copy"))
    done = map_batches(
        every, cut, "doc long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"
    )
    return done.withColumnRenamed("doc", key)
