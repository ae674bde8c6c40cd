"""Packing of token sequences by minimum bin slack.

Every document is cut into full windows and a rest. How many rests there are of each length is a table
of at most ``window`` rows, whatever the corpus' size. From it the sequences are planned: the
longest rest left opens a window, and a subset-sum over the remaining multiset, kept as bits of one
integer, finds the fill closest to the capacity; stepping back through the bits gives the
counts of each length. A plan step is used as often as the counts allow, so there are at most about
as many steps as lengths. Each rest then gets its place from its rank among rests of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.llm.common import small_batches, stored
from driftwarden.llm.encode import encoder
from driftwarden.plans.scale import BROADCAST_ROWS

Step = tuple[dict[int, int], int]  # how often each length stands in the sequence, how many sequences


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The sub-multiset of ``counts`` with the largest sum up to ``capacity``, longer lengths first."""
    mask = (1 << (capacity + 1)) - 1
    reach, trail = 1, []  # bit s: sum s can be made; trail: (reach before, length, how many at once)
    for length in sorted(counts, reverse=True):
        left, chunk = min(counts[length], capacity // length), 1
        while left:
            chunk = min(chunk, left)
            after = reach | (reach << (length * chunk)) & mask
            if after != reach:
                trail.append((reach, length, chunk))
                reach = after
            left -= chunk
            chunk *= 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for before, length, chunk in reversed(trail):
        if not before >> total & 1:
            total -= length * chunk
            used[length] = used.get(length, 0) + chunk
    return used


def plan(counts: dict[int, int], window: int) -> list[Step]:
    """Steps that place every rest. ``counts``: length -> number of rests, lengths 1..window."""
    left, steps = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        if not rest[seed]:
            del rest[seed]
        used = fill({n: c for n, c in rest.items() if n <= window - seed}, window - seed)
        used[seed] = used.get(seed, 0) + 1
        times = min(left[n] // c for n, c in used.items())
        steps.append((used, times))
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return steps


def layout(steps: list[Step]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, how many per sequence, first sequence, offset)."""
    rows, ranks, sequence = [], {}, 0
    for used, times in steps:
        offset = 0
        for length in sorted(used, reverse=True):
            first = ranks.get(length, 0)
            ranks[length] = first + used[length] * times
            rows.append((length, first, ranks[length], used[length], sequence, offset))
            offset += length * used[length]
        sequence += times
    return rows


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, window: int, key: str, text: str) -> DataFrame:
    """Encoded pieces with the task's number and, per length, a running number inside the task."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            where, start, length, nth, tokens, ids = [], [], [], [], [], []
            for i, found in enumerate(encode.encode(batch.column("text"))):
                whole = np.concatenate([found, tail])
                for at in range(0, len(whole), window):
                    piece = whole[at : at + window]
                    where.append(i)
                    start.append(at)
                    length.append(len(piece))
                    nth.append(int(seen[len(piece)]))
                    seen[len(piece)] += 1
                    tokens.append(len(whole))
                    ids.append(piece.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(where)),
                    pa.array([part] * len(where), pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(nth, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["key", "part", "start", "length", "nth", "doc_tokens", "ids"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"key {kind}, part int, start long, length long, nth long, doc_tokens long, ids binary"
    )


def pack(docs: DataFrame, vocabulary: str, end_id: int, window: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit numbers. Sequences hold at most ``window`` ids, gapless
    from offset 0. A null text counts as empty (a piece of the end id alone); null and repeated
    keys are kept as they are, each row is packed on its own; other columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, vocabulary, end_id, window, key, text), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(
        per_part.select("part", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "bases"
    )
    # At most `window` rows: the number of pieces per length.
    counts = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = layout(plan(counts, window))
    places = spark.createDataFrame(
        rows, "length long, first long, end long, per long, sequence long, at long"
    ) if rows else spark.createDataFrame([], "length long, first long, end long, per long, sequence long, at long")
    lookup = bases.drop("n")
    if bases.count() <= BROADCAST_ROWS:
        lookup = F.broadcast(lookup)
    ranked = pieces.join(lookup, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    # The plan has a few rows per length, bounded by the window and not by the corpus.
    placed = ranked.join(F.broadcast(places), "length").filter("rank >= first and rank < end")
    return placed.select(
        F.col("key").alias(key),
        "start",
        "length",
        "ids",
        "doc_tokens",
        (F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.col("length") * ((F.col("rank") - F.col("first")) % F.col("per"))).cast("long").alias("offset"),
    )
