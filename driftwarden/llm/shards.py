"""Token ids in binary shards with an index for keyed access.

A store is a folder: ``shards/`` holds one binary file per range of document keys (header, token
ids of the documents in key order, then where each document starts), ``index/`` one file per bucket
of a minimal perfect hash over the keys, and the tables ``manifest`` and ``buckets`` name the
files that count. A task that runs twice leaves a second file that no table names.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwarden.llm.common import small_batches
from driftwarden.llm.encode import encoder
from driftwarden.llm.mph import ENTRY, Bucket, index_bytes
from driftwarden.plans.scale import lookup_join

MAGIC = b"DWIDS001"
HEADER = struct.Struct("<8sII")  # magic, bytes per id, documents
KEYS_PER_BUCKET = 100_000
# Documents and ids that a reader takes from a shard at a time.
READ_DOCS = 1000
READ_IDS = 2 << 20


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


class ShardWriter:
    """Writes ids as they come, so a shard never stands whole in memory."""

    def __init__(self, folder: str, item: int):
        self.name = f"{uuid.uuid4().hex}.ids"
        filesystem, base = open_fs(folder)
        filesystem.create_dir(base, recursive=True)
        self.out = filesystem.open_output_stream(f"{base}/{self.name}")
        self.kind = np.dtype(f"<u{item}")
        self.out.write(HEADER.pack(MAGIC, item, 0))
        self.starts = [np.zeros(1, np.int64)]
        self.tokens = 0

    def add(self, ids: list[np.ndarray], end_id: int) -> np.ndarray:
        """Append documents, each with ``end_id`` behind it; the sizes with that id."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) + 1
        ends = np.cumsum(sizes)
        flat = np.full(int(ends[-1]), end_id, self.kind)
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False
        flat[inside] = np.concatenate(ids)
        self.out.write(flat.tobytes())
        self.starts.append(self.tokens + ends)
        self.tokens += int(ends[-1])
        return sizes

    def close(self) -> int:
        table = np.concatenate(self.starts).astype("<i8")
        self.out.write(table.tobytes() + struct.pack("<q", len(table) - 1))
        self.out.close()
        return len(table) - 1


class ShardReader:
    """Random access to one shard file."""

    def __init__(self, folder: str, name: str):
        filesystem, base = open_fs(folder)
        self.file = filesystem.open_input_file(f"{base}/{name}")
        magic, self.item, _ = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{name} is no shard of token ids")
        size = self.file.size()
        self.docs = struct.unpack("<q", self.file.read_at(8, size - 8))[0]
        self.table = size - 8 - 8 * (self.docs + 1)

    def bounds(self, first: int, count: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(8 * (count + 1), self.table + 8 * first), "<i8")

    def ids(self, start: int, end: int) -> np.ndarray:
        raw = self.file.read_at((end - start) * self.item, HEADER.size + start * self.item)
        return np.frombuffer(raw, f"<u{self.item}").astype("<u4")


def key_hash(key: str, run: int = 0):
    """64-bit hash of a document key; ``run`` counts the shards that hold rows of the key.

    Of whole numbers the hash is a permutation, so two such keys never share one; of other kinds they may.
    """
    return F.xxhash64(F.col(key), F.col(key).isNull(), F.lit(run) if isinstance(run, int) else F.col(run))


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``end_id``, and write the ids in ascending order of ``key``.

    A null text counts as empty; a null key is a key of its own and comes first; rows with equal
    keys stay next to each other, in the order of their texts' hashes. Other columns are ignored.
    An empty table gives a store without shards.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    keyed = ranged.select(
        key_hash("key").alias("h"), F.col("key").isNull().alias("nokey"), "text", F.spark_partition_id().alias("shard")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, shard, ordinal = encoder(vocabulary), None, None, 0
        item = 2 if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                writer, shard = ShardWriter(f"{path}/shards", item), batch.column("shard")[0].as_py()
            sizes = writer.add(encode.encode(batch.column("text")), end_id)
            n = batch.num_rows
            yield pa.RecordBatch.from_pydict(
                {
                    "h": batch.column("h"),
                    "shard": pa.array([shard] * n, pa.int32()),
                    "ordinal": pa.array(np.arange(ordinal, ordinal + n)),
                    "tokens": pa.array(sizes),
                    "file": pa.array([None] * n, pa.string()),
                }
            )
            ordinal += n
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "h": pa.array([None], pa.int64()),
                    "shard": pa.array([shard], pa.int32()),
                    "ordinal": pa.array([ordinal], pa.int64()),
                    "tokens": pa.array([writer.tokens], pa.int64()),
                    "file": pa.array([writer.name], pa.string()),
                }
            )

    said = f"{path}/said"
    keyed.drop("nokey").mapInArrow(write, "h long, shard int, ordinal long, tokens long, file string").write.parquet(said)
    placed = spark.read.schema("h long, shard int, ordinal long, tokens long, file string").parquet(said)
    # One row per shard, so the running totals over them are a small table.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = placed.filter(F.col("file").isNotNull())
    shards.select(
        "shard",
        "file",
        F.col("ordinal").alias("docs"),
        "tokens",
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"),
    ).write.parquet(f"{path}/manifest")
    write_index(placed.filter(F.col("file").isNull()), path)


def write_index(placed: DataFrame, path: str) -> None:
    """Index files from rows (h, shard, ordinal): one entry per key and shard that holds it."""
    spark = placed.sparkSession
    runs = placed.groupBy("h", "shard").agg(F.min("ordinal").alias("ordinal"), F.count(F.lit(1)).alias("copies"))
    per_key = Window.partitionBy("h")
    entries = runs.withColumns(
        {"run": F.row_number().over(per_key.orderBy("shard")) - 1, "runs": F.count(F.lit(1)).over(per_key)}
    ).select(F.xxhash64("h", "run").alias("key"), "shard", "ordinal", "copies", "runs")
    total = placed.count()
    buckets = max(1, -(-total // KEYS_PER_BUCKET))
    grouped = entries.withColumn("bucket", F.pmod(F.shiftright("key", 17), F.lit(buckets)).cast("long"))

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        filled = np.zeros(rows.num_rows, ENTRY)
        for name in ("shard", "ordinal", "copies", "runs"):
            filled[name] = rows.column(name).to_numpy()
        raw = index_bytes(rows.column("key").to_numpy().view(np.uint64), filled)
        filesystem, base = open_fs(f"{path}/index")
        filesystem.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.mph"
        with filesystem.open_output_stream(f"{base}/{name}") as out:
            out.write(raw)
        return pa.table({"bucket": [key[0].as_py()], "file": [name], "keys": [rows.num_rows], "buckets": [buckets]})

    grouped.groupBy("bucket").applyInArrow(build, "bucket long, file string, keys long, buckets long").write.parquet(
        f"{path}/buckets"
    )


def _probe(keys: DataFrame, path: str, buckets: DataFrame, count: int) -> DataFrame:
    """Look up (h, run) in the index: rows (h, run, shard, ordinal, copies, runs) of the known ones."""
    asked = keys.withColumn("key", F.xxhash64("h", "run")).withColumn(
        "bucket", F.pmod(F.shiftright("key", 17), F.lit(count)).cast("long")
    )
    routed = lookup_join(asked, buckets.select("bucket", "file"), ["bucket"], count)
    routed = routed.repartition("bucket").sortWithinPartitions("bucket")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, bucket = None, None
        filesystem, base = open_fs(f"{path}/index")
        for batch in batches:
            files = batch.column("file").to_pylist()
            at = 0
            while at < len(files):
                to = at
                while to < len(files) and files[to] == files[at]:
                    to += 1
                if files[at] != name:
                    name = files[at]
                    with filesystem.open_input_file(f"{base}/{name}") as f:
                        bucket = Bucket(f.read())
                some = batch.slice(at, to - at)
                known, entries = bucket.find(some.column("key").to_numpy().view(np.uint64))
                kept = some.filter(pa.array(known))
                yield pa.RecordBatch.from_pydict(
                    {"h": kept.column("h"), "run": kept.column("run")}
                    | {c: pa.array(entries[c].astype(np.int64)) for c in ("shard", "ordinal", "copies", "runs")}
                )
                at = to

    return routed.select("h", "run", "key", "file").mapInArrow(
        find, "h long, run int, shard long, ordinal long, copies long, runs long"
    )


def neighbours(files: list[str], ordinal: np.ndarray, copies: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows (from, to) whose documents lie one behind the other in one file."""
    at = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or files[i] != files[i - 1] or ordinal[i] != ordinal[i - 1] + copies[i - 1]:
            yield at, i
            at = i


def spans(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``most`` ids, or of one document."""
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, to
        at = to


def payloads(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The ids of each document as little-endian unsigned 32-bit numbers."""
    offsets = (bounds - bounds[0]) * 4
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())]
    )


def read_store(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The stored documents of the given keys, found through the index.

    One row (key, start, ids) per stored document: ``start`` counts the ids of all documents before
    it, ``ids`` are little-endian unsigned 32-bit numbers. A key that was never stored gives no row
    (a stranger passes the fingerprint once in 2^32); repeated keys are asked once.
    """
    small_batches(spark)
    manifest = spark.read.parquet(f"{path}/manifest")
    index = spark.read.parquet(f"{path}/buckets")
    buckets = index.agg(F.max("buckets")).first()[0]
    asked = keys.select(F.col(key).alias("key")).distinct().withColumn("h", key_hash("key"))
    probe = asked.select("h", F.lit(0).alias("run"))
    if buckets is None:
        return asked.limit(0).select(F.col("key").alias(key), F.lit(0).cast("long").alias("start"), F.lit(b"").alias("ids"))
    first = _probe(probe, path, index, buckets)
    more = first.filter("runs > 1").select("h", F.explode(F.expr("sequence(1, cast(runs as int) - 1)")).alias("run"))
    found = first.unionByName(_probe(more, path, index, buckets)).drop("run", "runs")
    named = asked.join(found, "h").select("key", "shard", "ordinal", "copies")
    routed = named.join(manifest.select(F.col("shard").cast("long"), "file", "base"), "shard")
    # A row here stands for a document's payload, so small rows must not be put together into few tasks.
    routed = routed.repartition(max(1, manifest.count()), "shard").sortWithinPartitions("shard", "ordinal")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for batch in batches:
            files, base = batch.column("file").to_pylist(), batch.column("base").to_numpy()
            ordinal, copies = batch.column("ordinal").to_numpy(), batch.column("copies").to_numpy()
            for at, to in neighbours(files, ordinal, copies):
                if files[at] != name:
                    name = files[at]
                    shard = ShardReader(f"{path}/shards", name)
                # Row of the batch for each stored document of the run.
                row = np.repeat(np.arange(at, to), copies[at:to])
                for first in range(0, len(row), READ_DOCS):
                    some = row[first : first + READ_DOCS]
                    bounds = shard.bounds(int(ordinal[at]) + first, len(some))
                    for low, high in spans(bounds, READ_IDS):
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("key").take(pa.array(some[low:high])),
                                pa.array(bounds[low:high] + base[at]),
                                payloads(shard.ids(int(bounds[low]), int(bounds[high])), bounds[low : high + 1]),
                            ],
                            names=["key", "start", "ids"],
                        )

    kind = named.schema["key"].dataType.simpleString()
    read_back = routed.select("key", "file", "base", "ordinal", "copies").mapInArrow(
        read, f"key {kind}, start long, ids binary"
    )
    return read_back.withColumnRenamed("key", key)
