"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwarden.plans.scale import scratch_path

# Rows and bytes of one Arrow batch, so that a Python worker holds a few MB of text at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20

# Row groups of about 8 MB, their size looked at after every row.
WIDE_ROWS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}

SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS; a smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: a worker waits, idle, while Spark's own stages need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` on every Arrow batch; batches without rows are skipped."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
        give_back()

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a result of Python code feeds several branches, or row numbers given by a task must
    read the same everywhere: one committed attempt of each task counts, also after lost executors.
    ``wide`` is for rows of megabytes: a task holds a row group whole, and by default one has 100 rows at least.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.options(**WIDE_ROWS) if wide else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(text: Column | str = "text") -> Column:
    """Hash of a text; with the document's id it names a row's content, also where ids repeat."""
    return F.xxhash64(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")))


def fresh(names: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that no column of the user's has, whatever its case."""
    taken = {n.lower() for n in names}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def texts_bytes(rows: pa.RecordBatch | pa.Table, name: str = "text") -> list[bytes]:
    """The texts in UTF-8, null as empty."""
    return [t or b"" for t in rows.column(name).cast(pa.binary()).to_pylist()]


def split_join(rows: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of ``rows`` with one row per key, where ``chosen`` was grouped by the same (long) keys.

    A grouped side is already dealt by its keys, and Spark would join it where it lies; then it can't split
    the rows of a hot key. Keys that differ from the grouped ones in one bit make it deal both
    sides for the join alone, and skewed partitions are split.
    """
    left = rows.withColumns({f"__{c}": F.col(c).bitwiseXOR(F.lit(1)) for c in on})
    right = chosen.withColumns({f"__{c}": F.col(c).bitwiseXOR(F.lit(1)) for c in on}).drop(*on)
    return left.join(right, [f"__{c}" for c in on]).drop(*[f"__{c}" for c in on])


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, spread: str, into: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key in ``order``, numbered from 1.

    First within shares of a key dealt by the hash of ``spread``, then among what these leave, so that
    the rows of one key never meet in a single task before they are few.
    """
    share, place = fresh(df.columns, "share", "place")
    dealt = df.withColumn(share, F.pmod(F.xxhash64(spread), F.lit(64)))
    few = dealt.withColumn(place, F.row_number().over(Window.partitionBy(*keys, share).orderBy(*order)))
    few = few.filter(F.col(place) <= n).drop(share, place)
    ranked = few.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.filter(F.col(into) <= n)
