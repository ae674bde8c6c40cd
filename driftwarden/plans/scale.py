"""Size checks and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A plan that reads at most this much may use one window per key.
SMALL_PLAN_BYTES = 256 << 20

# A lookup table with at most this many rows may be broadcast.
BROADCAST_ROWS = 200_000


def plan_bytes(df: DataFrame) -> int | None:
    """Bytes that the plan of ``df`` reads after pruning, from file sizes; no job runs. None if
    unknown. Leaves are added up because Spark's own estimate of a join is the product of its sides.
    """
    if not hasattr(df, "_jdf"):  # Spark Connect has no JVM handle
        return None
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """True only when the bytes read are known and at most ``limit``."""
    size = plan_bytes(df)
    return size is not None and size <= (SMALL_PLAN_BYTES if limit is None else limit)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    It is taken from the session. Only a local session without that setting gets a folder of
    its own, because there the driver and the executors are one process.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="driftwarden-"))
        current = sc.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    Used where a column such as a partition number must read the same in two branches of a plan
    even when tasks are run again after an executor is lost.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same as columns in the shared folder: much smaller than ``cut``, and read column by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names where null equals null; each key column appears once."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in on else c) for c in right.columns])
    same = [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on]
    joined = left.join(renamed, reduce(lambda a, b: a & b, same), how) if same else left.crossJoin(renamed)
    return joined.drop(*[f"_r_{c}" for c in on])


def lookup_join(
    df: DataFrame, lookup: DataFrame, on: list[str], rows: int | str | None, how: str = "inner"
) -> DataFrame:
    """Join a lookup table; broadcast it only if it is known to be small.

    ``rows`` is an upper bound that follows from the arguments (for example the number of listed
    keys), or ``"check"``: the lookup is then written to the shared folder and counted. Beyond the
    limit, and with None, the join is left to Spark, which shuffles and splits skewed keys.
    """
    if rows == "check":
        lookup = cut(lookup)
        rows = lookup.count()
    if rows is not None and rows <= BROADCAST_ROWS:
        lookup = F.broadcast(lookup)
    return null_safe_join(df, lookup, on, how)
