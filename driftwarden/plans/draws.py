"""Random choice by hash, the same on any partitioning.

A row's draw is ``md5(seed|tag|row key)``; taking the n rows with the smallest draws is a uniform
sample without replacement. Which rows those are follows from one cut-off string per key, found
without sorting the rows: count draws by their first hex digits, find the cell in which the n-th
draw lies, and rank only that cell. The rows themselves are then filtered in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.plans.ranks import BEFORE_HERE
from driftwarden.plans.scale import lookup_join, null_safe_join, plan_bytes

# First hex digits that name a cell, by bytes read: 4096, 65536 or a million cells per key, so that
# one cell stays a task's work. The drawn rows do not depend on it.
CELL_DIGITS = [(64 << 30, 3), (1 << 40, 4)]
MOST_DIGITS = 5
KEEP_ALL = "g"  # sorts after every hex string
KEEP_NONE = ""


def draw(seed: int | str, tag: str, *row_key: Column | str) -> Column:
    """Hex string that orders rows at random."""
    parts = [F.col(c) if isinstance(c, str) else c for c in row_key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[p.cast("string") for p in parts]).cast("binary"))


def cell_digits(df: DataFrame) -> int:
    size = plan_bytes(df)
    fitting = [digits for limit, digits in CELL_DIGITS if size is not None and size <= limit]
    return fitting[0] if fitting else MOST_DIGITS


def draw_number(hex_draw: Column) -> Column:
    """First 15 hex digits as a non-negative long."""
    return F.conv(F.substring(hex_draw, 1, 15), 16, 10).cast("long")


def cutoffs(
    df: DataFrame,
    keys: list[str],
    hash_col: str,
    want: Callable[[Column], Column],
    key_rows: int | None,
    marked: Column | None = None,
) -> DataFrame:
    """One row per key: the draw of the ``want(total)``-th row, as ``cutoff``.

    ``key_rows`` bounds the number of keys if the caller knows it, else None. ``want`` may also use
    the column ``marked``: how many rows of the key fulfil the condition of that name.
    """
    mark = F.lit(False) if marked is None else marked
    draws = df.select(*keys, F.col(hash_col).alias("_h"), mark.alias("_mark")).withColumn(
        "_cell", F.substring("_h", 1, cell_digits(df))
    )
    counted = draws.groupBy(*keys, "_cell").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("_mark"), 1).otherwise(0)).alias("_m")
    )
    across = Window.partitionBy(*keys).orderBy("_cell")
    whole = Window.partitionBy(*keys)
    placed = counted.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(across.rowsBetween(*BEFORE_HERE)), F.lit(0)),
            "_total": F.sum("_n").over(whole),
            "marked": F.sum("_m").over(whole),
        }
    ).withColumn("_want", want(F.col("_total")).cast("long"))
    edge = placed.filter(
        (F.col("_want") < F.col("_total"))
        & (F.col("_before") < F.col("_want"))
        & (F.col("_want") <= F.col("_before") + F.col("_n"))
    ).select(*keys, "_cell", (F.col("_want") - F.col("_before")).alias("_nth"))
    in_edge = lookup_join(draws.drop("_mark"), edge, [*keys, "_cell"], 1 if not keys else key_rows)
    ranked = in_edge.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("_h")))
    exact = ranked.filter(F.col("_r") == F.col("_nth")).select(*keys, F.col("_h").alias("cutoff"))
    limits = placed.filter((F.col("_before") == 0) & ((F.col("_want") <= 0) | (F.col("_want") >= F.col("_total")))).select(
        *keys, F.when(F.col("_want") <= 0, F.lit(KEEP_NONE)).otherwise(F.lit(KEEP_ALL)).alias("cutoff")
    )
    return exact.unionByName(limits)


def global_cutoff(df: DataFrame, hash_col: str, want: Callable[[Column], Column]) -> Column:
    """The cut-off over the whole table as a scalar subquery."""
    one = cutoffs(df, [], hash_col, want, 1)
    return F.coalesce(one.agg(F.max("cutoff")).scalar(), F.lit(KEEP_NONE))


def hash_ranks(df: DataFrame, keys: list[str], hash_col: str, ties: list[str], name: str) -> DataFrame:
    """Full rank of each row by draw within its key.

    A key is spread over its first-digit cells, so a key that holds a third of the table is
    still ranked by many tasks; the offsets join reuses the window's shuffle.
    """
    celled = df.withColumn("_cell", F.substring(hash_col, 1, cell_digits(df)))
    counted = celled.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(*BEFORE_HERE)
    offsets = counted.select(*keys, "_cell", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_cell").orderBy(hash_col, *ties)
    return (
        null_safe_join(celled.withColumn("_run", F.row_number().over(inside)), offsets, [*keys, "_cell"])
        .withColumn(name, (F.col("_off") + F.col("_run")).cast("long"))
        .drop("_cell", "_run", "_off")
    )
