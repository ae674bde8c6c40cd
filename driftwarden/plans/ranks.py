"""Row numbers and prefix sums that do not need one task per key.

``Window.partitionBy(key).orderBy(value)`` puts a whole key into one task. That is fine while the
input is small. Beyond that the rows are range-partitioned by (key, value); the number of the range
is stored with the rows; running values inside a range are added to the totals of earlier ranges.
No task ever holds more than one range, however many rows a key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.plans.scale import cut, is_small, lookup_join, null_safe_join, stored

CELL = "_cell"
# monotonically_increasing_id() holds the number of the partition above so many bits for the row.
ROW_BITS = 33
UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
BEFORE_HERE = (Window.unboundedPreceding, -1)


def spread_by_range(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Range-partition by keys and order, with the number of the range stored as ``_cell``."""
    ranged = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    return cut(ranged.withColumn(CELL, F.spark_partition_id()))


def use_single(df: DataFrame, layout: str) -> bool:
    if layout not in ("auto", "window", "split"):
        raise ValueError("layout is 'auto', 'window' or 'split'")
    return layout == "window" or (layout == "auto" and is_small(df))


def prefix_sums(df: DataFrame, keys: list[str], value: str, adds: list[str], layout: str = "auto") -> DataFrame:
    """Add, per key in the order of ``value``: ``cum_<c>`` and ``all_<c>`` for each column in
    ``adds``, ``position`` (1, 2, ...) and ``next_value``. ``value`` is unique within a key."""
    if use_single(df, layout):
        ordered = Window.partitionBy(*keys).orderBy(value)
        whole = Window.partitionBy(*keys)
        sums = {f"cum_{c}": F.sum(c).over(ordered.rowsBetween(*UP_TO_HERE)) for c in adds}
        totals = {f"all_{c}": F.sum(c).over(whole) for c in adds}
        return df.withColumns(
            {
                **sums,
                **totals,
                "position": F.row_number().over(ordered).cast("long"),
                "next_value": F.lead(value).over(ordered),
            }
        )
    ranged = spread_by_range(df, keys, [value])
    cells = ranged.groupBy(*keys, CELL).agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in adds],
        F.count(F.lit(1)).alias("_rows"),
        F.min(value).alias("_low"),
    )
    across = Window.partitionBy(*keys).orderBy(CELL)
    whole = Window.partitionBy(*keys)

    def earlier(c: str) -> Column:
        return F.coalesce(F.sum(c).over(across.rowsBetween(*BEFORE_HERE)), F.lit(0))

    offsets = cells.select(
        *keys,
        CELL,
        *[earlier(f"_sum_{c}").alias(f"_off_{c}") for c in adds],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"all_{c}") for c in adds],
        earlier("_rows").alias("_off_rows"),
        F.lead("_low").over(across).alias("_next_low"),
    )
    # The window's shuffle on (keys, _cell) also serves the join, so the rows move once.
    inside = Window.partitionBy(*keys, CELL).orderBy(value)
    local = ranged.withColumns(
        {
            **{f"_run_{c}": F.sum(c).over(inside.rowsBetween(*UP_TO_HERE)) for c in adds},
            "_run_rows": F.row_number().over(inside),
            "_next_here": F.lead(value).over(inside),
        }
    )
    joined = null_safe_join(local, offsets, [*keys, CELL])
    return joined.select(
        *df.columns,
        *[(F.col(f"_off_{c}") + F.col(f"_run_{c}")).alias(f"cum_{c}") for c in adds],
        *[f"all_{c}" for c in adds],
        (F.col("_off_rows") + F.col("_run_rows")).cast("long").alias("position"),
        F.coalesce("_next_here", "_next_low").alias("next_value"),
    )


def row_numbers(df: DataFrame, order: list[str], name: str, keys: list[str] | None = None, layout: str = "auto") -> DataFrame:
    """Add 1..n in the given order, per key or over the whole table."""
    keys = list(keys or [])
    if use_single(df, layout):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    # A sorted range is written once; the place of a row in it is kept, so no row moves again.
    ranged = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).sortWithinPartitions(*keys, *order)
    placed = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    placed = placed.withColumn(CELL, F.shiftright("_at", ROW_BITS).cast("int"))
    cells = placed.groupBy(*keys, CELL).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    across = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(*BEFORE_HERE)
    offsets = cells.select(*keys, CELL, (F.coalesce(F.sum("_rows").over(across), F.lit(0)) - F.col("_first") + 1).alias("_off"))
    return lookup_join(placed, offsets, [*keys, CELL], "check").select(*df.columns, (F.col("_off") + F.col("_at")).cast("long").alias(name))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, points: list[float], layout: str = "auto") -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key, columns ``q0``, ``q1``, ...

    Works on counts per distinct value and their prefix sums, so no group is gathered in one place."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = prefix_sums(counts, keys, "_v", ["_n"], layout)
    columns = []
    for i, q in enumerate(points):
        at = F.lit(float(q)) * (F.col("all__n") - 1)
        low = F.floor(at)
        here = (F.col("cum__n") - F.col("_n") <= low) & (low < F.col("cum__n"))
        above = F.when(low + 1 < F.col("cum__n"), F.col("_v")).otherwise(F.coalesce("next_value", "_v"))
        exact = F.col("_v").cast("double") + (at - low) * (above - F.col("_v")).cast("double")
        columns.append(F.max(F.when(here, exact)).alias(f"q{i}"))
    grouped = placed.groupBy(*keys) if keys else placed.groupBy()
    return grouped.agg(*columns)
