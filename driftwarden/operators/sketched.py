"""Distances of continuous features from quantile sketches, where counts per distinct value would be as many as rows.

Each side of a (group, feature) is reduced to one mergeable KLL sketch, so a task sends one sketch per side and
group, whatever the number of distinct values. ``grid`` evenly spaced quantiles of either sketch then stand for its
rows, and the exact operator measures these. Kolmogorov_Smirnov, Kuiper and Wasserstein follow from ranks alone;
the other three divide or add by step of the pooled sample, which ranks do not bound, and are left to ``distance``.

With e the sketch's rank error and g quantiles per side, the height is off by at most 2e + 1/g at every value, so

    Kolmogorov_Smirnov   2e + 1/g
    Kuiper               twice that
    Wasserstein          that times (largest - smallest value)

bound the distance from the exact value at ``boundary="full"``. The rank error holds with 99 % confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.operators.distance import distances, melt

SKETCHED = ["Kolmogorov_Smirnov", "Kuiper", "Wasserstein"]
SKETCH_SIZE = 4096
GRID = 1000
# The sketch library's rank error is A / size ** B, for all ranks of one sketch at once.
ERROR_A, ERROR_B = 2.446, 0.9433


def rank_error(size: int = SKETCH_SIZE) -> float:
    return ERROR_A / size**ERROR_B


def height_error(size: int = SKETCH_SIZE, grid: int = GRID) -> float:
    """Bound of the error of Kolmogorov_Smirnov."""
    return 2 * rank_error(size) + 1 / grid


def value_sketches(
    df: DataFrame, keys: list[str], columns: list[str], side: str = "side", first: str = "train", size: int = SKETCH_SIZE
) -> DataFrame:
    """Per (keys, feature): rows nx and ny, sketches sx and sy of either side, smallest and largest value.

    Null and NaN values, and rows with a null side, are left out. A side without values has 0 rows.
    """
    value, on_first = F.col("value").cast("double"), F.col(side) == F.lit(first)
    x, y = F.when(on_first, value), F.when(~on_first, value)
    known = melt(df, [*keys, side], columns).filter(F.col(side).isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    return known.groupBy(*keys, "feature").agg(
        F.count(x).alias("nx"),
        F.count(y).alias("ny"),
        F.kll_sketch_agg_double(x, size).alias("sx"),
        F.kll_sketch_agg_double(y, size).alias("sy"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )


def merged_sketches(parts: DataFrame, keys: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """Stored ``value_sketches`` of several days or sources as those of all their rows."""
    return parts.groupBy(*keys, "feature").agg(
        F.sum("nx").alias("nx"),
        F.sum("ny").alias("ny"),
        F.kll_merge_agg_double("sx", size).alias("sx"),
        F.kll_merge_agg_double("sy", size).alias("sy"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def sketch_distances(sketches: DataFrame, keys: list[str], size: int = SKETCH_SIZE, grid: int = GRID) -> DataFrame:
    """Per (keys, feature): nx, ny, the three measures, and ``<measure>_error``, the bound of each one's error.

    A group with an empty side has NaN measures and errors, as in the exact form.
    """
    none, error = F.lit(float("nan")), height_error(size, grid)
    shares = F.array(*[F.lit((i + 1) / grid) for i in range(grid)])
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def points(sketch: str, x: Column, y: Column) -> Column:
        found = F.kll_sketch_get_quantile_double(sketch, shares)
        return F.transform(found, lambda v: F.struct(v.alias("value"), x.alias("x"), y.alias("y")))

    # The last four have one value per group, so grouping by them too changes nothing and saves a join.
    group = [*keys, "feature", "rows_x", "rows_y", "low", "high"]
    both = sketches.filter("nx > 0 and ny > 0").withColumnsRenamed({"nx": "rows_x", "ny": "rows_y"})
    each = both.select(*group, F.explode(F.concat(points("sx", one, zero), points("sy", zero, one))).alias("point"))
    counts = each.groupBy(*group, "point.value").agg(F.sum("point.x").alias("x"), F.sum("point.y").alias("y"))
    # Twice ``grid`` points per group: one window each.
    measured = distances(counts, group, boundary="full", layout="window", measures=SKETCHED).select(
        *keys, "feature", F.col("rows_x").alias("nx"), F.col("rows_y").alias("ny"), *SKETCHED,
        F.lit(error).alias("Kolmogorov_Smirnov_error"),
        F.lit(2 * error).alias("Kuiper_error"),
        (F.lit(error) * (F.col("high") - F.col("low"))).alias("Wasserstein_error"),
    )
    empty = sketches.filter("nx = 0 or ny = 0").select(
        *keys, "feature", "nx", "ny", *[none.alias(m) for m in SKETCHED], *[none.alias(f"{m}_error") for m in SKETCHED]
    )
    return measured.unionByName(empty)


def sketched_distances(
    sliced: DataFrame, columns: list[str], keys: list[str] | None = None, size: int = SKETCH_SIZE, grid: int = GRID
) -> DataFrame:
    """``sketch_distances`` of a table tagged with ``side``; default key: ``class``."""
    keys = ["class"] if keys is None else keys
    return sketch_distances(value_sketches(sliced, keys, columns, size=size), keys, size, grid)
