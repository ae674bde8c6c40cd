"""Six two-sample distances between empirical distribution functions, for all groups at once.

Rows are first reduced to counts per (group, feature, value), which Spark combines before the
shuffle, so a value or a group that holds a large share of the rows costs one count per task. All
six measures then follow from one ordered pass over the distinct values.

With, up to and including a distinct value: cx and cy rows of either side, c = cx + cy,
h = cy/ny - cx/nx, sd = sqrt(c (n - c) / n), and w the gap to the next distinct value:

    Anderson_Darling     sum |h| / sd
    CVM                  sum |h|
    DTS                  sum |h| / sd * w
    Kolmogorov_Smirnov   max(0, max |h|)
    Kuiper               max(0, max h) + |min(0, min h)|
    Wasserstein          sum |h| * w

taken over values with c <= n - 2 (``boundary="reference"``; the steps at the last two pooled rows
are left out) or c <= n - 1 (``boundary="full"``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.functions.columns import flag
from driftwarden.plans.ranks import prefix_sums
from driftwarden.plans.scale import lookup_join

# Fixed names of the six measures, in report order.
MEASURES = ["Anderson_Darling", "CVM", "DTS", "Kolmogorov_Smirnov", "Kuiper", "Wasserstein"]
# Fixed column names of a stored distance record.
RECORD_COLUMNS = {m: f"{m}_dist" for m in MEASURES}
CUT = {"reference": 2, "full": 1}
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def melt(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """One row per feature: ``feature``, ``value``. Integers stay long, anything else is double."""
    whole = all(isinstance(df.schema[c].dataType, INTEGRAL) for c in columns)
    target = "long" if whole else "double"
    cast = df.select(*keep, *[F.col(c).cast(target).alias(c) for c in columns])
    return cast.unpivot(keep, columns, "feature", "value")


def value_counts_by_side(df: DataFrame, keys: list[str], columns: list[str], side: str = "side", first: str = "train") -> DataFrame:
    """Counts x (first side) and y (other side) per (keys, feature, value); nulls are left out."""
    on_first = F.col(side) == F.lit(first)
    return (
        melt(df, [*keys, side], columns)
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "feature", "value")
        .agg(F.sum(flag(on_first)).alias("x"), F.sum(flag(~on_first)).alias("y"))
    )


def ecdf_steps(counts: DataFrame, keys: list[str], value: str = "value", layout: str = "auto") -> DataFrame:
    """Step table: value, cx, cy, nx, ny and the next distinct value, per key."""
    stepped = prefix_sums(counts, keys, value, ["x", "y"], layout)
    return stepped.select(
        *keys,
        F.col(value).alias("value"),
        F.col("cum_x").alias("cx"),
        F.col("cum_y").alias("cy"),
        F.col("all_x").alias("nx"),
        F.col("all_y").alias("ny"),
        F.col("next_value"),
        F.col("position"),
    )


def step_terms(steps: DataFrame, boundary: str = "reference") -> DataFrame:
    """Per step: the signed height ``h``, its scaled size ``a`` and the gap ``w``, null outside the
    boundary; ``present`` tells whether both sides have rows."""
    inside = f"cx + cy <= nx + ny - {CUT[boundary]}"
    height = "try_divide(double(cy), double(ny)) - try_divide(double(cx), double(nx))"
    deviation = "sqrt(double(cx + cy) * double(nx + ny - cx - cy) / double(nx + ny))"
    return steps.withColumns(
        {
            "present": F.expr("nx > 0 and ny > 0"),
            "h": F.expr(f"if({inside}, {height}, null)"),
            "sd": F.expr(deviation),
            "w": F.expr("double(next_value - value)"),
        }
    ).withColumn("a", F.expr("if(sd > 0, abs(h) / sd, if(h is null, null, 0D))"))


# The measures as aggregates over ``step_terms`` of one key.
UP, DOWN = "greatest(0D, coalesce(max(h), 0D))", "least(0D, coalesce(min(h), 0D))"
AGGREGATES = {
    "Anderson_Darling": "coalesce(sum(a), 0D)",
    "CVM": "coalesce(sum(abs(h)), 0D)",
    "DTS": "coalesce(sum(a * w), 0D)",
    "Kolmogorov_Smirnov": f"greatest({UP}, -{DOWN})",
    "Kuiper": f"{UP} + abs({DOWN})",
    "Wasserstein": "coalesce(sum(abs(h) * w), 0D)",
}


def distances(
    counts: DataFrame,
    keys: list[str],
    value: str = "value",
    boundary: str = "reference",
    layout: str = "auto",
    measures: list[str] | None = None,
) -> DataFrame:
    """The measures per key from a table of counts (keys, value, x, y). NaN if a side is empty."""
    wanted = [F.expr(f"if(max(present), {AGGREGATES[m]}, double('NaN'))").alias(m) for m in (measures or MEASURES)]
    return step_terms(ecdf_steps(counts, keys, value, layout), boundary).groupBy(*keys).agg(*wanted)


def feature_distances(
    sliced: DataFrame,
    columns: list[str],
    keys: list[str] | None = None,
    boundary: str = "reference",
    layout: str = "auto",
    measures: list[str] | None = None,
) -> DataFrame:
    """Six measures per (keys, feature) of a table tagged with ``side``; default key: ``class``."""
    keys = ["class"] if keys is None else keys
    counts = value_counts_by_side(sliced, keys, columns)
    return distances(counts, [*keys, "feature"], boundary=boundary, layout=layout, measures=measures)


def single_distance(df: DataFrame, value: str, measure: str, keys: list[str] | None = None, side: str = "side",
                    first: str = "train", boundary: str = "reference", layout: str = "auto") -> DataFrame:
    """One measure of one column, per key or over the whole table."""
    if measure not in MEASURES:
        raise ValueError(f"measure is one of {MEASURES}")
    keys = list(keys or [])
    counts = value_counts_by_side(df, keys, [value], side, first)
    return distances(counts, [*keys, "feature"], boundary=boundary, layout=layout, measures=[measure])


def anderson_darling(df: DataFrame, value: str, **options) -> DataFrame:
    return single_distance(df, value, "Anderson_Darling", **options)


def cvm(df: DataFrame, value: str, **options) -> DataFrame:
    return single_distance(df, value, "CVM", **options)


def dts(df: DataFrame, value: str, **options) -> DataFrame:
    return single_distance(df, value, "DTS", **options)


def kolmogorov_smirnov(df: DataFrame, value: str, **options) -> DataFrame:
    return single_distance(df, value, "Kolmogorov_Smirnov", **options)


def kuiper(df: DataFrame, value: str, **options) -> DataFrame:
    return single_distance(df, value, "Kuiper", **options)


def wasserstein(df: DataFrame, value: str, **options) -> DataFrame:
    return single_distance(df, value, "Wasserstein", **options)


def class_list(spark: SparkSession, classes: list[int]) -> DataFrame:
    """The listed classes as a one-column table built inside the plan."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("class"))


def mean_over_features(per_feature: DataFrame, classes: list[int], keys: list[str] | None = None) -> DataFrame:
    """Plain mean over the features, a NaN row for a class without rows on either side."""
    keys = list(keys or [])
    means = (
        per_feature.filter(F.col("class").isin([int(c) for c in classes]))
        .groupBy(*keys, "class")
        .agg(*[F.avg(m).alias(m) for m in MEASURES])
    )
    if keys:
        # The classes of a key are gathered in a map (at most one entry per listed class) and read
        # off in list order, so the distances are computed once and no key list is joined.
        entry = F.struct("class", F.struct(*MEASURES).alias("v"))
        full = (
            means.groupBy(*keys)
            .agg(F.map_from_entries(F.collect_list(entry)).alias("_of"))
            .select(*keys, "_of", F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("class"))
            .select(*keys, "class", F.try_element_at("_of", F.col("class")).alias("_v"))
            .select(*keys, "class", "_v.*")
        )
    else:
        # At most one row per listed class, so its size is bounded by the argument.
        full = lookup_join(class_list(per_feature.sparkSession, classes), means, ["class"], len(classes), "left")
    return full.select(*keys, "class", *[F.coalesce(m, F.lit(float("nan"))).alias(m) for m in MEASURES])


def fold_distances(
    df: DataFrame,
    columns: list[str],
    fold: str,
    k: int,
    keys: list[str] | None = None,
    boundary: str = "reference",
    layout: str = "auto",
) -> DataFrame:
    """For each fold (``run`` = 0..k-1), its rows against all other rows, per (keys, feature).

    The rows are counted once per fold; the k runs are formed from the counts."""
    keys = ["class"] if keys is None else keys
    per_fold = [F.coalesce(F.sum(flag(F.col(fold) == i)), F.lit(0)) for i in range(k)]
    counts = (
        melt(df, [*keys, fold], columns)
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "feature", "value")
        .agg(F.array(*per_fold).alias("folds"), F.count(F.lit(1)).alias("all_rows"))
        .select(*keys, "feature", "value", "all_rows", F.posexplode("folds").alias("run", "y"))
        .select("run", *keys, "feature", "value", (F.col("all_rows") - F.col("y")).alias("x"), "y")
    )
    return distances(counts, ["run", *keys, "feature"], boundary=boundary, layout=layout)


def class_distances(
    sliced: DataFrame,
    columns: list[str],
    classes: list[int],
    accuracy: float | None = None,
    keys: list[str] | None = None,
    boundary: str = "reference",
    layout: str = "auto",
) -> DataFrame:
    """Wide record per class: accuracy and the six measures averaged over the features."""
    keys = list(keys or [])
    per_feature = feature_distances(sliced, columns, [*keys, "class"], boundary, layout)
    wide = mean_over_features(per_feature, classes, keys)
    return wide if accuracy is None else wide.withColumn("accuracy", F.lit(float(accuracy)))


def to_long_form(wide: DataFrame, keys: list[str]) -> DataFrame:
    """One row per measure: ``measure``, ``distance``."""
    return wide.select(*keys, *MEASURES).unpivot(keys, MEASURES, "measure", "distance")


def to_record(wide: DataFrame, keys: list[str], accuracy: str = "accuracy") -> DataFrame:
    """The stored record layout: Accuracy, then the six ``*_dist`` columns."""
    return wide.select(*keys, F.col(accuracy).alias("Accuracy"), *[F.col(m).alias(c) for m, c in RECORD_COLUMNS.items()])


def tag_class_results(wide: DataFrame) -> DataFrame:
    """Name the class as ``dataset`` = class0, class1, ..."""
    return wide.withColumn("dataset", F.concat(F.lit("class"), F.col("class").cast("string")))


