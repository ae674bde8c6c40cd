"""Aggregates, rankings and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.functions.columns import count_if, ratio, risk_band
from driftwarden.plans.ranks import exact_quantiles
from driftwarden.plans.scale import lookup_join

# Fixed accuracy against which the drop is reported.
REFERENCE_ACCURACY = 0.9980
HEAD_FRACTION, HEAD_FLOOR = 0.0008, 50


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and percent per value. The total is a scalar subquery over the counts, not a window."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("percent", F.col("rows") * 100.0 / total)


def ranked_value_counts(df: DataFrame, column: str) -> DataFrame:
    """The same, most frequent first."""
    return value_counts(df, column).orderBy(F.desc("rows"), F.asc(column))


def numeric_profile(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Number of distinct values, minimum, maximum, mean."""
    distinct = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return df.agg(
        distinct.alias("n_distinct"), F.min(column).alias("minimum"), F.max(column).alias("maximum"), F.avg(column).alias("mean")
    )


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    """The distinct values in order, as rows: a table, so any number of them is fine."""
    return df.select(column).distinct().orderBy(column)


def missing_keys(expected: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Expected keys that the data lacks. The data side is reduced to distinct keys first."""
    return expected.join(df.select(column).distinct(), [column], "left_anti")


def missing_values(df: DataFrame, column: str, expected: list) -> DataFrame:
    """The same for a listed set of keys: only listed keys leave the scan."""
    kind = df.schema[column].dataType
    listed = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v).cast(kind) for v in expected])).alias(column))
    present = df.filter(F.col(column).isin(expected)).select(column).distinct()
    # At most one row per listed key, so the right side is bounded by the argument.
    return lookup_join(listed, present, [column], len(expected), "left_anti")


def prediction_summary(df: DataFrame, prediction: str = "prediction", probability: str = "prediction_probability") -> DataFrame:
    """Totals, shares and the spread of the probability (sample deviation), in one pass."""
    p = F.col(prediction)
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"),
        count_if(p == 0).alias("normal"),
        count_if(p == 1).alias("anomalies"),
        (ratio(count_if(p == 0), total, 0.0) * 100).alias("normal_percent"),
        (ratio(count_if(p == 1), total, 0.0) * 100).alias("anomaly_percent"),
        F.avg(probability).alias("mean_probability"),
        F.stddev_samp(probability).alias("std_probability"),
        F.max(probability).alias("max_probability"),
        F.min(probability).alias("min_probability"),
    )


def risk_counts(df: DataFrame, probability: str = "prediction_probability") -> DataFrame:
    """Rows per risk level: High above .8, Medium above .5, else Low."""
    return df.groupBy(risk_band(probability).alias("risk_level")).agg(F.count(F.lit(1)).alias("rows"))


def top_k(df: DataFrame, score: str, k: int, ties: list[str]) -> DataFrame:
    """The k highest scores; every task keeps k rows and the results are merged."""
    return df.orderBy(F.desc(score), *[F.asc(t) for t in ties]).limit(k)


def feature_means_by_class(df: DataFrame, columns: list[str], prediction: str = "prediction") -> DataFrame:
    """Mean of each feature over anomalies and over normal rows, one row per feature."""
    p = F.col(prediction)
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(F.when(p == 1, F.col(c))).alias("anomaly_mean"),
            F.avg(F.when(p == 0, F.col(c))).alias("normal_mean"),
        )
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width counts between minimum and maximum; the last bin is closed, empty bins stay.

    The range is a scalar subquery; at most ``bins`` rows leave the aggregation."""
    x = F.col(column).cast("double")
    valid = df.filter(x.isNotNull() & ~F.isnan(x))
    lo, hi = F.min(x), F.max(x)
    # A single value gets a range of one around it, as numpy does.
    grid = F.struct(
        F.when(hi > lo, lo).otherwise(lo - 0.5).alias("low"), F.when(hi > lo, (hi - lo) / bins).otherwise(1.0 / bins).alias("width")
    )
    ends = valid.agg(grid.alias("g")).scalar()
    low, width = ends.getField("low"), ends.getField("width")
    at = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    counted = valid.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = lookup_join(every, counted, ["bin"], bins, "left")
    return full.select(
        "bin",
        (low + F.col("bin") * width).alias("left_edge"),
        (low + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def accuracy_distance_curve(baseline: DataFrame) -> DataFrame:
    """Mean of each measure at each accuracy, per class data set."""
    dataset = F.concat(F.lit("class"), F.col("class").cast("string")).alias("dataset")
    return baseline.groupBy(dataset, "accuracy", "measure").agg(
        F.avg("distance").alias("mean_distance"), F.count(F.lit(1)).alias("runs")
    )


def accuracy_correlation(baseline: DataFrame) -> DataFrame:
    """Correlation of accuracy and distance over the runs, per class data set and measure."""
    dataset = F.concat(F.lit("class"), F.col("class").cast("string")).alias("dataset")
    return baseline.groupBy(dataset, "measure").agg(F.corr("accuracy", "distance").alias("correlation"))


def mean_accuracy(baseline: DataFrame) -> DataFrame:
    dataset = F.concat(F.lit("class"), F.col("class").cast("string")).alias("dataset")
    runs = baseline.select(dataset, "run_id", "accuracy").distinct()
    return runs.groupBy("dataset").agg(F.avg("accuracy").alias("mean_accuracy"))


def distance_box_stats(baseline: DataFrame, layout: str = "auto") -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, and outliers per class and measure."""
    rows = baseline.select(
        F.concat(F.lit("class"), F.col("class").cast("string")).alias("dataset"), "measure", "distance"
    ).filter(~F.isnan("distance"))
    quartiles = exact_quantiles(rows, ["dataset", "measure"], "distance", [0.25, 0.5, 0.75], layout)
    d, reach = F.col("distance"), 1.5 * (F.col("q2") - F.col("q0"))
    low, high = F.col("q0") - reach, F.col("q2") + reach
    return (
        rows.join(quartiles, ["dataset", "measure"])
        .groupBy("dataset", "measure", "q0", "q1", "q2")
        .agg(
            F.min(F.when(d >= low, d)).alias("whisker_low"),
            F.max(F.when(d <= high, d)).alias("whisker_high"),
            count_if((d < low) | (d > high)).alias("outliers"),
        )
        .select(
            "dataset",
            "measure",
            F.col("q0").alias("q1"),
            F.col("q1").alias("median"),
            F.col("q2").alias("q3"),
            "whisker_low",
            "whisker_high",
            "outliers",
        )
    )


def kpi_table(predictions: DataFrame, decision: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Report rows ``metric``, ``value``: totals, rates, stability, verdict and accuracy drop.

    Both inputs are reduced to one row before they meet."""
    p = F.col(prediction)
    totals = predictions.agg(
        F.struct(
            F.count(F.lit(1)).alias("total"), count_if(p == 0).alias("normal"), count_if(p == 1).alias("anomalies")
        ).alias("t")
    ).scalar()
    total, normal, anomalies = (F.col(f"_t.{c}") for c in ("total", "normal", "anomalies"))
    sample = F.greatest(F.lit(HEAD_FLOOR).cast("long"), F.floor(total * F.lit(HEAD_FRACTION)))

    def row(metric: str, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), value.cast("string").alias("value"))

    def of_six(cls: int) -> Column:
        return F.concat(F.coalesce(F.try_element_at("stable_measures", F.lit(cls)), F.lit(0)).cast("string"), F.lit("/6"))

    rows = [
        row("Total Samples", total),
        row("Normal Traffic", normal),
        row("Anomaly Detected", anomalies),
        row("Anomaly Rate", F.format_string("%.1f%%", ratio(anomalies, total, 0.0) * 100)),
        row("Class 0 Weight", F.format_string("%.1f%%", ratio(normal, total, 0.0) * 100)),
        row("Class 1 Weight", F.format_string("%.1f%%", ratio(anomalies, total, 0.0) * 100)),
        row("Class 0 Stable Measures", of_six(0)),
        row("Class 1 Stable Measures", of_six(1)),
        row("System Decision", F.col("action")),
        row("Confidence Level", F.col("confidence_level")),
        row("Risk Level", F.col("risk_level")),
        row("Estimated Accuracy", F.format_string("%.4f", F.col("estimated_accuracy"))),
        row("Baseline Accuracy", F.format_string("%.4f", F.lit(REFERENCE_ACCURACY))),
        row("Accuracy Drop", F.format_string("%.4f", F.lit(REFERENCE_ACCURACY) - F.col("estimated_accuracy"))),
        row("Visualization Sample Size", sample),
    ]
    return decision.withColumn("_t", totals).select(F.inline(F.array(*rows)))


def last_per_group(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The newest n rows per key. Spark keeps only n rows per key and task before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_place", F.row_number().over(newest)).filter(F.col("_place") <= n).drop("_place")
