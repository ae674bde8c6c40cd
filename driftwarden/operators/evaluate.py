"""Evaluation of binary and multi-class predictions, by aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.functions.columns import count_if, ratio, wilson_bounds
from driftwarden.plans.ranks import prefix_sums


def binary_metrics(df: DataFrame, truth: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall, F1 and specificity; 0 where a denominator is 0."""
    t, p = F.col(truth), F.col(prediction)
    counts = df.agg(
        count_if((t == 1) & (p == 1)).alias("tp"),
        count_if((t == 0) & (p == 1)).alias("fp"),
        count_if((t == 1) & (p == 0)).alias("fn"),
        count_if((t == 0) & (p == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + fp + fn + tn, 0.0).alias("accuracy"),
        ratio(tp, tp + fp, 0.0).alias("precision"),
        ratio(tp, tp + fn, 0.0).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"),
        ratio(tn, tn + fp, 0.0).alias("specificity"),
    )


def roc_auc(df: DataFrame, score: str, label: str = "label", layout: str = "auto") -> DataFrame:
    """Exact area under the ROC curve; tied scores count half. NaN if a class is absent.

    Rows are first counted per score, and the ranks are prefix sums over the distinct scores."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("value")).agg(
        count_if(F.col(label) == 1).alias("x"), count_if(F.col(label) == 0).alias("y")
    )
    placed = prefix_sums(counts, [], "value", ["x", "y"], layout)
    below = F.col("cum_y") - F.col("y")
    wins = F.sum(F.col("x").cast("double") * (below.cast("double") + F.col("y").cast("double") / 2))
    pairs = F.max("all_x").cast("double") * F.max("all_y").cast("double")
    return placed.agg(F.coalesce(F.try_divide(wins, pairs), F.lit(float("nan"))).alias("roc_auc"))


def confusion_matrix(df: DataFrame, labels: list[int], truth: str = "label", prediction: str = "prediction") -> DataFrame:
    """Actual by predicted counts, zero cells kept, in one aggregation of labels x labels counters."""
    rows = [
        F.struct(
            F.lit(a).alias("actual"),
            *[count_if((F.col(truth) == a) & (F.col(prediction) == p)).alias(f"predicted_{p}") for p in labels],
        )
        for a in labels
    ]
    return df.agg(F.array(*rows).alias("m")).select(F.inline("m"))


def classification_report(df: DataFrame, truth: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted averages.

    The rows are counted per (truth, prediction) pair; all else works on those few counts."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                         F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).cast("long").alias("hits")),
            )
        )
    )
    sums = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    per_class = sums.select(
        F.col("class").cast("string").alias("class"),
        ratio(F.col("hits"), F.col("predicted"), 0.0).alias("precision"),
        ratio(F.col("hits"), F.col("support"), 0.0).alias("recall"),
        ratio(2 * F.col("hits"), F.col("predicted") + F.col("support"), 0.0).alias("f1"),
        "support",
    )
    scores = ["precision", "recall", "f1"]
    weighted = [ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"), 0.0).alias(c) for c in scores]
    summary = per_class.agg(
        F.array(
            F.struct(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in scores], F.sum("support").alias("support")),
            F.struct(F.lit("weighted avg").alias("class"), *weighted, F.sum("support").alias("support")),
        ).alias("s")
    ).select(F.inline("s"))
    return per_class.unionByName(summary)


def class_weights(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Count and share of each predicted class."""
    counts = df.groupBy(prediction).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", ratio(F.col("rows"), total))


def wilson_interval(df: DataFrame, p: str, n: str, z: float = 3.29) -> DataFrame:
    """Wilson bounds of the proportion ``p`` over ``n`` trials, row by row."""
    low, high = wilson_bounds(p, n, z)
    return df.withColumns({"lower_bound": low, "upper_bound": high})


def class_reliability(df: DataFrame, truth: str = "label", prediction: str = "prediction", z: float = 3.29) -> DataFrame:
    """Right and wrong predictions per true class, the share that is right with Wilson bounds, and
    one minus wrong over right."""
    same = F.col(truth) == F.col(prediction)
    counts = df.groupBy(F.col(truth).alias("class")).agg(
        count_if(same).alias("right"), count_if(~same).alias("wrong"), F.count(F.lit(1)).alias("total")
    )
    scored = counts.withColumns(
        {
            "p": 1 - ratio(F.col("wrong"), F.col("total")),
            "one_minus_wrong_over_right": 1 - ratio(F.col("wrong"), F.col("right")),
        }
    )
    return wilson_interval(scored, "p", "total", z)
