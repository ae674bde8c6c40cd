"""Band edges, NaN, zero baselines and the votes."""

import math

import pytest
from pyspark.sql import functions as F

from driftwarden.operators import decide
from driftwarden.operators.distance import MEASURES

NAN = float("nan")


def weighted(spark, overall, best=0.998, classes=((0, 100.0, 6, 6), (1, 100.0, 6, 6))):
    rows = [(overall, best, [tuple(c) for c in classes])]
    return spark.createDataFrame(
        rows, "overall_similarity double, best_accuracy double, classes array<struct<class:int,average_similarity:double,valid_measures:long,stable_count:long>>"
    )


@pytest.mark.parametrize(
    "similarity, share, band",
    [
        (100.0, 0.98, "EXCELLENT"), (95.0, 0.98, "EXCELLENT"), (94.999, 0.95, "VERY_HIGH"), (90.0, 0.95, "VERY_HIGH"),
        (85.0, 0.90, "HIGH"), (80.0, 0.85, "GOOD"), (75.0, 0.80, "MODERATE"), (70.0, 0.75, "FAIR"),
        (69.999, 0.65, "LOW"), (0.0, 0.65, "LOW"), (NAN, 0.65, "LOW"), (None, 0.65, "LOW"),
    ],
)
def test_accuracy_bands(spark, similarity, share, band):
    row = decide.estimate_accuracy(weighted(spark, similarity)).first()
    assert (row["retention_factor"], row["band"]) == (share, band)
    assert row["estimated_accuracy"] == 0.998 * share


def vote(spark, *args, **kw):
    return decide.decide(decide.confidence_vote(decide.estimate_accuracy(weighted(spark, *args, **kw)))).first()


def test_all_high_runs_alone(spark):
    row = vote(spark, 99.0)
    assert (row["decision"], row["confidence_level"], row["decision_code"], row["risk_level"]) == ("AUTONOMOUS", "HIGH", 1, "LOW")
    assert row["stable_measures"] == {0: 6, 1: 6}


def test_majority_is_watched(spark):
    row = vote(spark, 86.0, classes=((0, 80.0, 6, 2), (1, 60.0, 6, 1)))
    assert (row["decision"], row["confidence_level"], row["decision_code"]) == ("AUTONOMOUS", "MODERATE", 2)


def test_tie_goes_to_the_human(spark):
    # Similarity and one class are autonomous; the drop of 20% and the other class are not.
    row = vote(spark, 76.0, classes=((0, 80.0, 6, 2), (1, 60.0, 6, 1)))
    assert (row["decision"], row["decision_code"], row["risk_level"]) == ("HUMAN_INTERVENTION", 3, "HIGH")


def test_nan_is_low_everywhere(spark):
    row = vote(spark, NAN, classes=((0, NAN, 6, 0), (1, NAN, 6, 0)))
    assert row["decision"] == "HUMAN_INTERVENTION"
    factors = decide.confidence_vote(decide.estimate_accuracy(weighted(spark, NAN, classes=((0, NAN, 6, 0),)))).first()["factors"]
    assert all(f["decision"] == "HUMAN_INTERVENTION" and f["confidence"] == "LOW" for f in factors)


def test_class_without_valid_measures_has_no_vote(spark):
    row = decide.confidence_vote(decide.estimate_accuracy(weighted(spark, 99.0, classes=((0, 0.0, 0, 0), (1, 95.0, 6, 6))))).first()
    assert [f["factor"] for f in row["factors"]] == ["High Similarity", "Small Accuracy Drop", "Class 1 Analysis"]


@pytest.mark.parametrize("best", [0.97, 0.998, 0.9])
def test_drop_edge_follows_double_arithmetic(spark, best):
    drop = abs(best - best * 0.95) / best * 100
    row = decide.confidence_vote(decide.estimate_accuracy(weighted(spark, 92.0, best))).first()
    assert row["accuracy_drop_percent"] == drop
    assert row["factors"][1]["factor"] == ("Small Accuracy Drop" if drop <= 5.0 else "Moderate Accuracy Drop")


def tables(spark, train, now, accuracy=0.9):
    best = spark.createDataFrame(
        [(0, m, "run0", accuracy, t) for m, t in zip(MEASURES, train)], "class int, measure string, run_id string, accuracy double, distance double"
    )
    runtime = spark.createDataFrame([(0, m, n) for m, n in zip(MEASURES, now)], "class int, measure string, distance double")
    return best, runtime


def test_similarity_rules(spark):
    # ratio 0.5 and 1 count 100, ratio 2 counts 50, zero, NaN and null baselines are left out.
    best, runtime = tables(spark, [1.0, 1.0, 1.0, 0.0, NAN, None], [0.5, 1.0, 2.0, 1.0, 1.0, 1.0])
    row = decide.distance_similarity(best, runtime).first()
    assert row["similarities"] == [100.0, 100.0, 50.0]
    assert row["average_similarity"] == pytest.approx(250 / 3)
    assert row["valid_measures"] == 3


def test_nan_runtime_makes_similarity_nan(spark):
    best, runtime = tables(spark, [1.0] * 6, [NAN] + [1.0] * 5)
    row = decide.distance_similarity(best, runtime).first()
    assert row["valid_measures"] == 6 and math.isnan(row["average_similarity"])


def test_stability(spark):
    best, runtime = tables(spark, [1.0, 1.0, 1.0, 0.0, NAN, 1.0], [1.0, 0.2, 1.0001, 0.0, 1.0, NAN])
    row = decide.stability(best, runtime).first()
    assert row["stable_count"] == 2 and row["badge"] == "unstable"
    ratios = [d["ratio"] for d in row["measure_details"]]
    assert ratios[3] == ratios[4] == float("inf") and math.isnan(ratios[5])


def test_weights_and_neutral_similarity(spark):
    rows = [(0, 90.0, 6, 0.9), (1, 60.0, 3, 0.8), (2, 10.0, 0, 0.99)]
    df = spark.createDataFrame(rows, "class int, average_similarity double, valid_measures long, class_accuracy double")
    row = decide.weighted_similarity(df).first()
    assert row["overall_similarity"] == pytest.approx((90 * 5.4 + 60 * 2.4) / 7.8)
    assert row["best_accuracy"] == 0.99
    assert decide.weighted_similarity(df.withColumn("valid_measures", F.lit(0))).first()["overall_similarity"] == 50.0


def test_best_baseline_takes_first_of_equal_runs(spark):
    rows = [("run1", 0, 0.9, "CVM", 3.0), ("run0", 0, 0.9, "CVM", 2.0), ("run2", 0, 0.8, "CVM", 1.0), ("run3", 0, NAN, "CVM", 9.0)]
    df = spark.createDataFrame(rows, "run_id string, class int, accuracy double, measure string, distance double")
    row = decide.best_baseline(df).first()
    assert (row["run_id"], row["distance"]) == ("run0", 2.0)


def test_fallback_only_where_nothing_was_assessed(spark):
    good = vote(spark, 99.0).asDict()
    df = spark.createDataFrame([(99.0,)], "overall_similarity double").withColumn("best_training_accuracy", F.lit(None).cast("double"))
    for c in ("decision", "confidence_level", "action", "risk_level"):
        df = df.withColumn(c, F.lit(good[c]))
    df = df.withColumns({"accuracy_difference": F.lit(0.0), "estimated_accuracy": F.lit(0.9), "decision_code": F.lit(1)})
    row = decide.fallback_decision(df).first()
    assert (row["decision"], row["decision_code"], row["estimated_accuracy"]) == ("HUMAN_INTERVENTION", 3, 0.8)
