"""From distances to a verdict: similarity, estimated accuracy, votes, stability, decision.

Every function takes ``keys``, the columns that tell runs or time windows apart, so one plan judges
all of them. NaN compares as false against every edge, as it does in IEEE arithmetic; Spark orders
NaN above all numbers, so NaN is made null before each comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.functions.columns import any_of, count_if, graded, nan_to_null
from driftwarden.plans.scale import null_safe_join

# Lower similarity edge, share of accuracy kept, name of the band.
ACCURACY_BANDS = [
    (95.0, 0.98, "EXCELLENT"),
    (90.0, 0.95, "VERY_HIGH"),
    (85.0, 0.90, "HIGH"),
    (80.0, 0.85, "GOOD"),
    (75.0, 0.80, "MODERATE"),
    (70.0, 0.75, "FAIR"),
]
LOWEST_BAND = (0.65, "LOW")
SIMILARITY_EDGES = (90.0, 75.0)
DROP_EDGES = (5.0, 15.0)
NEUTRAL_SIMILARITY = 50.0
STABLE_MEASURES = 4

AUTONOMOUS, HUMAN = "AUTONOMOUS", "HUMAN_INTERVENTION"
REASONS = {
    "several": "Two or more votes are for running alone with high confidence",
    "majority": "More votes are for running alone than against it",
    "issues": "No majority of the votes is for running alone",
    "unknown": "A class of the new data has no baseline to compare with",
}
MESSAGES = {
    1: "The classifier can be trusted on this data",
    2: "The classifier may go on, but should be watched closely",
    3: "The classifier should not be trusted on this data without a person",
}
# Output texts of each decision code.
ACTIONS = {1: "🟢 AUTONOMOUS OPERATION", 2: "🟡 ENHANCED MONITORING", 3: "🔴 HUMAN OVERSIGHT REQUIRED"}
RISKS = {1: "LOW", 2: "MEDIUM", 3: "HIGH"}


def best_baseline(baseline: DataFrame) -> DataFrame:
    """Per class and measure, the record of the run with the highest accuracy; the first run wins
    ties. One aggregation, combined before the shuffle."""
    order = F.struct((-nan_to_null("accuracy")).isNull(), -F.col("accuracy"), F.col("run_id"))
    record = F.min_by(F.struct("run_id", "accuracy", "distance"), order)
    best = baseline.groupBy("class", "measure").agg(record.alias("b"))
    return best.select("class", "measure", "b.run_id", "b.accuracy", "b.distance")


def first_baseline(baseline: DataFrame) -> DataFrame:
    """The plain variant: the first stored run."""
    record = F.min_by(F.struct("run_id", "accuracy", "distance"), F.col("run_id"))
    first = baseline.groupBy("class", "measure").agg(record.alias("b"))
    return first.select("class", "measure", "b.run_id", "b.accuracy", "b.distance")


def distance_ratios(best: DataFrame, runtime: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runtime and baseline distance side by side, and their ratio: null where the baseline
    distance is null, NaN or 0, or where the class has no baseline (``known`` is then false)."""
    keys = list(keys or [])
    base = best.select(
        "class", "measure", F.col("accuracy"), F.col("distance").alias("train_distance"), F.lit(True).alias("known")
    )
    now = runtime.select(*keys, "class", "measure", F.col("distance").alias("runtime_distance"))
    usable = F.nullif(nan_to_null("train_distance"), F.lit(0.0))
    joined = null_safe_join(now, base, ["class", "measure"], "left")
    return joined.withColumns({"ratio": F.col("runtime_distance") / usable, "known": F.coalesce("known", F.lit(False))})


def assess_classes(best: DataFrame, runtime: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per class, in one aggregation over the ratios: similarity of each usable measure, their mean
    (0 if none) and number, and how many of the measures are stable (ratio at most 1)."""
    ratio = F.col("ratio")
    close = nan_to_null(ratio) <= 1.0
    value = F.when(ratio.isNull(), F.lit(None)).when(close, F.least(F.lit(100.0), 100.0 * (2.0 - ratio))).otherwise(100.0 / ratio)
    rows = distance_ratios(best, runtime, keys).withColumns(
        {
            "similarity": value,
            "stable": F.coalesce(close, F.lit(False)),
            "shown": F.coalesce(ratio, F.lit(float("inf"))),
        }
    )
    measures = F.sort_array(F.collect_list(F.struct("measure", F.col("shown").alias("ratio"), "stable", "similarity")))
    stable = count_if(F.col("stable"))
    return (
        rows.groupBy(*(keys or []), "class")
        .agg(
            measures.alias("m"),
            F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("average_similarity"),
            F.count("similarity").alias("valid_measures"),
            F.max("accuracy").alias("class_accuracy"),
            stable.alias("stable_count"),
            F.when(stable >= STABLE_MEASURES, "stable").otherwise("unstable").alias("badge"),
            F.bool_or("known").alias("has_baseline"),
        )
        .withColumns(
            {
                "similarities": F.transform(
                    F.filter("m", lambda r: r["similarity"].isNotNull()), lambda r: r["similarity"]
                ),
                "measure_details": F.transform("m", lambda r: r.dropFields("similarity")),
            }
        )
        .drop("m")
    )


def distance_similarity(best: DataFrame, runtime: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per class: similarity of each usable measure, their mean (0 if none) and their number."""
    return assess_classes(best, runtime, keys).select(
        *(keys or []), "class", "similarities", "average_similarity", "valid_measures", "class_accuracy"
    )


def weighted_similarity(similarity: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean over the classes, weighted by valid measures times class accuracy; 50 without weight.

    The class figures are kept in the array ``classes``."""
    keys = list(keys or [])
    listed = ("class", "average_similarity", "valid_measures", "stable_count", "has_baseline")
    kept = [c for c in listed if c in similarity.columns]
    weight = F.when(F.col("valid_measures") > 0, nan_to_null(F.col("valid_measures") * F.col("class_accuracy")))
    grouped = similarity.groupBy(*keys) if keys else similarity.groupBy()
    total = F.sum(weight)
    return grouped.agg(
        F.when(total > 0, F.sum(F.col("average_similarity") * weight) / total)
        .otherwise(NEUTRAL_SIMILARITY)
        .alias("overall_similarity"),
        F.max(nan_to_null("class_accuracy")).alias("best_accuracy"),
        F.sort_array(F.collect_list(F.struct(*kept))).alias("classes"),
    )


def estimate_accuracy(weighted: DataFrame) -> DataFrame:
    """Band of the similarity, and the share of the best accuracy that the band keeps."""
    kept = graded("overall_similarity", [(edge, share) for edge, share, _ in ACCURACY_BANDS], LOWEST_BAND[0])
    band = graded("overall_similarity", [(edge, name) for edge, _, name in ACCURACY_BANDS], LOWEST_BAND[1])
    return weighted.withColumns({"retention_factor": kept, "band": band}).withColumn(
        "estimated_accuracy", F.col("best_accuracy") * F.col("retention_factor")
    )


def _vote(name: Column, high: Column, moderate: Column) -> Column:
    """A factor with its decision; null conditions fall through to the human."""
    return F.struct(
        name.alias("factor"),
        F.when(high | moderate, AUTONOMOUS).when(moderate, AUTONOMOUS).otherwise(HUMAN).alias("decision"),
        F.when(high, "HIGH").when(moderate, "MODERATE").otherwise("LOW").alias("confidence"),
    )


def confidence_vote(estimated: DataFrame) -> DataFrame:
    """Votes of the similarity, of the accuracy drop and of each class, and what they add up to.

    The votes of a run sit in one array, so they are counted within the row."""
    best, top, middle = F.col("best_accuracy"), *SIMILARITY_EDGES
    gap = F.abs(best - F.col("estimated_accuracy"))
    drop = nan_to_null(F.try_divide(gap, best) * 100)
    overall = nan_to_null("overall_similarity")
    similar = F.when(overall >= top, "High Similarity").when(overall >= middle, "Moderate Similarity").otherwise("Low Similarity")
    fallen = (
        F.when(drop <= DROP_EDGES[0], "Small Accuracy Drop")
        .when(drop <= DROP_EDGES[1], "Moderate Accuracy Drop")
        .otherwise("Large Accuracy Drop")
    )

    def of_class(c: Column) -> Column:
        s = nan_to_null(c["average_similarity"])
        return _vote(F.concat(F.lit("Class "), c["class"].cast("string"), F.lit(" Analysis")), s >= top, s >= middle)

    common = F.array(
        _vote(similar, overall >= top, overall >= middle), _vote(fallen, drop <= DROP_EDGES[0], drop <= DROP_EDGES[1])
    )
    judged = F.transform(F.filter("classes", lambda c: c["valid_measures"] > 0), of_class)

    def votes(test) -> Column:
        return F.size(F.filter("factors", test))

    counted = estimated.withColumns({"accuracy_difference": gap, "accuracy_drop_percent": drop}).withColumn(
        "factors", F.concat(common, judged)
    )
    counted = counted.withColumns(
        {
            "autonomous_votes": votes(lambda f: f["decision"] == AUTONOMOUS),
            "human_votes": votes(lambda f: f["decision"] == HUMAN),
            "high_votes": votes(lambda f: (f["decision"] == AUTONOMOUS) & (f["confidence"] == "HIGH")),
        }
    )
    several = F.col("high_votes") >= 2
    majority = F.col("autonomous_votes") > F.col("human_votes")
    return counted.withColumns(
        {
            "decision": F.when(any_of([several, majority]), AUTONOMOUS).otherwise(HUMAN),
            "confidence_level": F.when(several, "HIGH").when(majority, "MODERATE").otherwise("LOW"),
            "reason": F.when(several, REASONS["several"]).when(majority, REASONS["majority"]).otherwise(REASONS["issues"]),
        }
    )


def factor_rows(voted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The votes, one row each."""
    return voted.select(*(keys or []), F.inline("factors"))


def stability_rows(best: DataFrame, runtime: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ratio per class and measure (infinite without a usable baseline) and whether it is at most 1."""
    rows = distance_ratios(best, runtime, keys).withColumn("ratio", F.coalesce("ratio", F.lit(float("inf"))))
    return rows.select(
        *(keys or []),
        "class",
        "measure",
        "ratio",
        F.coalesce(nan_to_null("ratio") <= 1.0, F.lit(False)).alias("stable"),
    )


def stability(best: DataFrame, runtime: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per class: number of stable measures, the badge, and the details in measure order."""
    return assess_classes(best, runtime, keys).select(*(keys or []), "class", "stable_count", "badge", "measure_details")


def decide(voted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Decision code, action and risk, with the number of stable measures per class.

    A class of the new data without any baseline can't be judged: whatever the votes, the decision is
    then code 3 with low confidence."""
    if "has_baseline" in [f.name for f in voted.schema["classes"].dataType.elementType.fields]:
        unknown = F.exists("classes", lambda c: ~c["has_baseline"])
        forced = {"decision": HUMAN, "confidence_level": "LOW", "reason": REASONS["unknown"]}
        voted = voted.withColumns({c: F.when(unknown, F.lit(v)).otherwise(F.col(c)) for c, v in forced.items()})
    run_alone = F.col("decision") == AUTONOMOUS
    code = F.when(run_alone & (F.col("confidence_level") == "HIGH"), 1).when(run_alone, 2).otherwise(3)

    def text(values: dict[int, str]) -> Column:
        return F.when(code == 1, values[1]).when(code == 2, values[2]).otherwise(values[3])

    counts = F.map_from_entries(F.transform("classes", lambda c: F.struct(c["class"], c["stable_count"])))
    return voted.select(
        *(keys or []),
        "decision",
        "confidence_level",
        "accuracy_difference",
        "estimated_accuracy",
        F.col("best_accuracy").alias("best_training_accuracy"),
        "overall_similarity",
        code.alias("decision_code"),
        text(ACTIONS).alias("action"),
        text(RISKS).alias("risk_level"),
        text(MESSAGES).alias("message"),
        "reason",
        counts.alias("stable_measures"),
    )


def fallback_decision(df: DataFrame) -> DataFrame:
    """The cautious answer for runs whose assessment is missing: human oversight.

    Offered as an explicit step; errors are not turned into it silently."""
    cautious = {
        "decision": F.lit(HUMAN),
        "confidence_level": F.lit("LOW"),
        "accuracy_difference": F.lit(0.1),
        "estimated_accuracy": F.lit(0.8),
        "best_training_accuracy": F.lit(0.998),
        "decision_code": F.lit(3),
        "action": F.lit(ACTIONS[3]),
        "risk_level": F.lit(RISKS[3]),
    }
    missing = F.col("overall_similarity").isNull() | F.col("best_training_accuracy").isNull()
    return df.withColumns({c: F.when(missing, v).otherwise(F.col(c)) for c, v in cautious.items()})


def verdict(baseline: DataFrame, runtime: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Baseline and runtime distances in, decision out. Every input is read once."""
    classes = assess_classes(best_baseline(baseline), runtime, keys)
    return decide(confidence_vote(estimate_accuracy(weighted_similarity(classes, keys))), keys)
