"""Baselines, similarity and verdicts. Runtime keys: the flows as they are, and with drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden import sources, views
from driftwarden.catalog.base import (
    DRIFT,
    FLOW,
    counted,
    measured,
    melted,
    per_class,
    query,
    sliced,
    stepped,
    with_ctes,
)
from driftwarden.catalog.distances import sliced_flows
from driftwarden.operators import decide, distance, report
from driftwarden.plans.draws import draw, hash_ranks
from driftwarden.plans.scale import cut, scratch_path
from driftwarden.views import CLASSES, FEATURES

SEED = 7
RUNS = 3
DATASETS = ["plain", "drifted"]


def train_folds(spark, sf_dir) -> DataFrame:
    """Train rows with a fold number 0..2 by hash rank within the label."""
    rows = views.train_rows(views.flow_view(spark, sf_dir)).withColumn("h", draw(SEED, "baseline", "row_key"))
    ranked = hash_ranks(rows, ["label"], "h", ["row_key"], "rank")
    return ranked.withColumn("fold", ((F.col("rank") - 1) % RUNS).cast("int"))


def baseline_wide(spark, sf_dir) -> DataFrame:
    """Three pseudo-runs: each fold against the other two, with its accuracy."""
    folds = train_folds(spark, sf_dir).withColumn("class", F.col("label"))
    found = distance.fold_distances(folds, FEATURES, "fold", RUNS, ["class"])
    means = distance.mean_over_features(found, CLASSES, ["run"])
    hit = F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0)
    accuracy = folds.groupBy(F.col("fold").alias("run")).agg(F.avg(hit).alias("accuracy"))
    return means.join(accuracy, "run").withColumn("run_id", F.concat(F.lit("run"), F.col("run").cast("string")))


def baseline(spark, sf_dir) -> DataFrame:
    return distance.to_long_form(baseline_wide(spark, sf_dir), ["run_id", "class", "accuracy"])


def runtime(spark, sf_dir) -> DataFrame:
    """Runtime distances of both data sets in long form, keyed by ``data``."""
    both = sliced_flows(spark, sf_dir).withColumn("data", F.lit("plain")).unionByName(
        sliced_flows(spark, sf_dir, True).withColumn("data", F.lit("drifted"))
    )
    wide = distance.class_distances(both, FEATURES, CLASSES, keys=["data"])
    return distance.to_long_form(wide, ["data", "class"])


BASELINE_SQL = [
    FLOW,
    """
ranked AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('7|baseline|' || row_key), row_key) - 1) % 3 AS INTEGER) AS fold
  FROM flow WHERE side = 'train'),
run_rows AS (
  SELECT run, label AS class, CASE WHEN fold = run THEN 'runtime' ELSE 'train' END AS side,
         flow_duration, pkt_len_mean, pkt_size_avg, rst_flag_cnt
  FROM ranked CROSS JOIN (SELECT unnest([0, 1, 2]) AS run))
""",
    melted("run_rows", "run, class", "run_melted"),
    counted("run_melted", "run, class, feature", "run_counted"),
    stepped("run_counted", "run, class, feature", "run_stepped"),
    measured("run_stepped", "run, class, feature", "run_measured"),
    per_class("run_measured", "run, class", "run_class"),
    """
run_accuracy AS (
  SELECT fold AS run, avg(CASE WHEN prediction = label THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy
  FROM ranked GROUP BY fold),
baseline_wide AS (
  SELECT 'run' || run::VARCHAR AS run_id, run_class.*, accuracy FROM run_class JOIN run_accuracy USING (run)),
baseline AS (
  SELECT run_id, class, accuracy, measure, distance FROM baseline_wide
  UNPIVOT (distance FOR measure IN (Anderson_Darling, CVM, DTS, Kolmogorov_Smirnov, Kuiper, Wasserstein)))
""",
]

RUNTIME_SQL = [
    DRIFT,
    sliced("flow", "plain_rows"),
    sliced("drift", "drift_rows"),
    "both_rows AS (SELECT 'plain' AS data, * FROM plain_rows UNION ALL SELECT 'drifted', * FROM drift_rows)",
    melted("both_rows", "data, class", "both_melted"),
    counted("both_melted", "data, class, feature", "both_counted"),
    stepped("both_counted", "data, class, feature", "both_stepped"),
    measured("both_stepped", "data, class, feature", "both_measured"),
    per_class("both_measured", "data, class", "both_class"),
    """
runtime AS (
  SELECT data, class, measure, distance FROM both_class
  UNPIVOT (distance FOR measure IN (Anderson_Darling, CVM, DTS, Kolmogorov_Smirnov, Kuiper, Wasserstein)))
""",
]

BEST_SQL = """
best AS (
  SELECT class, measure, run_id, accuracy, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY class, measure ORDER BY accuracy DESC, run_id) AS place FROM baseline)
  WHERE place = 1)
"""

SIMILARITY_SQL = """
ratios AS (
  SELECT data, class, measure, accuracy,
         CASE WHEN b.distance IS NULL OR isnan(b.distance) OR b.distance = 0 THEN NULL ELSE r.distance / b.distance END AS ratio
  FROM runtime r JOIN best b USING (class, measure)),
class_sim AS (
  SELECT data, class, coalesce(avg(s), 0) AS average_similarity, count(s) AS valid_measures, max(accuracy) AS class_accuracy
  FROM (SELECT *, CASE WHEN ratio IS NULL THEN NULL WHEN ratio <= 1 THEN least(CAST(100 AS DOUBLE), 100 * (2 - ratio)) ELSE 100 / ratio END AS s FROM ratios)
  GROUP BY data, class)
"""

WEIGHTED_SQL = """
weighted AS (
  SELECT data, coalesce(sum(average_similarity * valid_measures * class_accuracy) FILTER (valid_measures > 0)
           / nullif(sum(valid_measures * class_accuracy) FILTER (valid_measures > 0), 0), 50) AS overall_similarity,
         max(class_accuracy) AS best_accuracy
  FROM class_sim GROUP BY data)
"""

ESTIMATED_SQL = """
estimated AS (
  SELECT *, best_accuracy * retention_factor AS estimated_accuracy FROM (
    SELECT *,
      CAST(CASE WHEN overall_similarity >= 95 THEN 0.98 WHEN overall_similarity >= 90 THEN 0.95 WHEN overall_similarity >= 85 THEN 0.90
           WHEN overall_similarity >= 80 THEN 0.85 WHEN overall_similarity >= 75 THEN 0.80 WHEN overall_similarity >= 70 THEN 0.75
           ELSE 0.65 END AS DOUBLE) AS retention_factor,
      CASE WHEN overall_similarity >= 95 THEN 'EXCELLENT' WHEN overall_similarity >= 90 THEN 'VERY_HIGH' WHEN overall_similarity >= 85 THEN 'HIGH'
           WHEN overall_similarity >= 80 THEN 'GOOD' WHEN overall_similarity >= 75 THEN 'MODERATE' WHEN overall_similarity >= 70 THEN 'FAIR'
           ELSE 'LOW' END AS band
    FROM weighted))
"""

VOTED_SQL = """
factors AS (
  SELECT data, CASE WHEN overall_similarity >= 90 THEN 'High Similarity' WHEN overall_similarity >= 75 THEN 'Moderate Similarity' ELSE 'Low Similarity' END AS factor,
         CASE WHEN overall_similarity >= 75 THEN 'AUTONOMOUS' ELSE 'HUMAN_INTERVENTION' END AS decision,
         CASE WHEN overall_similarity >= 90 THEN 'HIGH' WHEN overall_similarity >= 75 THEN 'MODERATE' ELSE 'LOW' END AS confidence
  FROM estimated
  UNION ALL
  SELECT data, CASE WHEN d <= 5 THEN 'Small Accuracy Drop' WHEN d <= 15 THEN 'Moderate Accuracy Drop' ELSE 'Large Accuracy Drop' END,
         CASE WHEN d <= 15 THEN 'AUTONOMOUS' ELSE 'HUMAN_INTERVENTION' END,
         CASE WHEN d <= 5 THEN 'HIGH' WHEN d <= 15 THEN 'MODERATE' ELSE 'LOW' END
  FROM (SELECT data, abs(best_accuracy - estimated_accuracy) / best_accuracy * 100 AS d FROM estimated)
  UNION ALL
  SELECT data, 'Class ' || class::VARCHAR || ' Analysis',
         CASE WHEN average_similarity >= 75 THEN 'AUTONOMOUS' ELSE 'HUMAN_INTERVENTION' END,
         CASE WHEN average_similarity >= 90 THEN 'HIGH' WHEN average_similarity >= 75 THEN 'MODERATE' ELSE 'LOW' END
  FROM class_sim WHERE valid_measures > 0),
votes AS (
  SELECT data, CAST(count(*) FILTER (decision = 'AUTONOMOUS') AS INTEGER) AS autonomous_votes,
         CAST(count(*) FILTER (decision = 'HUMAN_INTERVENTION') AS INTEGER) AS human_votes,
         CAST(count(*) FILTER (decision = 'AUTONOMOUS' AND confidence = 'HIGH') AS INTEGER) AS high_votes
  FROM factors GROUP BY data),
voted AS (
  SELECT *, CASE WHEN high_votes >= 2 OR autonomous_votes > human_votes THEN 'AUTONOMOUS' ELSE 'HUMAN_INTERVENTION' END AS decision,
         CASE WHEN high_votes >= 2 THEN 'HIGH' WHEN autonomous_votes > human_votes THEN 'MODERATE' ELSE 'LOW' END AS confidence_level,
         CASE WHEN high_votes >= 2 THEN 'Two or more votes are for running alone with high confidence'
              WHEN autonomous_votes > human_votes THEN 'More votes are for running alone than against it'
              ELSE 'No majority of the votes is for running alone' END AS reason
  FROM votes)
"""

ALL_SQL = [*BASELINE_SQL, *RUNTIME_SQL, BEST_SQL, SIMILARITY_SQL, WEIGHTED_SQL, ESTIMATED_SQL, VOTED_SQL]


def chain(spark, sf_dir):
    best = decide.best_baseline(baseline(spark, sf_dir))
    now = runtime(spark, sf_dir)
    return best, now, decide.distance_similarity(best, now, ["data"])


@query(
    "s4_save_load_baseline",
    with_ctes(*BASELINE_SQL, select='SELECT run_id, class, round(accuracy, 6) AS accuracy, measure, round(distance, 4) AS distance FROM baseline'),
)
def s4(spark, sf_dir):
    path = scratch_path(spark, "baseline")
    sources.save_baseline(baseline(spark, sf_dir), path)
    stored = sources.load_baseline(spark, path)
    return stored.select(
        "run_id", "class", F.round("accuracy", 6).alias("accuracy"), "measure", F.round("distance", 4).alias("distance")
    )


@query(
    "s4_repeated_save",
    with_ctes(*BASELINE_SQL, select='SELECT run_id, class, round(accuracy, 6) AS accuracy, measure, round(distance, 4) AS distance FROM baseline'),
)
def s4_repeated(spark, sf_dir):
    """All runs are saved, then one of them again: each is there once."""
    path, rows = scratch_path(spark, "runs"), baseline(spark, sf_dir)
    sources.save_runs(rows, path)
    once = sources.load_runs(spark, path)
    again = once.agg(F.max("run_id").alias("run_id"))
    sources.save_runs(cut(once.join(again, "run_id")), path)
    stored = sources.load_runs(spark, path)
    return stored.select(
        "run_id", "class", F.round("accuracy", 6).alias("accuracy"), "measure", F.round("distance", 4).alias("distance")
    )


@query(
    "r1_best_baseline",
    with_ctes(*BASELINE_SQL, BEST_SQL, select='SELECT class, measure, run_id, round(accuracy, 6) AS accuracy, round(distance, 4) AS distance FROM best'),
)
def r1(spark, sf_dir):
    best = decide.best_baseline(baseline(spark, sf_dir))
    return best.select("class", "measure", "run_id", F.round("accuracy", 6).alias("accuracy"), F.round("distance", 4).alias("distance"))


@query(
    "r2_distance_similarity",
    with_ctes(*ALL_SQL[:-3], select="""
SELECT data, class, round(average_similarity, 4) AS average_similarity, valid_measures, round(class_accuracy, 6) AS class_accuracy FROM class_sim"""),
)
def r2(spark, sf_dir):
    _, _, similar = chain(spark, sf_dir)
    return similar.select(
        "data", "class", F.round("average_similarity", 4).alias("average_similarity"), "valid_measures",
        F.round("class_accuracy", 6).alias("class_accuracy"),
    )


@query(
    "r3_weighted_similarity",
    with_ctes(*ALL_SQL[:-2], select="SELECT data, round(overall_similarity, 4) AS overall_similarity, round(best_accuracy, 6) AS best_accuracy FROM weighted"),
)
def r3(spark, sf_dir):
    _, _, similar = chain(spark, sf_dir)
    found = decide.weighted_similarity(similar, ["data"])
    return found.select("data", F.round("overall_similarity", 4).alias("overall_similarity"), F.round("best_accuracy", 6).alias("best_accuracy"))


@query(
    "r4_estimate_accuracy",
    with_ctes(*ALL_SQL[:-1], select="SELECT data, band, retention_factor, round(estimated_accuracy, 6) AS estimated_accuracy FROM estimated"),
)
def r4(spark, sf_dir):
    _, _, similar = chain(spark, sf_dir)
    found = decide.estimate_accuracy(decide.weighted_similarity(similar, ["data"]))
    return found.select("data", "band", "retention_factor", F.round("estimated_accuracy", 6).alias("estimated_accuracy"))


def voted(spark, sf_dir):
    best, now, similar = chain(spark, sf_dir)
    return best, now, decide.confidence_vote(decide.estimate_accuracy(decide.weighted_similarity(similar, ["data"])))


@query(
    "r5_confidence_vote",
    with_ctes(*ALL_SQL, select="SELECT data, autonomous_votes, human_votes, high_votes, decision, confidence_level, reason FROM voted"),
)
def r5(spark, sf_dir):
    _, _, found = voted(spark, sf_dir)
    return found.select("data", "autonomous_votes", "human_votes", "high_votes", "decision", "confidence_level", "reason")


@query("r5_factor_rows", with_ctes(*ALL_SQL, select="SELECT data, factor, decision, confidence FROM factors"))
def r5_factors(spark, sf_dir):
    _, _, found = voted(spark, sf_dir)
    return decide.factor_rows(found, ["data"])


STABLE_SQL = """
stable_rows AS (
  SELECT data, class, measure, coalesce(ratio, CAST('inf' AS DOUBLE)) AS ratio,
         coalesce(ratio, CAST('inf' AS DOUBLE)) <= 1 AS stable FROM ratios),
stable AS (
  SELECT data, class, count(*) FILTER (stable) AS stable_count,
         CASE WHEN count(*) FILTER (stable) >= 4 THEN 'stable' ELSE 'unstable' END AS badge
  FROM stable_rows GROUP BY data, class)
"""


@query(
    "r6_stability",
    with_ctes(*ALL_SQL[:-3], STABLE_SQL, select="""
SELECT data, class, stable_count, badge, string_agg(measure || ':' || stable::VARCHAR, ',' ORDER BY measure) AS details
FROM stable JOIN stable_rows USING (data, class) GROUP BY ALL"""),
)
def r6(spark, sf_dir):
    best, now, _ = chain(spark, sf_dir)
    found = decide.stability(best, now, ["data"])
    text = F.array_join(
        F.transform("measure_details", lambda d: F.concat(d["measure"], F.lit(":"), d["stable"].cast("string"))), ","
    )
    return found.select("data", "class", "stable_count", "badge", text.alias("details"))


@query(
    "r6_stability_ratios",
    with_ctes(*ALL_SQL[:-3], STABLE_SQL, select="SELECT data, class, measure, round(ratio, 4) AS ratio, stable FROM stable_rows"),
)
def r6_rows(spark, sf_dir):
    best, now, _ = chain(spark, sf_dir)
    found = decide.stability_rows(best, now, ["data"])
    return found.select("data", "class", "measure", F.round("ratio", 4).alias("ratio"), "stable")


@query(
    "r7_decide",
    with_ctes(*ALL_SQL, STABLE_SQL, select="""
SELECT data, decision, confidence_level, round(abs(best_accuracy - estimated_accuracy), 6) AS accuracy_difference,
  CASE WHEN decision = 'AUTONOMOUS' AND confidence_level = 'HIGH' THEN 1 WHEN decision = 'AUTONOMOUS' THEN 2 ELSE 3 END AS decision_code,
  CASE WHEN decision = 'AUTONOMOUS' AND confidence_level = 'HIGH' THEN 'LOW' WHEN decision = 'AUTONOMOUS' THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
  CASE WHEN decision = 'AUTONOMOUS' AND confidence_level = 'HIGH' THEN '🟢 AUTONOMOUS OPERATION' WHEN decision = 'AUTONOMOUS' THEN '🟡 ENHANCED MONITORING'
       ELSE '🔴 HUMAN OVERSIGHT REQUIRED' END AS action,
  (SELECT stable_count FROM stable s WHERE s.data = voted.data AND class = 0) AS stable_0,
  (SELECT stable_count FROM stable s WHERE s.data = voted.data AND class = 1) AS stable_1
FROM voted JOIN estimated USING (data)"""),
)
def r7(spark, sf_dir):
    found = decide.verdict(baseline(spark, sf_dir), runtime(spark, sf_dir), ["data"])
    return found.select(
        "data", "decision", "confidence_level", F.round("accuracy_difference", 6).alias("accuracy_difference"),
        "decision_code", "risk_level", "action",
        F.col("stable_measures")[0].alias("stable_0"), F.col("stable_measures")[1].alias("stable_1"),
    )


@query(
    "r7_decide_unknown_class",
    with_ctes(*BASELINE_SQL, *RUNTIME_SQL, select="""
SELECT data, 'HUMAN_INTERVENTION' AS decision, 'LOW' AS confidence_level, 3 AS decision_code, 'HIGH' AS risk_level
FROM runtime GROUP BY data HAVING bool_or(class NOT IN (SELECT class FROM baseline WHERE class = 0))"""),
)
def r7_unknown(spark, sf_dir):
    """The baseline knows class 0 alone, so no data set with rows of class 1 may run on its own."""
    known = baseline(spark, sf_dir).filter("class = 0")
    found = decide.verdict(known, runtime(spark, sf_dir), ["data"])
    return found.select("data", "decision", "confidence_level", "decision_code", "risk_level")


@query(
    "r9_tag_class_results",
    with_ctes(*BASELINE_SQL, select="""
SELECT run_id, 'class' || class::VARCHAR AS dataset, round(accuracy, 6) AS "Accuracy", round(CVM, 4) AS "CVM_dist" FROM baseline_wide"""),
)
def r9(spark, sf_dir):
    tagged = distance.tag_class_results(baseline_wide(spark, sf_dir))
    found = distance.to_record(tagged, ["run_id", "dataset"])
    return found.select("run_id", "dataset", F.round("Accuracy", 6).alias("Accuracy"), F.round("CVM_dist", 4).alias("CVM_dist"))


@query(
    "r10_accuracy_distance_curve",
    with_ctes(*BASELINE_SQL, select="""
SELECT 'class' || class::VARCHAR AS dataset, round(accuracy, 6) AS accuracy, measure, round(avg(distance), 4) AS mean_distance, count(*) AS runs
FROM baseline GROUP BY class, accuracy, measure"""),
)
def r10(spark, sf_dir):
    found = report.accuracy_distance_curve(baseline(spark, sf_dir))
    return found.select("dataset", F.round("accuracy", 6).alias("accuracy"), "measure", F.round("mean_distance", 4).alias("mean_distance"), "runs")


@query(
    "r10_accuracy_correlation",
    with_ctes(*BASELINE_SQL, select="""
SELECT 'class' || class::VARCHAR AS dataset, measure, round(corr(accuracy, distance), 6) AS correlation FROM baseline GROUP BY class, measure"""),
)
def r10_corr(spark, sf_dir):
    found = report.accuracy_correlation(baseline(spark, sf_dir))
    return found.select("dataset", "measure", F.round("correlation", 6).alias("correlation"))


@query(
    "r11_distance_box_stats",
    with_ctes(*BASELINE_SQL, """
quart AS (
  SELECT class, measure, quantile_cont(distance, 0.25) AS q1, quantile_cont(distance, 0.5) AS q2, quantile_cont(distance, 0.75) AS q3
  FROM baseline GROUP BY class, measure)""", select="""
SELECT 'class' || class::VARCHAR AS dataset, measure, round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3,
       round(min(distance) FILTER (distance >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low,
       round(max(distance) FILTER (distance <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
       count(*) FILTER (distance < q1 - 1.5 * (q3 - q1) OR distance > q3 + 1.5 * (q3 - q1)) AS outliers
FROM baseline JOIN quart USING (class, measure) GROUP BY class, measure, q1, q2, q3"""),
)
def r11(spark, sf_dir):
    found = report.distance_box_stats(baseline(spark, sf_dir))
    return found.select(
        "dataset", "measure", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "outliers"
    )
