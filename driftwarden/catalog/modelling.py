"""Feature scores, scaling, components, classifiers. Fitted models have no SQL equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwarden import sources, views
from driftwarden.catalog.base import FLOW, query, with_ctes
from driftwarden.operators import batched, certify, evaluate, features, models, neighbours, report, study
from driftwarden.plans.scale import scratch_path
from driftwarden.views import CLASSES, FEATURES

SCORED = [*FEATURES, "syn_flag_cnt"]


def split(spark, sf_dir):
    flows = views.flow_view(spark, sf_dir)
    return views.train_rows(flows), views.runtime_rows(flows)


def quality(spark, sf_dir, fit):
    """Metrics of a model fitted on the training rows and scored on the runtime rows."""
    train, runtime = split(spark, sf_dir)
    return evaluate.binary_metrics(models.score(runtime, fit(train), SCORED))


F_SCORES = with_ctes(
    FLOW,
    " UNION ALL ".join(f"{'melted AS (' if i == 0 else ''}SELECT '{c}' AS feature, label, CAST({c} AS DOUBLE) AS v FROM flow" for i, c in enumerate(SCORED)) + ")",
    """
g AS (SELECT feature, label, count(*)::DOUBLE AS n, avg(v) AS m, var_pop(v) AS s FROM melted GROUP BY feature, label),
t AS (SELECT feature, sum(n * m) / sum(n) AS grand, count(*) AS c, sum(n) AS rows, sum(n * s) AS within FROM g GROUP BY feature),
scores AS (
  SELECT feature, round((sum(n * (m - grand) * (m - grand)) / (c - 1)) / (within / (rows - c)), 6) AS f_score
  FROM g JOIN t USING (feature) GROUP BY feature, c, within, rows)""",
    select="SELECT feature, f_score FROM scores",
)


@query("e1_anova_f_scores", F_SCORES)
def e1(spark, sf_dir):
    found = features.anova_f_scores(views.flow_view(spark, sf_dir), "label", SCORED)
    return found.withColumn("f_score", F.round("f_score", 6))


@query("e1_select_k_best", F_SCORES + " ORDER BY f_score DESC, feature LIMIT 3")
def e1_best(spark, sf_dir):
    found = features.select_k_best(views.flow_view(spark, sf_dir), "label", SCORED, 3)
    return found.withColumn("f_score", F.round("f_score", 6))


@query(
    "e2_standardise",
    with_ctes(FLOW, select="SELECT row_key, " + ", ".join(
        f"round((CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM flow WHERE side = 'train')) / (SELECT stddev_pop({c}) FROM flow WHERE side = 'train'), 6) AS {c}_z"
        for c in FEATURES) + " FROM flow WHERE side = 'runtime'"),
)
def e2(spark, sf_dir):
    train, runtime = split(spark, sf_dir)
    found = features.standardise(train, runtime, FEATURES)
    return found.select("row_key", *[F.round(f"{c}_z", 6).alias(f"{c}_z") for c in FEATURES])


@query("e3_pca")
def e3(spark, sf_dir):
    return features.pca(views.flow_view(spark, sf_dir), SCORED, 3, ["row_key", "label"])


@query("e4_explained_variance")
def e4(spark, sf_dir):
    return features.explained_variance(views.flow_view(spark, sf_dir), SCORED, scale=True)


@query("m1_fit_logistic")
def m1(spark, sf_dir):
    return quality(spark, sf_dir, lambda train: models.fit_logistic(train, SCORED))


@query("m2_fit_forest")
def m2(spark, sf_dir):
    return quality(spark, sf_dir, lambda train: models.fit_forest(train, SCORED))


@query("m3_fit_mlp_history")
def m3(spark, sf_dir):
    train, _ = split(spark, sf_dir)
    return models.fit_mlp(train, SCORED).history


@query("m4_knn_classify")
def m4(spark, sf_dir):
    """Every runtime row against every training row. All pairs are too many for SQL; tests compare
    the operator with brute force."""
    train, runtime = split(spark, sf_dir)
    test = features.standardise(train, runtime, FEATURES)
    scaled = features.standardise(train, train, FEATURES)
    return neighbours.knn_classify(scaled, test, [f"{c}_z" for c in FEATURES], "label")


@query("m5_score")
def m5(spark, sf_dir):
    train, runtime = split(spark, sf_dir)
    scored = models.score(runtime, models.fit_logistic(train, SCORED), SCORED)
    return report.prediction_summary(scored)


@query(
    "m5_score_totals",
    with_ctes(FLOW, select="""
SELECT count(*) AS rows, count(*) AS probabilities, count(*) AS decided, count(*) AS labelled, count(*) AS banded FROM flow WHERE side = 'runtime'"""),
)
def m5_totals(spark, sf_dir):
    """Every row gets a probability, the decision that follows from it, its text and one of the bands."""
    train, runtime = split(spark, sf_dir)
    scored = models.score(runtime, models.fit_logistic(train, SCORED), SCORED)
    p, one = F.col("prediction_probability"), F.col("prediction") == 1
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(p.between(0.0, 1.0)).alias("probabilities"),
        F.count_if(one == (p > 0.5)).alias("decided"),
        F.count_if(F.col("prediction_label").isNotNull() & F.col("prediction").isin(0, 1)).alias("labelled"),
        F.count_if(F.col("risk_level").isNotNull()).alias("banded"),
    )


@query("s7_save_load_model")
def s7(spark, sf_dir):
    train, runtime = split(spark, sf_dir)
    path = scratch_path(spark, "model")
    sources.save_model(models.fit_logistic(train, SCORED), path)
    return report.risk_counts(models.score(runtime, sources.load_model(path), SCORED))


@query(
    "s7_reloaded_model_scores",
    with_ctes(FLOW, select="SELECT count(*) AS rows, 0::BIGINT AS differing FROM flow WHERE side = 'runtime'"),
)
def s7_same(spark, sf_dir):
    """A stored model scores every row as it did before."""
    train, runtime = split(spark, sf_dir)
    path, fitted = scratch_path(spark, "model"), models.fit_logistic(train, SCORED)
    sources.save_model(fitted, path)
    before = models.score(runtime, fitted, SCORED).withColumnRenamed("prediction_probability", "before")
    after = models.score(before.drop("prediction", "prediction_label", "risk_level"), sources.load_model(path), SCORED)
    changed = ~F.col("before").eqNullSafe(F.col("prediction_probability"))
    return after.agg(F.count(F.lit(1)).alias("rows"), F.count_if(changed).alias("differing"))


@query(
    "e4_explained_variance_two",
    with_ctes(FLOW, """
c AS (SELECT corr(CAST(flow_duration AS DOUBLE), CAST(pkt_len_mean AS DOUBLE)) AS r FROM flow)""", select="""
SELECT round((1 + abs(r)) / 2, 6) AS first, round((1 - abs(r)) / 2, 6) AS second FROM c"""),
)
def e4_two(spark, sf_dir):
    """Of two scaled columns the shares have a closed form: half of one plus or minus the correlation."""
    found = features.explained_variance(views.flow_view(spark, sf_dir), ["flow_duration", "pkt_len_mean"], scale=True)
    share = found.agg(F.max("explained").alias("a"), F.min("explained").alias("b"))
    return share.select(F.round("a", 6).alias("first"), F.round("b", 6).alias("second"))


@query("r8_permutation_study")
def r8(spark, sf_dir):
    flows = views.flow_view(spark, sf_dir)
    return study.permutation_study(flows, SCORED, ["row_key"], CLASSES)


@query(
    "r8_held_out_rows",
    with_ctes(FLOW, select="""
SELECT 'run' || CAST(run AS VARCHAR) AS run_id, label AS class, rows, rows // 3 AS held
FROM (SELECT label, count(*) AS rows FROM flow GROUP BY label), (SELECT unnest(range(100)) AS run)"""),
)
def r8_held(spark, sf_dir):
    """Each run of the study holds out exactly a third of every class, rounded down."""
    rows = batched.prepare(views.flow_view(spark, sf_dir), SCORED, ["row_key"], CLASSES, "label", seed=42)
    found = batched.held_counts(rows, batched.held_limits(rows, 100, 3))
    return found.select(F.concat(F.lit("run"), F.col("model").cast("string")).alias("run_id"), "class", "rows", "held")


@query(
    "m1_logistic_optimum",
    with_ctes(FLOW, select="SELECT '(intercept)' AS feature, sum(label)::DOUBLE AS target, TRUE AS at_optimum FROM flow WHERE side = 'train' "
        + " ".join(f"UNION ALL SELECT '{c}', sum(label * {c})::DOUBLE, TRUE FROM flow WHERE side = 'train'" for c in SCORED)),
)
def m1_optimum(spark, sf_dir):
    """The weights are where the penalised loss has no slope: what the fit must give, whatever its steps."""
    train, _ = split(spark, sf_dir)
    return certify.logistic_optimum(train, models.fit_logistic(train, SCORED), SCORED).drop("gradient")


@query(
    "m2_forest_leaf_counts",
    with_ctes(FLOW, select="""
SELECT CAST(tree AS INTEGER) AS tree, count(*) AS rows, count(*) FILTER (WHERE label = 0) AS class_0, count(*) FILTER (WHERE label = 1) AS class_1, 0::BIGINT AS disagreeing
FROM flow, (SELECT unnest(range(20)) AS tree) WHERE side = 'train' GROUP BY tree"""),
)
def m2_leaves(spark, sf_dir):
    """Every training row reaches one leaf of each tree, and the leaves' label counts are those of their rows."""
    train, _ = split(spark, sf_dir)
    forest = models.fit_forest(train, SCORED, trees=20, bootstrap=False)
    found = certify.forest_agreement(train, forest)
    return found.select("tree", "rows", "class_0", "class_1", (F.col("leaves") - F.col("agreeing")).alias("disagreeing"))


def traces(columns: list[str]) -> str:
    """SQL: traces of the powers of the correlation matrix of ``columns``."""
    cells = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS v FROM flow"
        for i, a in enumerate(columns) for j, b in enumerate(columns)
    )
    powers = [f"r1 AS ({cells})"]
    for k in range(2, len(columns) + 1):
        powers.append(f"r{k} AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM r{k - 1} a JOIN r1 b ON a.j = b.i GROUP BY a.i, b.j)")
    select = " UNION ALL ".join(
        f"SELECT {k} AS power, round(sum(v), 6) AS total, TRUE AS uncorrelated, TRUE AS descending FROM r{k} WHERE i = j"
        for k in range(1, len(columns) + 1)
    )
    return with_ctes(FLOW, *powers, select=select)


@query("e3_component_spectrum", traces(SCORED))
def e3_spectrum(spark, sf_dir):
    """The variances of all components, by as many power sums as there are; SQL has them from the correlations alone."""
    found = certify.component_spectrum(views.flow_view(spark, sf_dir), SCORED, scale=True)
    return found.withColumn("total", F.round("total", 6))
