"""Training on values that are not finite, early stopping, and unknown classes in a verdict."""

import math

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from driftwarden.operators import certify, clean, decide, features, models
from driftwarden.operators.sample import stratified_split
from driftwarden.operators.significance import hypergeometric, split_draw


@pytest.fixture(scope="module")
def train(spark):
    odd = {3: float("nan"), 5: float("inf"), 7: None, 9: float("-inf")}
    rows = [(i, odd.get(i, float(i % 10)), float(i % 3), int(i % 10 > 4)) for i in range(120)]
    return spark.createDataFrame(rows, "id long, a double, b double, label int")


def test_moments_are_those_of_cleaned_values(train):
    values = [0.0 if v is None or not math.isfinite(v) else v for v in (r.a for r in train.collect())]
    mean = sum(values) / len(values)
    got = features.scaling_moments(train, ["a"])["a"]
    assert got == pytest.approx((mean, math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))))
    z = features.standardise(train, train, ["a"]).filter("id = 10").first()
    assert math.isfinite(z.a_z)


def test_epochs_patience_and_partitioning(train):
    fit = models.fit_mlp(train, ["a", "b"], hidden=(4,), epochs=15, block=10, patience=100)
    assert [r.iteration for r in fit.history.orderBy("iteration").collect()] == [10, 15]
    stopped = models.fit_mlp(train, ["a", "b"], hidden=(4,), epochs=100, block=5, patience=5, min_delta=10.0)
    assert stopped.stopped_at < 100
    # The optimiser's sums depend on the order of rows; which rows are held out does not.
    parts = [stratified_split(t, "label", 0.2, ["a", "b", "label"]).filter("split = 'test'") for t in (train, train.repartition(7))]
    assert sorted(r.id for r in parts[0].collect()) == sorted(r.id for r in parts[1].collect())


def test_perceptron_rows_are_dealt_out_and_scored_once(train, monkeypatch):
    evaluator = dict(labelCol="label", predictionCol=models.PREDICTED, probabilityCol=models.PROBABILITY)
    whole = models.MultilayerPerceptronClassifier.fit
    seen = []
    monkeypatch.setattr(models, "PERCEPTRON_ROWS", 20, raising=False)
    monkeypatch.setattr(models.MultilayerPerceptronClassifier, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or whole(self, rows))
    fit = models.fit_mlp(train.coalesce(1), ["a", "b"], hidden=(4,), epochs=10, block=10)
    assert seen == [6]
    (row,) = fit.history.collect()
    parted = stratified_split(train, "label", 0.2, ["a", "b", "label"])
    for side, found in (("train", (row.loss, row.accuracy)), ("test", (row.val_loss, row.val_accuracy))):
        scored = fit.model.transform(parted.filter(F.col("split") == side))
        want = [MulticlassClassificationEvaluator(metricName=m, **evaluator).evaluate(scored) for m in ("logLoss", "accuracy")]
        assert list(found) == pytest.approx(want)


def test_one_class_is_an_error(spark):
    df = spark.createDataFrame([("x",), ("x",)], "c string")
    with pytest.raises(Exception, match="has not two classes"):
        clean.binarise_label(df, "c").collect()


def test_a_class_without_baseline_forces_oversight(spark):
    names = ["Anderson_Darling", "CVM", "DTS", "Kolmogorov_Smirnov", "Kuiper", "Wasserstein"]
    baseline = spark.createDataFrame([("r", 0, 0.99, m, 1.0) for m in names], "run_id string, class int, accuracy double, measure string, distance double")
    known = [(0, m, 1.0) for m in names]
    runtime = spark.createDataFrame(known + [(1, m, 99.0) for m in names], "class int, measure string, distance double")
    assert decide.verdict(baseline, runtime.filter("class = 0")).first().decision_code == 1
    found = decide.verdict(baseline, runtime).first()
    assert (found.decision, found.confidence_level, found.decision_code) == (decide.HUMAN, "LOW", 3)
    assert found.stable_measures == {0: 6, 1: 0}
    rows = decide.stability_rows(decide.best_baseline(baseline), runtime).filter(F.col("class") == 1).collect()
    assert len(rows) == 6 and all(math.isinf(r.ratio) and not r.stable for r in rows)


@pytest.mark.parametrize("good,bad,n", [(5000, 7000, 3000), (40, 60, 50), (3, 100_000, 50_000)])
def test_large_draws_have_the_right_distribution(monkeypatch, good, bad, n):
    import numpy as np

    from driftwarden.operators import significance

    rng = np.random.default_rng(1)
    monkeypatch.setattr(significance, "EXACT_POPULATION", 0)
    mine = np.array([hypergeometric(rng, good, bad, n) for _ in range(8000)])
    theirs = rng.hypergeometric(good, bad, n, 8000)
    spread = max(theirs.std(), 0.5)
    assert abs(mine.mean() - theirs.mean()) < 0.06 * spread
    assert abs(mine.std() - theirs.std()) < 0.05 * spread
    sizes = np.full(50, 2 * 10**11)
    drawn = split_draw(rng, sizes, 5 * 10**12)
    assert drawn.sum() == 5 * 10**12 and (drawn <= sizes).all()


def test_only_the_fitted_weights_are_an_optimum(spark, train):
    fitted = models.fit_logistic(train, ["a", "b"])
    told = {r.feature: r for r in certify.logistic_optimum(train, fitted, ["a", "b"]).collect()}
    assert all(r.at_optimum for r in told.values()) and told[certify.INTERCEPT].target == 60
    other = models.fit_logistic(train.filter("id % 4 > 0"), ["a", "b"])
    assert not all(r.at_optimum for r in certify.logistic_optimum(train, other, ["a", "b"]).collect())
    unlabelled = train.limit(1).withColumn("label", F.lit(None).cast("int"))
    assert sorted(certify.logistic_optimum(train.union(unlabelled), fitted, ["a", "b"]).collect()) == sorted(told.values())
    empty = certify.logistic_optimum(train.limit(0), fitted, ["a", "b"]).collect()
    assert [r.target for r in empty] == [0.0, 0.0, 0.0]


def test_leaves_hold_the_rows_that_reach_them(train):
    plain = models.fit_forest(train, ["a", "b"], trees=3, bootstrap=False)
    for r in certify.forest_agreement(train, plain).collect():
        assert (r.rows, r.class_0, r.class_1) == (120, 60, 60) and r.leaves == r.agreeing
    some = certify.forest_agreement(train.filter("id > 30"), plain).collect()
    assert all(r.agreeing < r.leaves for r in some)
    redrawn = certify.forest_agreement(train, models.fit_forest(train, ["a", "b"], trees=3)).collect()
    assert all(r.rows == 120 for r in redrawn) and any(r.agreeing < r.leaves for r in redrawn)


def test_spectrum_against_numpy(train):
    import numpy as np

    rows = train.withColumn("c", F.col("b") * 2 + F.sin("id"))
    x = np.array([[0.0 if v is None or not math.isfinite(v) else v for v in r] for r in rows.select("b", "c").collect()])
    own = np.linalg.eigvalsh(np.cov(x.T, bias=True))
    found = {r.power: r for r in certify.component_spectrum(rows, ["b", "c"]).collect()}
    assert [found[k].total for k in (1, 2)] == pytest.approx([(own**k).sum() for k in (1, 2)])
    assert all(r.uncorrelated and r.descending for r in found.values())
