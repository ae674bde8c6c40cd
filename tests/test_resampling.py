"""Draws, p-values and kNN against brute force on small fixtures."""

import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwarden import catalog
from driftwarden.operators import neighbours, sample, significance, study
from driftwarden.operators.distance import MEASURES
from tests.test_distance import walk


def rows_of(spark, x, y):
    rows = [(f"x{i}", 0, "train", float(v)) for i, v in enumerate(x)] + [(f"y{i}", 0, "runtime", float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "row_key string, class int, side string, v double")


def literal_pvalues(x, y, replicates, seed):
    rng = np.random.default_rng(seed)
    pool = np.concatenate([x, y])
    seen = walk(x, y)
    beyond = dict.fromkeys(MEASURES, 0)
    for _ in range(replicates - 1):
        e, f = rng.choice(pool, len(x), replace=False), rng.choice(pool, len(y), replace=False)
        got = walk(e, f)
        for m in MEASURES:
            beyond[m] += got[m] > seen[m] + 1e-9
    return {m: beyond[m] / replicates for m in MEASURES}, seen


def test_count_pvalues_agree_with_literal_resampling(spark):
    r = np.random.default_rng(9)
    x, y = r.normal(0, 1, 60).round(1), r.normal(0.2, 1, 50).round(1)
    want, seen = literal_pvalues(x, y, 400, 1)
    df = rows_of(spark, x, y)
    got = {r["measure"]: r for r in significance.distance_pvalues(df, ["v"], replicates=400, seed=3, bucket_size=16).collect()}
    for m in MEASURES:
        assert got[m]["distance"] == pytest.approx(seen[m], abs=1e-9)
        assert got[m]["p_value"] == pytest.approx(want[m], abs=0.11), m


def test_count_pvalues_do_not_depend_on_partitioning(spark):
    r = np.random.default_rng(10)
    df = rows_of(spark, r.integers(0, 40, 80), r.integers(3, 45, 70))
    runs = []
    for n, layout in [(1, "window"), (6, "split")]:
        found = significance.distance_pvalues(df.repartition(n), ["v"], replicates=60, seed=5, bucket_size=8, layout=layout)
        runs.append({r["measure"]: (round(r["distance"], 9), r["p_value"]) for r in found.collect()})
    assert runs[0] == runs[1]


def test_hash_pvalues_do_not_depend_on_partitioning(spark):
    r = np.random.default_rng(11)
    df = rows_of(spark, r.integers(0, 40, 50), r.integers(3, 45, 40))
    runs = [
        significance.hash_pvalues(df.repartition(n), ["v"], "CVM", ["row_key"], 20, 1, max_keys=k).collect()
        for n, k in [(1, 1), (5, None)]
    ]
    assert runs[0] == runs[1]


def test_drawn_sizes(spark):
    df = rows_of(spark, range(30), range(20))
    drawn = significance.resample_rows(df, ["class"], ["row_key"], 5, 1, max_keys=1)
    sizes = drawn.groupBy("b").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()
    assert sorted((r["b"], r["x"], r["y"]) for r in sizes) == [(b, 30, 20) for b in range(1, 5)]
    permuted = significance.resample_rows(df, ["class"], ["row_key"], 5, 1, method="permutation", max_keys=1)
    assert permuted.filter(F.col("x") + F.col("y") != 1).count() == 0


def test_buckets_add_up():
    r = np.random.default_rng(12)
    value = np.cumsum(r.random(40) + 0.1)
    x, y = r.integers(0, 3, 40), r.integers(0, 3, 40)
    following = np.append(value[1:], np.nan)
    nx, ny = int(x.sum()), int(y.sum())
    whole = significance.partial_measures(x, y, value, following, 0, 0, nx, ny, 2)
    a = significance.partial_measures(x[:17], y[:17], value[:17], following[:17], 0, 0, nx, ny, 2)
    b = significance.partial_measures(x[17:], y[17:], value[17:], following[17:], int(x[:17].sum()), int(y[:17].sum()), nx, ny, 2)
    assert [p + q for p, q in zip(a[:4], b[:4])] == pytest.approx(list(whole[:4]))
    assert (max(a[4], b[4]), min(a[5], b[5])) == pytest.approx(whole[4:])
    want = walk(np.repeat(value, x), np.repeat(value, y))
    assert whole[:4] == pytest.approx((want["Anderson_Darling"], want["CVM"], want["DTS"], want["Wasserstein"]))


def test_large_hypergeometric():
    rng = np.random.default_rng(13)
    good, bad, n = 3 * 10**11, 7 * 10**11, 4 * 10**11
    draws = np.array([significance.hypergeometric(rng, good, bad, n) for _ in range(40)], dtype=float)
    mean = n * 0.3
    sd = math.sqrt(n * 0.3 * 0.7 * (10**12 - n) / (10**12 - 1))
    assert abs(draws.mean() - mean) < 5 * sd / math.sqrt(40)
    assert 0.6 < draws.std() / sd < 1.5
    assert significance.hypergeometric(rng, 5, 10**12, 0) == 0
    parts = significance.split_draw(rng, np.array([10**11, 2 * 10**11, 7 * 10**11]), 10**7)
    assert parts.sum() == 10**7 and (parts >= 0).all()


def test_chernoff_known_values(spark):
    eye = [[1, 0], [0, 1]]
    two = [[2, 0], [0, 2]]
    assert significance.chernoff_from_moments((1, 2), (1, 2), eye, eye) == pytest.approx(0.0)
    want = 0.125 * 8 / 1.5 + 0.5 * math.log(2.25 / math.sqrt(1 * 4))
    assert significance.chernoff_from_moments((1, 2), (3, 4), eye, two) == pytest.approx(want)
    rows = [("train", 1.0), ("train", 3.0), ("runtime", 5.0), ("runtime", 9.0)]
    got = significance.chernoff_univariate(spark.createDataFrame(rows, "side string, v double"), ["v"]).first()
    assert got["chernoff"] == pytest.approx(0.25 * math.log(0.25 * (1 / 4 + 4) + 0.5) + 0.25 * 25 / 5)


def test_knn_equals_brute_force(spark):
    r = np.random.default_rng(14)
    train = np.vstack([r.normal(0, 1, (300, 3)), r.normal(2, 1, (150, 3)), np.ones((150, 3))]).round(2)
    labels = r.integers(0, 3, len(train))
    test = r.normal(1, 1.5, (120, 3)).round(2)
    keys = [f"t{i:04d}" for i in range(len(train))]
    want = {}
    for i, q in enumerate(test):
        d = ((train[:, 0] - q[0]) ** 2 + (train[:, 1] - q[1]) ** 2) + (train[:, 2] - q[2]) ** 2
        near = sorted(zip(d, keys, labels))[:5]
        votes = {}
        for _, _, c in near:
            votes[int(c)] = votes.get(int(c), 0) + 1
        want[f"q{i}"] = min(votes, key=lambda c: (-votes[c], c))
    left = spark.createDataFrame([(k, int(c), *map(float, v)) for k, c, v in zip(keys, labels, train)], "row_key string, label int, a double, b double, c double")
    right = spark.createDataFrame([(f"q{i}", *map(float, v)) for i, v in enumerate(test)], "row_key string, a double, b double, c double")
    found = neighbours.knn_classify(left, right, ["a", "b", "c"], "label", pivots=12, block_rows=40)
    assert {r["row_key"]: r["prediction"] for r in found.collect()} == want


def test_sampling_is_exact_and_repeatable(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("g"))
    runs = [set(r["k"] for r in sample.sample_by_key(df.repartition(n), "g", {0: 0.2}, ["k"]).collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 150 + 250
    sized = sample.resample_to_size(df, "g", {0: 100, 1: 900, 2: 50}, ["k"])
    assert {r["g"]: r["count"] for r in sized.groupBy("g").count().collect()} == {0: 100, 1: 900}
    assert sized.filter("g = 0").distinct().count() == 100
    folds = sample.stratified_kfold(df, "g", 10, ["k"], seed=1).groupBy("g", "fold").count().collect()
    assert {(r["g"], r["count"]) for r in folds} == {(0, 75), (1, 25)}
    assert sample.random_split(df, 0.3, ["k"]).filter("split = 'test'").count() == 300
    assert sample.stratified_split(df, "g", 0.33, ["k"]).filter("split = 'test' and g = 1").count() == 83
    assert sample.head_sample(df, ["k"]).count() == 50
    assert sample.sample_by_key(df, "g", {0: 0.0}, ["k"]).count() == 250


@pytest.mark.parametrize(
    "name,module,function,wanted",
    [
        ("k10_pvalues_from_counts", significance, "distance_pvalues", {"replicates": 1000}),
        ("k11_position_distance_map_from_counts", significance, "position_distance_map", {"replicates": 1000}),
        ("r8_permutation_study", study, "permutation_study", {"permutations": 100, "epochs": 50}),
    ],
)
def test_queries_run_the_whole_number_of_replicates(spark, sf, monkeypatch, name, module, function, wanted):
    signature, seen = inspect.signature(getattr(module, function)), {}

    def called(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        for key, value in bound.arguments.items():
            seen.update(value if signature.parameters[key].kind is inspect.Parameter.VAR_KEYWORD else {key: value})

    monkeypatch.setattr(module, function, called)
    catalog.QUERIES[name](spark, sf)
    assert {k: seen[k] for k in wanted} == wanted
