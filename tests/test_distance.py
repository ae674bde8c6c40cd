"""The distances against a literal walk over the pooled rows, and against known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwarden.operators import clean, distance
from driftwarden.operators.distance import MEASURES


def walk(x, y, less=2):
    """Row by row through the pooled sample, as the definition says it."""
    nx, ny = len(x), len(y)
    n = nx + ny
    pool = sorted([(v, 1 / nx, 0.0) for v in x] + [(v, 0.0, 1 / ny) for v in y])
    e = f = 0.0
    out = dict.fromkeys(MEASURES, 0.0)
    up = down = 0.0
    for i in range(n - less):
        e, f = e + pool[i][1], f + pool[i][2]
        g = (i + 1) / n
        sd = math.sqrt(n * g * (1 - g))
        gap = pool[i + 1][0] - pool[i][0]
        h = f - e
        if gap != 0:
            out["Anderson_Darling"] += abs(h) / sd if sd > 0 else 0
            out["CVM"] += abs(h)
            out["DTS"] += abs(h) / sd * gap if sd > 0 else 0
            out["Wasserstein"] += abs(h) * gap
            up, down = max(up, h), min(down, h)
    out["Kolmogorov_Smirnov"], out["Kuiper"] = max(up, -down), up - down
    return out


def measure(spark, x, y, **options):
    rows = [(0, "train", float(v)) for v in x] + [(0, "runtime", float(v)) for v in y]
    df = spark.createDataFrame(rows, "class int, side string, v double").repartition(3)
    return distance.feature_distances(df, ["v"], **options).first().asDict()


CASES = {
    "ties": (lambda r: (r.integers(0, 8, 60), r.integers(2, 10, 45))),
    "continuous": (lambda r: (r.normal(1, 1, 80), r.normal(3, 1, 70))),
    "top_once": (lambda r: (np.arange(20), np.arange(5, 25))),
    "tiny": (lambda r: (np.array([1.0]), np.array([2.0, 5.0]))),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("boundary", ["reference", "full"])
@pytest.mark.parametrize("layout", ["window", "split"])
def test_equals_walk(spark, name, boundary, layout):
    x, y = CASES[name](np.random.default_rng(5))
    want = walk([float(v) for v in x], [float(v) for v in y], {"reference": 2, "full": 1}[boundary])
    got = measure(spark, x, y, boundary=boundary, layout=layout)
    for m in MEASURES:
        assert got[m] == pytest.approx(want[m], abs=1e-9), m


def test_identical_samples_give_zero(spark):
    got = measure(spark, [1, 2, 2, 5], [1, 2, 2, 5])
    assert all(got[m] == 0 for m in MEASURES)


def test_disjoint_samples(spark):
    got = measure(spark, [1, 2, 3], [10, 11, 12])
    assert got["Kolmogorov_Smirnov"] == pytest.approx(1.0)
    assert got["Kuiper"] == pytest.approx(1.0)


def test_shift_is_wasserstein_with_full_boundary(spark):
    x = np.random.default_rng(1).normal(0, 1, 50)
    assert measure(spark, x, x + 2.5, boundary="full")["Wasserstein"] == pytest.approx(2.5)


def test_sides_can_be_swapped(spark):
    r = np.random.default_rng(2)
    x, y = r.integers(0, 30, 40), r.integers(5, 40, 55)
    a, b = measure(spark, x, y), measure(spark, y, x)
    for m in MEASURES:
        assert a[m] == pytest.approx(b[m])


def test_fewer_than_three_rows_give_zero(spark):
    assert all(measure(spark, [1], [2])[m] == 0 for m in MEASURES)


def test_pooled_maximum_once_and_twice(spark):
    # Two rows at the top keep the step before it, one row there does not.
    assert measure(spark, [1, 1], [4, 4])["Wasserstein"] == pytest.approx(3.0)
    assert measure(spark, [1, 1, 1], [4])["Wasserstein"] == 0


def test_empty_side_and_absent_class_give_nan(spark):
    rows = [(0, "train", 1), (0, "train", 2), (1, "train", 1), (1, "runtime", 3), (1, "runtime", 4)]
    df = spark.createDataFrame(rows, "class int, side string, v long")
    got = {r["class"]: r for r in distance.class_distances(df, ["v"], [0, 1, 2], accuracy=1.0).collect()}
    assert set(got) == {0, 1, 2}
    assert all(math.isnan(got[0][m]) and math.isnan(got[2][m]) for m in MEASURES)
    assert not any(math.isnan(got[1][m]) for m in MEASURES)
    keyed = df.withColumn("run", F.lit("a"))
    again = {r["class"]: r for r in distance.class_distances(keyed, ["v"], [0, 1, 2], keys=["run"]).collect()}
    assert set(again) == {0, 1, 2} and math.isnan(again[2]["CVM"]) and again[1]["CVM"] == got[1]["CVM"]


def test_hot_value_and_partitioning_do_not_matter(spark):
    r = np.random.default_rng(3)
    rows = [(0, "train" if i % 2 else "runtime", int(v)) for i, v in enumerate(np.where(r.random(3000) < 0.4, 7, r.integers(0, 500, 3000)))]
    df = spark.createDataFrame(rows, "class int, side string, v long")
    seen = [distance.feature_distances(df.repartition(n), ["v"], layout=l).first().asDict() for n, l in [(1, "window"), (7, "split"), (3, "split")]]
    for other in seen[1:]:
        for m in MEASURES:
            assert other[m] == pytest.approx(seen[0][m], rel=1e-12)


def test_fold_distances_equal_plain_ones(spark):
    r = np.random.default_rng(4)
    rows = [(0, int(i % 3), int(v)) for i, v in enumerate(r.integers(0, 20, 90))]
    df = spark.createDataFrame(rows, "class int, fold int, v long")
    folds = {r["run"]: r for r in distance.fold_distances(df, ["v"], "fold", 3).collect()}
    for k in range(3):
        x = [v for _, f, v in rows if f != k]
        y = [v for _, f, v in rows if f == k]
        assert folds[k]["CVM"] == pytest.approx(walk(x, y)["CVM"])


def test_class_slices_use_label_and_prediction(spark):
    train = spark.createDataFrame([(1, 0, 5)], "label int, prediction int, v int")
    runtime = spark.createDataFrame([(1, 0, 6)], "label int, prediction int, v int")
    got = {(r["side"], r["class"]) for r in clean.class_slices(train, runtime, ["v"]).collect()}
    assert got == {("train", 1), ("runtime", 0)}
