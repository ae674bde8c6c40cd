"""Distances from sketches against the exact ones, within the stated bounds."""

import math

import numpy as np
import pytest

from driftwarden.operators import distance, sketched
from driftwarden.operators.sketched import SKETCHED


def sides(spark, x, y, parts=4):
    rows = [(0, "train", float(v)) for v in x] + [(0, "runtime", float(v)) for v in y]
    return spark.createDataFrame(rows, "class int, side string, v double").repartition(parts)


CASES = {
    "shifted": lambda r: (r.normal(0, 1, 30_000), r.normal(0.2, 1, 20_000)),
    "same": lambda r: (r.normal(0, 1, 20_000), r.normal(0, 1, 20_000)),
    "heavy_tail": lambda r: (r.pareto(1.5, 20_000), r.pareto(1.7, 9_000)),
    "atom": lambda r: (np.where(r.random(20_000) < 0.4, 0.0, r.random(20_000)), r.random(20_000)),
    "apart": lambda r: (r.random(9_000), 5 + r.random(9_000)),
    "few": lambda r: (np.array([1.0]), np.array([2.0, 5.0])),
}


@pytest.mark.parametrize("name", CASES)
def test_within_bounds(spark, name):
    df = sides(spark, *CASES[name](np.random.default_rng(3)))
    want = distance.feature_distances(df, ["v"], boundary="full").first()
    got = sketched.sketched_distances(df, ["v"]).first()
    for m in SKETCHED:
        assert abs(got[m] - want[m]) <= got[f"{m}_error"] + 1e-12, m


def test_small_sketch_has_a_wider_bound_and_keeps_it(spark):
    df = sides(spark, *CASES["shifted"](np.random.default_rng(4)))
    want = distance.feature_distances(df, ["v"], boundary="full").first()
    got = sketched.sketched_distances(df, ["v"], size=200, grid=100).first()
    assert got.Kolmogorov_Smirnov_error > sketched.height_error()
    for m in SKETCHED:
        assert abs(got[m] - want[m]) <= got[f"{m}_error"], m


def test_merged_days_are_all_rows(spark):
    x, y = CASES["shifted"](np.random.default_rng(5))
    days = sketched.value_sketches(sides(spark, x[::2], y[::2]), ["class"], ["v"])
    days = days.unionByName(sketched.value_sketches(sides(spark, x[1::2], y[1::2]), ["class"], ["v"]))
    got = sketched.sketch_distances(sketched.merged_sketches(days, ["class"]), ["class"]).first()
    want = distance.feature_distances(sides(spark, x, y), ["v"], boundary="full").first()
    assert (got.nx, got.ny) == (len(x), len(y))
    for m in SKETCHED:
        assert abs(got[m] - want[m]) <= got[f"{m}_error"], m


def test_missing_values_and_empty_sides(spark):
    rows = [(0, "train", 1.0), (0, "runtime", None), (0, "runtime", math.nan), (1, "train", 1.0), (1, "runtime", 3.0), (1, None, 9.0), (None, "train", 2.0), (None, "runtime", 2.0)]
    df = spark.createDataFrame(rows, "class int, side string, v double")
    found = {r["class"]: r for r in sketched.sketched_distances(df, ["v"]).collect()}
    assert (found[0].nx, found[0].ny) == (1, 0) and math.isnan(found[0].Wasserstein) and math.isnan(found[0].Kuiper_error)
    assert (found[1].nx, found[1].ny, found[1].Wasserstein) == (1, 1, pytest.approx(2.0))
    assert found[1].Kolmogorov_Smirnov == pytest.approx(1.0)
    assert found[None].Kuiper == 0.0
    assert sketched.sketched_distances(df.limit(0), ["v"]).collect() == []


def test_what_is_shuffled_does_not_follow_distinct_values(spark):
    df = sides(spark, np.arange(200_000.0), np.arange(200_000.0) + 0.5)
    row = sketched.value_sketches(df, ["class"], ["v"]).first()
    assert len(row.sx) + len(row.sy) < 300_000
