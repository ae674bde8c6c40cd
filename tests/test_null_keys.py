"""Null is a key like any other, in either layout and in every shared helper."""

import pytest
from pyspark.sql import functions as F

from driftwarden.operators import distance, sample
from driftwarden.plans.draws import hash_ranks
from driftwarden.plans.ranks import exact_quantiles, prefix_sums, row_numbers
from driftwarden.plans.scale import lookup_join, null_safe_join

LAYOUTS = ["window", "split"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, None if i % 4 == 0 else i % 2, float(i % 7)) for i in range(40)]
    return spark.createDataFrame(data, "id long, label int, value double")


@pytest.mark.parametrize("layout", LAYOUTS)
def test_row_numbers(rows, layout):
    found = row_numbers(rows, ["id"], "n", ["label"], layout).collect()
    assert sorted(r.n for r in found if r.label is None) == list(range(1, 11)) and len(found) == 40


@pytest.mark.parametrize("layout", LAYOUTS)
def test_prefix_sums_and_quantiles(rows, layout):
    counts = rows.groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"))
    found = prefix_sums(counts, ["label"], "value", ["n"], layout).filter("label is null").collect()
    assert max(r.cum_n for r in found) == 10 and {r.all_n for r in found} == {10}
    assert exact_quantiles(rows, ["label"], "value", [0.5], layout).count() == 3


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("seed", [None, 3])
def test_kfold(rows, layout, seed):
    found = sample.stratified_kfold(rows, "label", 5, ["id"], seed=seed, layout=layout).collect()
    assert len(found) == 40 and sorted(r.fold for r in found if r.label is None) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_stratified_split(rows):
    found = sample.stratified_split(rows, "label", 0.3, ["id"]).collect()
    assert sum(r.split == "test" for r in found if r.label is None) == 3 and len(found) == 40


def test_hash_ranks(rows):
    drawn = rows.withColumn("h", F.md5(F.col("id").cast("string")))
    found = hash_ranks(drawn, ["label"], "h", ["id"], "n").collect()
    assert sorted(r.n for r in found if r.label is None) == list(range(1, 11))


@pytest.mark.parametrize("layout", LAYOUTS)
def test_distances(rows, layout):
    sliced = rows.select(F.col("label").alias("class"), F.when(F.col("id") < 20, "train").otherwise("runtime").alias("side"), "value")
    found = distance.feature_distances(sliced, ["value"], layout=layout).collect()
    assert sorted((r["class"] is None, r["class"]) for r in found) == [(False, 0), (False, 1), (True, None)]


def test_joins(spark):
    left = spark.createDataFrame([(None, 1), (1, 2), (2, 3)], "k int, a int")
    right = spark.createDataFrame([(None, 7), (1, 8)], "k int, b int")
    want = [(None, 1, 7), (1, 2, 8)]
    assert sorted(map(tuple, null_safe_join(left, right, ["k"]).collect()), key=repr) == sorted(want, key=repr)
    for rows in (None, 2, "check"):
        found = [tuple(r) for r in lookup_join(left, right, ["k"], rows, "left").collect()]
        assert sorted(found, key=repr) == sorted([*want, (2, 3, None)], key=repr)
