"""Counts of hash draws: those of the drawn rows, without a copy of a row per replicate."""

import pytest
from pyspark.sql import functions as F

from driftwarden.operators import significance
from driftwarden.operators.distance import melt


@pytest.mark.parametrize("method", ["bootstrap", "permutation"])
def test_counts_are_those_of_the_drawn_rows(spark, method):
    rows = spark.range(400).select(
        F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("class"), F.when(F.col("id") % 3 > 0, "train").otherwise("runtime").alias("side"),
        (F.col("id") % 350).cast("string").alias("row_key"), (F.col("id") % 9).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 4).alias("b2"),
    )
    drawn = significance.resample_rows(rows, ["class"], ["row_key"], 13, 5, method=method)
    want = melt(drawn, ["class", "b", "x", "y"], ["a", "b2"]).filter("value is not null").groupBy("class", "b", "feature", "value")
    want = want.agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    found = significance.drawn_counts(rows, ["class"], ["a", "b2"], ["row_key"], 13, 5, method=method)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert found.select("b").distinct().count() == 12
