"""Row numbers over ranges: rows move once, and their places hold with null keys and repeated rows."""

from pyspark.sql import functions as F

from driftwarden.plans import ranks


def test_rows_are_not_shuffled_again(spark):
    rows = spark.range(5000).select((F.col("id") % 7 == 0).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("place"))
    found = ranks.row_numbers(rows, ["place"], "n", ["key"], "split")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan.split("Subquery")[0] and "Window" not in plan
    assert sorted(found.collect()) == sorted(ranks.row_numbers(rows, ["place"], "n", ["key"], "window").collect())


def test_null_keys_and_repeated_rows(spark):
    key = F.when(F.col("id") % 3 > 0, F.col("id") % 3)
    rows = spark.range(600).select(key.alias("key"), F.floor(F.col("id") / 6).alias("place"))
    found = ranks.row_numbers(rows, ["place"], "n", ["key"], "split")
    per_key = found.groupBy("key").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.countDistinct("n").alias("c"))
    assert {(r.a, r.b, r.c) for r in per_key.collect()} == {(1, 200, 200)}
    assert found.filter(F.floor((F.col("n") - 1) / 2) != F.col("place")).count() == 0
    assert ranks.row_numbers(rows.limit(0), ["place"], "n", layout="split").count() == 0


def test_kfold_takes_no_window_of_a_whole_label(spark, sf, monkeypatch):
    from driftwarden import catalog

    monkeypatch.setattr("driftwarden.plans.scale.SMALL_PLAN_BYTES", 1)
    folds = catalog.QUERIES["x5_kfold_null_labels"](spark, sf)
    assert "Window" not in folds._jdf.queryExecution().executedPlan().toString()
