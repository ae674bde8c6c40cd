"""Sources, cleaning edges and text tiers."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftwarden import sources
from driftwarden.operators import clean, evaluate, features, models, report, text
from driftwarden.plans.ranks import exact_quantiles
from driftwarden.plans.scale import scratch_path, shared_dir


def write_lines(spark, lines):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def test_csv_files_with_other_headers_bad_lines_and_gaps(spark):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("dst_port int, Label int, flow_duration double")
    a = write_lines(spark, ["dst_port,Label,flow_duration", "80,1,1.5", "x,0,2.5"])
    b = write_lines(spark, ["Label,extra,dst_port", "1,q,443"])
    c = write_lines(spark, ["dst_port,flow_duration", "9,1"])
    df = sources.read_flows(spark, [a, b, c, a + "-absent"], schema, required=["Label", "dst_port"])
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, [(80, 1, 1.5), (None, 0, 2.5), (443, 1, None)]))
    assert sources.read_flows(spark, [a + "-absent"], schema).count() == 0
    kept = sources.read_flows(spark, [a], schema, keep_corrupt=True).filter(F.col("_corrupt_record").isNotNull())
    assert [r["_corrupt_record"] for r in kept.select("*").cache().collect()] == ["x,0,2.5"]


def test_require_columns(spark):
    with pytest.raises(ValueError, match="missing columns"):
        sources.require_columns(spark.range(1), ["absent"])


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark).rstrip("/") in scratch_path(spark, "x")


def test_to_long_edges(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), -3.9, 3.9, 1e300, -1e300]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["v"] for r in clean.sanitise_zero(df, ["v"]).orderBy("i").collect()]
    assert got[:6] == [0, 0, 0, 0, -3, 3]
    assert got[6] == 2**63 - 1024 and got[7] == -(2**63)


def test_binarise_rejects_three_classes(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "l string")
    with pytest.raises(PySparkException):
        clean.binarise_label(df, "l").collect()


def test_risk_and_decision_edges(spark):
    df = spark.createDataFrame([(0.5,), (0.8,), (0.8000001,), (float("nan"),), (None,)], "prediction_probability double")
    got = {r["risk_level"]: r["rows"] for r in report.risk_counts(df).collect()}
    assert got == {"Low": 3, "Medium": 1, "High": 1}


def test_metrics_with_zero_denominators(spark):
    row = evaluate.binary_metrics(spark.createDataFrame([(0, 0)], "label int, prediction int")).first()
    assert (row["precision"], row["recall"], row["f1"], row["specificity"]) == (0.0, 0.0, 0.0, 1.0)
    auc = evaluate.roc_auc(spark.createDataFrame([(0.3, 1)], "s double, label int"), "s").first()["roc_auc"]
    assert math.isnan(auc)


def test_wilson_known_value(spark):
    df = spark.createDataFrame([(0.5, 100)], "p double, n int")
    row = evaluate.wilson_interval(df, "p", "n", 1.96).first()
    assert (row["lower_bound"], row["upper_bound"]) == (pytest.approx(0.40383, abs=1e-5), pytest.approx(0.59617, abs=1e-5))


@pytest.mark.parametrize("layout", ["window", "split"])
def test_exact_quantiles(spark, layout):
    import numpy as np

    values = np.random.default_rng(1).integers(0, 30, 101)
    df = spark.createDataFrame([(0, float(v)) for v in values], "g int, v double")
    row = exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.37, 1.0], layout).first()
    assert [row[f"q{i}"] for i in range(4)] == pytest.approx(list(np.quantile(values, [0.0, 0.25, 0.37, 1.0])))


def test_histogram_of_one_value(spark):
    rows = report.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r["rows"] for r in rows] == [0, 0, 2, 0]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = features.standardise(df, df, ["a", "b"]).orderBy("a").collect()
    assert [(r["a_z"], r["b_z"]) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]


def test_text_tiers_and_rollup(spark):
    lines = ["a highlight", "Suspicious port", "nothing", None, "CRITICAL"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    tagged = text.tag_text(df, "t")
    assert [r["threat_level"] for r in tagged.orderBy("i").collect()] == ["HIGH", "MEDIUM", "LOW", "LOW", "HIGH"]
    assert text.threat_rollup(tagged).first()["overall_threat_level"] == "HIGH"
    assert text.threat_rollup(tagged.filter("i > 9")).first()["overall_threat_level"] == "UNKNOWN"
    medium = text.threat_rollup(tagged.filter("i in (1, 2)")).first()
    assert medium["overall_threat_level"] == "LOW"  # exactly half is not above half


def test_mlp_learns_and_stops(spark):
    rows = [(float(i % 20), float(i % 7), int(i % 20 >= 10)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    fit = models.fit_mlp(df, ["a", "b"], hidden=(4,), epochs=60, block=20, patience=2)
    assert evaluate.binary_metrics(models.score(df, fit.model, ["a", "b"])).first()["accuracy"] > 0.95
    assert fit.history.count() <= 3 and fit.summary.first()["best_accuracy"] > 0.9
    with pytest.raises(ValueError):
        models.score(df.drop("b"), fit.model, ["a", "b"])


def test_files_of_one_folder_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("dst_port,Label,flow_duration\n80,1,5.5\n443,0,6.5\n")
    (tmp_path / "b.csv").write_text("flow_duration, dst_port ,Label\n300,22,1\n")
    (tmp_path / "c.csv").write_text("dst_port,flow_duration\n1,2\n")
    (tmp_path / "d.csv").write_text("")
    path = str(tmp_path)
    rows = sources.read_flows(spark, [path], required=["Label"]).collect()
    assert sorted((r.dst_port, r.Label, r.flow_duration) for r in rows) == [(22, 1, 300.0), (80, 1, 5.5), (443, 0, 6.5)]
    skipped = sources.skipped_files(spark, [path], ["Label"]).collect()
    assert [(r.path.rsplit("/", 1)[1], r.missing) for r in skipped] == [("c.csv", ["Label"])]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert sources.csv_headers(spark, [path + "/*.csv"]) and spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_a_run_saved_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "runs")
    kind = "run_id string, accuracy double, measure string, distance double, class int"
    rows = [(run, 0.9, m, 0.1, k) for run in ("a", "b/1", None) for m in ("ks", "ad") for k in (0, 1)]
    runs = spark.createDataFrame(rows, kind)
    with pytest.raises(FileNotFoundError):
        sources.load_runs(spark, path)
    sources.save_runs(runs, path)
    sources.save_runs(runs, path)
    assert sorted(sources.load_runs(spark, path).collect(), key=repr) == sorted(runs.collect(), key=repr)
    sources.save_runs(spark.createDataFrame([("b/1", 0.5, "ks", 0.2, 1)], kind).withColumn("extra", F.lit(1)), path)
    assert [tuple(r) for r in sources.load_runs(spark, path, "b/1").collect()] == [("b/1", 0.5, "ks", 0.2, 1)]
    assert sources.load_runs(spark, path).count() == 9
    sources.save_runs(runs.limit(0), path)
    assert sources.load_runs(spark, path).count() == 9


def test_runs_saved_at_the_same_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path, kind = str(tmp_path / "runs"), "run_id string, accuracy double, measure string, distance double, class int"
    saves = [spark.createDataFrame([(f"run{i}", 0.9, "ks", i / 10, k) for k in (0, 1)], kind) for i in range(4)]
    sources.save_runs(saves[0], path)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda df: sources.save_runs(df, path), saves))
    assert sources.load_runs(spark, path).count() == 8
    doubled = saves[1].union(saves[1])
    sources.save_runs(doubled, path)
    with pytest.raises(ValueError, match="run1"):
        sources.load_runs(spark, path)
