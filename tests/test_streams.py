"""Streams: late rows, repeated batches, and agreement with the batch operators."""

import datetime as dt
import math

from pyspark.sql import functions as F

from driftwarden import sources
from driftwarden.operators.clean import class_slices
from driftwarden.operators.decide import verdict
from driftwarden.operators.distance import MEASURES, class_distances, to_long_form
from driftwarden.operators.traffic import rate_bands, traffic_windows
from driftwarden.plans.scale import scratch_path
from driftwarden.streaming import DriftMonitor, TrafficLedger, WindowedDrift, stream_traffic, write_windows
from driftwarden.streaming.drift import training_counts

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "timestamp timestamp, prediction int, prediction_probability double"


def at(seconds, p=0.9):
    return (T0 + dt.timedelta(seconds=seconds), int(p > 0.5), p)


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def drain(spark, path, checkpoint, name, out):
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = sources.read_flow_stream(spark, path, schema, fmt="parquet", max_files=1)
    windows = stream_traffic(stream, "30 seconds", watermark="1 minute")
    writer = write_windows(windows.select("window_start", "total_flows"), checkpoint, "append", drain=True)
    writer.format("parquet").option("path", out).start().awaitTermination()
    return {r["window_start"]: r["total_flows"] for r in spark.read.parquet(out).collect()}


def test_late_rows_are_left_out_in_append_mode(spark):
    path, checkpoint, out = (scratch_path(spark, n) for n in ("in", "ck", "out"))
    land(spark, path, [at(0), at(10), at(200)])
    drain(spark, path, checkpoint, "a", out)
    land(spark, path, [at(5)])  # its window closed with the watermark at 140 s
    drain(spark, path, checkpoint, "b", out)
    land(spark, path, [at(600)])
    got = drain(spark, path, checkpoint, "c", out)
    assert got[T0] == 2
    assert got[T0 + dt.timedelta(seconds=180)] == 1


def test_missing_traffic_column_is_null(spark):
    df = spark.createDataFrame([at(1), at(2, 0.2)], SCHEMA)
    row = rate_bands(traffic_windows(df)).first()
    assert row["flow_byts_s"] is None and row["anomaly_percent"] == 50.0 and row["rate_band"] == "High"


def test_drift_monitor_equals_batch_and_repeats_safely(spark):
    import numpy as np

    r = np.random.default_rng(8)
    train = spark.createDataFrame([(int(c), int(v)) for c, v in zip(r.integers(0, 2, 400), r.integers(0, 50, 400))], "label int, v long")
    rows = [(T0 + dt.timedelta(minutes=int(m)), int(p), int(v)) for m, p, v in zip(r.integers(0, 120, 300), r.integers(0, 2, 300), r.integers(10, 60, 300))]
    scored = spark.createDataFrame(rows, "timestamp timestamp, prediction int, v long")
    base = spark.createDataFrame([("run0", c, 0.95, m, 1.5) for c in (0, 1) for m in MEASURES], "run_id string, class int, accuracy double, measure string, distance double")
    digest = training_counts(train, ["v"])
    monitor = DriftMonitor(spark, scratch_path(spark, "drift"), digest, base, ["v"], [0, 1], layout="window")
    first, second = scored.filter("v % 2 = 0"), scored.filter("v % 2 = 1")
    monitor.update(first, 0)
    monitor.update(second, 1)
    once = {r["window_start"]: r for r in monitor.verdicts().collect()}
    monitor.update(second, 1)  # the same batch again
    again = {r["window_start"]: r for r in monitor.verdicts().collect()}
    assert once == again and sum(r["rows"] for r in again.values()) == 300
    for hour in (0, 1):
        start = T0 + dt.timedelta(hours=hour)
        inside = scored.filter((F.col("timestamp") >= start) & (F.col("timestamp") < start + dt.timedelta(hours=1)))
        wide = class_distances(class_slices(train, inside, ["v"]), ["v"], [0, 1])
        want = verdict(base, to_long_form(wide, ["class"])).first()
        got = again[start]
        assert got["decision"] == want["decision"]
        assert math.isclose(got["overall_similarity"], want["overall_similarity"], rel_tol=1e-9)


def test_verdicts_before_any_batch(spark):
    digest = training_counts(spark.createDataFrame([(0, 1)], "label int, v long"), ["v"])
    monitor = DriftMonitor(spark, scratch_path(spark, "empty"), digest, digest, ["v"], [0, 1])
    assert monitor.verdicts().count() == 0


def drift_inputs(spark):
    train = spark.createDataFrame([(i % 2, i % 50) for i in range(400)], "label int, v long")
    base = spark.createDataFrame([("run0", c, 0.95, m, 1.5) for c in (0, 1) for m in MEASURES], "run_id string, class int, accuracy double, measure string, distance double")
    return training_counts(train, ["v"]), base


def test_state_holds_open_windows_alone(spark):
    """Windows close with the watermark, each once; rows for closed ones are told as late; state is dropped."""
    kind = "timestamp timestamp, prediction int, v double"
    path, checkpoint = scratch_path(spark, "in"), scratch_path(spark, "ck")
    digest, base = drift_inputs(spark)
    monitor = WindowedDrift(spark, scratch_path(spark, "drift"), digest, base, ["v"], [0, 1], layout="window", delay="10 minutes", shares=3)
    state_rows = []

    def run(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
        stream = sources.read_flow_stream(spark, path, spark.createDataFrame([], kind).schema, fmt="parquet", max_files=1)
        query = monitor.start(stream, checkpoint, drain=True)
        query.awaitTermination()
        state_rows.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]))
        return {r.window_start: r for r in monitor.verdicts().collect()}

    def minute(m):
        return T0 + dt.timedelta(minutes=m)

    first = [(minute(i % 60), i % 2, float(i % 37)) for i in range(240)] + [(minute(30), None, 1.0), (minute(30), 1, None)]
    assert run(first) == {}
    got = run([(minute(61), 1, 2.0), (minute(300), 0, 0.0)])
    assert sorted(got) == [T0, minute(60)] and got[T0].rows == 240 and got[minute(60)].rows == 1
    again = run([(minute(3), 1, 5.0), (minute(301), 0, -0.0)])
    assert repr(again) == repr(got)  # one similarity is NaN
    (late,) = monitor.late_rows().collect()
    assert (late.window_start, late["class"], late.value, late.n, late.watermark) == (T0, 1, 5.0, 1, minute(290))
    done = run([(dt.datetime(2200, 1, 1), None, None)])
    assert sorted(done) == [T0, minute(60), minute(300)] and done[minute(300)].rows == 2
    assert state_rows[-1] == 0 < state_rows[0]
    inside = spark.createDataFrame([r for r in first if r[1] is not None and r[2] is not None], kind)
    train = spark.createDataFrame([(i % 2, float(i % 50)) for i in range(400)], "label int, v double")
    want = verdict(base, to_long_form(class_distances(class_slices(train, inside, ["v"]), ["v"], [0, 1]), ["class"])).first()
    assert math.isclose(done[T0].overall_similarity, want.overall_similarity, rel_tol=1e-9) and done[T0].decision == want.decision


def test_replayed_batch_gives_the_same_verdicts(spark):
    digest, base = drift_inputs(spark)
    monitor = WindowedDrift(spark, scratch_path(spark, "drift"), digest, base, ["v"], [0, 1], layout="window")
    rows = [(T0, c, "v", float(v), 3, v > 8, T0) for c in (0, 1) for v in range(10)]
    batch = spark.createDataFrame(rows, "window_start timestamp, class int, feature string, value double, n long, late boolean, watermark timestamp")
    monitor.update(batch, 4)
    once = monitor.verdicts().collect(), sorted(monitor.late_rows().collect())
    monitor.update(batch, 4)
    assert repr((monitor.verdicts().collect(), sorted(monitor.late_rows().collect()))) == repr(once)
    assert once[0][0].rows == 2 * 9 * 3 and len(once[1]) == 2
    assert WindowedDrift(spark, scratch_path(spark, "none"), digest, base, ["v"], [0, 1]).late_rows().count() == 0


def test_ledger_loses_no_row(spark):
    ledger = TrafficLedger(spark, scratch_path(spark, "ledger"), "30 seconds", "1 minute")
    kind = SCHEMA + ", flow_byts_s double"
    batches = [
        [(*at(0), 1.0), (*at(10), None), (*at(200), 4.0)],
        [(*at(5, 0.2), 2.0), (*at(130), 2.0), (*at(600), 1.0)],  # watermark at 140 s: the first is late, the window of the second ends later
        [(None, 1, 0.9, 1.0), (*at(601, 0.1), 3.0)],
        [],
    ]
    frames = [spark.createDataFrame(rows, kind) for rows in batches]
    assert ledger.windows().count() == 0 and ledger.late() is None
    for number, batch in enumerate(frames):
        ledger.update(batch, number)
    once = sorted(ledger.windows().collect()), sorted(ledger.late().collect(), key=repr)
    for number in (1, 2, 1):
        ledger.update(frames[number], number)
    assert (sorted(ledger.windows().collect()), sorted(ledger.late().collect(), key=repr)) == once
    late = {(r.timestamp, r.refused_by, r.batch_id) for r in once[1]}
    assert late == {(at(5)[0], at(140)[0], 1), (None, at(540)[0], 2)}
    taken = [r for rows in batches for r in rows if r[0] is not None and r[:2] != at(5, 0.2)[:2]]
    want = {r.window_start: r for r in traffic_windows(spark.createDataFrame(taken, kind)).collect()}
    assert len(once[0]) == len(want)
    for r in once[0]:
        assert r.asDict() == want[r.window_start].asDict()
