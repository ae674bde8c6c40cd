"""Streams drained to their end. The file source reads the events table in several files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from driftwarden import sources, views
from driftwarden.catalog.base import FLOW, TRAFFIC, query, with_ctes
from driftwarden.catalog.decisions import (
    BASELINE_SQL,
    BEST_SQL,
    ESTIMATED_SQL,
    RUNTIME_SQL,
    SIMILARITY_SQL,
    VOTED_SQL,
    WEIGHTED_SQL,
    baseline,
)
from driftwarden.catalog.reports import WINDOW_LIST, tidy_windows, window_sql
from driftwarden.operators import models
from driftwarden.plans.scale import scratch_path
from driftwarden.streaming import DriftMonitor, TrafficLedger, WindowedDrift, stream_traffic, write_windows
from driftwarden.streaming.drift import training_counts
from driftwarden.views import CLASSES, FEATURES


def spread(df, name: str, spark) -> str:
    """The rows as eight files in the shared folder, so that a stream takes several batches."""
    path = scratch_path(spark, name)
    df.repartition(8).write.parquet(path)
    return path


def traffic_stream(spark, sf_dir):
    rows = views.traffic_view(spark, sf_dir)
    path = spread(rows, "traffic", spark)
    return sources.read_flow_stream(spark, path, rows.schema, fmt="parquet", max_files=3)


def drained(spark, windows, mode: str):
    """The windows that a stream gives, written per batch; in complete mode those of its last batch."""
    path = scratch_path(spark, "drained")

    def keep(batch, batch_id):
        named = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    write_windows(windows, scratch_path(spark, "stream"), mode, drain=True).foreachBatch(keep).start().awaitTermination()
    stored = spark.read.parquet(path)
    if mode == "complete":
        stored = stored.filter(F.col("batch_id") == stored.agg(F.max("batch_id")).scalar())
    return stored.drop("batch_id")


@query(
    "t3_stream_traffic_complete",
    with_ctes(TRAFFIC, window_sql(3600), select=f"""
SELECT {WINDOW_LIST}, CASE WHEN anomaly_rate * 100 >= 50 THEN 'High' WHEN anomaly_rate * 100 >= 25 THEN 'Medium' ELSE 'Low' END AS rate_band FROM windows"""),
)
def t3(spark, sf_dir):
    found = drained(spark, stream_traffic(traffic_stream(spark, sf_dir), "1 hour", watermark=None), "complete")
    return tidy_windows(found).drop("anomaly_percent")


@query(
    "t3_stream_traffic_update",
    with_ctes(TRAFFIC, window_sql(3600), select=f"SELECT {WINDOW_LIST} FROM windows"),
)
def t3_update(spark, sf_dir):
    """Update mode with a watermark longer than the data: the last version of each window counts."""
    found = drained(spark, stream_traffic(traffic_stream(spark, sf_dir), "1 hour", watermark="60 days"), "update")
    others = [c for c in found.columns if c != "window_start"]
    last = found.groupBy("window_start").agg(F.max_by(F.struct(*others), "total_flows").alias("w")).select("window_start", "w.*")
    return tidy_windows(last).drop("anomaly_percent", "rate_band")


def ledger(spark, sf_dir, delay: str):
    kept = TrafficLedger(spark, scratch_path(spark, "ledger"), "1 hour", delay)
    kept.start(traffic_stream(spark, sf_dir), scratch_path(spark, "stream"), drain=True).awaitTermination()
    return kept


@query(
    "t3_stream_ledger_windows",
    with_ctes(TRAFFIC, window_sql(3600), select=f"SELECT {WINDOW_LIST} FROM windows"),
)
def t3_ledger(spark, sf_dir):
    """With a delay longer than the data no row is late, and the windows are those of a batch."""
    return tidy_windows(ledger(spark, sf_dir, "60 days").windows())


@query(
    "t3_stream_late_rows",
    with_ctes(TRAFFIC, select="SELECT count(*) AS rows, count(DISTINCT event_id) AS events, true AS some_late, 0::BIGINT AS early FROM traffic"),
)
def t3_late(spark, sf_dir):
    """With a delay of a day many rows come too late. Windows and late rows together are all rows, each late
    row's window had ended when its batch began, and no event is told twice."""
    kept = ledger(spark, sf_dir, "1 day")
    late = kept.late()
    early = F.count_if(F.window("timestamp", "1 hour")["end"] > F.col("refused_by"))
    told = late.agg(F.count(F.lit(1)).alias("n_late"), F.countDistinct("event_id").alias("events"), early.alias("early"))
    both = kept.windows().agg(F.sum("total_flows").alias("in_time")).join(told)
    return both.select(
        (F.col("in_time") + F.col("n_late")).alias("rows"),
        (F.col("in_time") + F.col("events")).alias("events"),
        (F.col("n_late") > 0).alias("some_late"),
        "early",
    )


@query(
    "t4_stream_drift_rows",
    with_ctes(FLOW, select="""
SELECT strftime(date_trunc('year', ts), '%Y') AS year, count(*) AS rows FROM flow WHERE side = 'runtime' GROUP BY 1"""),
)
def t4_rows(spark, sf_dir):
    """Rows that reached a verdict, per year: nothing is lost or counted twice."""
    return t4(spark, sf_dir).groupBy("year").agg(F.sum("rows").alias("rows"))


# The same chain as for batches, with one data set per year: all training rows against its rows.
YEARLY = """
years AS (SELECT strftime(ts, '%Y') AS data, count(*) AS rows FROM flow WHERE side = 'runtime' GROUP BY 1),
both_rows AS (
  SELECT data, label AS class, side, flow_duration, pkt_len_mean, pkt_size_avg, rst_flag_cnt FROM flow CROSS JOIN years WHERE side = 'train'
  UNION ALL
  SELECT strftime(ts, '%Y'), prediction, side, flow_duration, pkt_len_mean, pkt_size_avg, rst_flag_cnt FROM flow WHERE side = 'runtime')
"""


T4_SQL = with_ctes(*BASELINE_SQL, YEARLY, *RUNTIME_SQL[4:], BEST_SQL, SIMILARITY_SQL, WEIGHTED_SQL, ESTIMATED_SQL, VOTED_SQL, select="""
SELECT data AS year, decision, confidence_level,
  CASE WHEN decision = 'AUTONOMOUS' AND confidence_level = 'HIGH' THEN 1 WHEN decision = 'AUTONOMOUS' THEN 2 ELSE 3 END AS decision_code,
  round(overall_similarity, 4) AS overall_similarity, round(estimated_accuracy, 6) AS estimated_accuracy, rows
FROM voted JOIN estimated USING (data) JOIN years USING (data)""")


def drift_stream(spark, sf_dir, monitor_class, last=(), **options):
    """Verdicts on the runtime flows of each year, from a stream of scored rows in several files; the rows of
    ``last`` come in a file of their own."""
    flows = views.flow_view(spark, sf_dir)
    runtime = views.runtime_rows(flows).select(F.col("ts").alias("timestamp"), "prediction", *FEATURES).withColumn(
        "timestamp", F.date_trunc("year", F.col("timestamp").cast("timestamp"))
    )
    path = spread(runtime, "flows", spark)
    if last:
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runtime.schema)
        spark.createDataFrame(list(last), kind).coalesce(1).write.mode("append").parquet(path)
    stream = sources.read_flow_stream(spark, path, runtime.schema, fmt="parquet", max_files=3)
    stored = scratch_path(spark, "baseline")
    sources.save_baseline(baseline(spark, sf_dir), stored)
    monitor = monitor_class(
        spark, scratch_path(spark, "drift"), training_counts(views.train_rows(flows), FEATURES),
        sources.load_baseline(spark, stored), FEATURES, CLASSES, every="1 day", layout="window", **options,
    )
    monitor.start(stream, scratch_path(spark, "stream"), drain=True).awaitTermination()
    return monitor


def yearly(verdicts):
    return verdicts.select(
        F.date_format("window_start", "yyyy").alias("year"), "decision", "confidence_level", "decision_code",
        F.round("overall_similarity", 4).alias("overall_similarity"), F.round("estimated_accuracy", 6).alias("estimated_accuracy"), "rows",
    )


@query("t4_stream_drift", T4_SQL)
def t4(spark, sf_dir):
    return yearly(drift_stream(spark, sf_dir, DriftMonitor).verdicts())


@query("t4_stream_drift_state", T4_SQL)
def t4_state(spark, sf_dir):
    """The same from counts in the state store. A last row, far ahead and without a prediction, closes all windows."""
    end = (dt.datetime(2200, 1, 1), None, *[None] * len(FEATURES))
    return yearly(drift_stream(spark, sf_dir, WindowedDrift, [end], delay="20000 days").verdicts())


@query(
    "t5_read_flow_stream",
    with_ctes(TRAFFIC, select="SELECT event_id, event_type, flow_byts_s FROM traffic"),
)
def t5(spark, sf_dir):
    rows = traffic_stream(spark, sf_dir).select("event_id", "event_type", "flow_byts_s")
    path = scratch_path(spark, "landed")
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "stream"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query("m5_score_stream")
def m5_stream(spark, sf_dir):
    """A model fitted on the training rows scores a stream of runtime rows."""
    flows = views.flow_view(spark, sf_dir)
    columns = [*FEATURES, "syn_flag_cnt"]
    model = models.fit_logistic(views.train_rows(flows), columns)
    runtime = views.runtime_rows(flows).select("row_key", *columns)
    path = spread(runtime, "runtime", spark)
    scored = models.score(sources.read_flow_stream(spark, path, runtime.schema, fmt="parquet", max_files=3), model, columns)
    out = scratch_path(spark, "scored")
    writer = scored.select("row_key", "prediction", "risk_level").writeStream.format("parquet").option("path", out)
    writer.option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
