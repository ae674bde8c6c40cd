"""Traffic windows and rate bands over a stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from driftwarden.operators.traffic import MEANS, rate_bands, traffic_windows
from driftwarden.sources.files import existing_paths


def stream_traffic(
    flows: DataFrame, every: str = "30 seconds", watermark: str | None = "10 minutes", timestamp: str = "timestamp"
) -> DataFrame:
    """Windows and bands of a scored stream. Rows later than the watermark are left out and closed
    windows leave the state; without a watermark the state keeps every window (complete mode)."""
    # Watermarks need TIMESTAMP; files often hold TIMESTAMP_NTZ.
    timed = flows.withColumn(timestamp, F.col(timestamp).cast("timestamp"))
    if watermark:
        timed = timed.withWatermark(timestamp, watermark)
    return rate_bands(traffic_windows(timed, every, timestamp))


def write_windows(windows: DataFrame, checkpoint: str, mode: str = "append", drain: bool = False) -> DataStreamWriter:
    """Writer with the 30-second refresh, or, with ``drain``, all available data and then the end."""
    writer = windows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if drain else writer.trigger(processingTime="30 seconds")


PARTIALS = "window_start timestamp, batch_id long, flows long, anomalies long, " + ", ".join(
    f"sum_{c} double, rows_{c} long" for c in ["prediction_probability", *MEANS]
)
SEEN = "batch_id long, newest timestamp"


@dataclass
class TrafficLedger:
    """Traffic windows of a stream in which no row is lost without a trace.

    Each micro-batch leaves sums per window in a folder of its own, named by the batch, so a batch that runs again
    overwrites exactly what it wrote. The watermark of a batch is the newest time in earlier batches
    less ``delay``. A row whose window had ended by then is not added to it; it goes to the table of late rows, with the
    watermark that refused it. Rows with a null time count as late too. Windows and late rows together
    are the rows that came in.
    """

    spark: SparkSession
    folder: str
    every: str = "30 seconds"
    delay: str = "10 minutes"
    timestamp: str = "timestamp"

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _write(self, rows: DataFrame, batch_id: int, name: str) -> None:
        named = rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self._path(name))

    def watermark(self, batch_id: int):
        """The time before which windows are closed for a batch; None before the first."""
        if not existing_paths(self.spark, [self._path("seen")]):
            return None
        earlier = self.spark.read.schema(SEEN).parquet(self._path("seen")).filter(F.col("batch_id") < batch_id)
        return earlier.agg((F.max("newest") - F.expr(f"INTERVAL {self.delay}")).alias("w")).first().w

    def update(self, batch: DataFrame, batch_id: int) -> None:
        at = F.lit(self.watermark(batch_id)).cast("timestamp")
        time = F.col(self.timestamp).cast("timestamp")
        # A window of a null time would drop the row.
        window = F.window(F.coalesce(time, F.timestamp_seconds(F.lit(0))), self.every)
        rows = batch.withColumns({"_start": window["start"], "_late": time.isNull() | F.coalesce(window["end"] <= at, F.lit(False))})
        values = {c: F.col(c).cast("double") if c in batch.columns else F.lit(None).cast("double") for c in ["prediction_probability", *MEANS]}
        sums = [f for c, v in values.items() for f in (F.sum(v).alias(f"sum_{c}"), F.count(v).alias(f"rows_{c}"))]
        counted = rows.filter(~F.col("_late")).groupBy(F.col("_start").alias("window_start")).agg(
            F.count(F.lit(1)).alias("flows"), F.sum("prediction").cast("long").alias("anomalies"), *sums
        )
        self._write(counted, batch_id, "windows")
        self._write(rows.filter("_late").select(*batch.columns, at.alias("refused_by")), batch_id, "late")
        self._write(batch.agg(F.max(time).alias("newest")), batch_id, "seen")

    def windows(self) -> DataFrame:
        """The figures of ``traffic_windows`` over all rows that came in time."""
        if not existing_paths(self.spark, [self._path("windows")]):
            stored = self.spark.createDataFrame([], PARTIALS)
        else:
            stored = self.spark.read.schema(PARTIALS).parquet(self._path("windows"))

        def mean(c: str):
            return F.try_divide(F.sum(f"sum_{c}"), F.sum(f"rows_{c}"))

        flows = F.sum("flows")
        return stored.groupBy("window_start").agg(
            flows.alias("total_flows"),
            F.sum("anomalies").alias("anomaly_count"),
            (F.sum("anomalies") / flows).alias("anomaly_rate"),
            mean("prediction_probability").alias("avg_probability"),
            *[mean(c).alias(c) for c in MEANS],
        )

    def late(self) -> DataFrame | None:
        """The rows that came too late, with ``refused_by`` and ``batch_id``; None if no batch has run."""
        if not existing_paths(self.spark, [self._path("late")]):
            return None
        return self.spark.read.parquet(self._path("late"))

    def start(self, flows: DataFrame, checkpoint: str, drain: bool = False) -> StreamingQuery:
        writer = flows.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime="30 seconds")).start()
