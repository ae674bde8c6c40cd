"""Drift verdicts from keyed state: each window's counts live in the state store until the window closes.

A micro-batch is reduced to counts per (window, class, feature, value) inside its tasks. The counts are
added to state that is keyed by window, class, feature and a share of the values, so a busy window is spread over many
tasks. A timer at the end of the window hands its counts over once, when the watermark has passed, and drops
them; the state follows the open windows, and no batch reads what earlier ones wrote. Rows that come after their window has closed
are handed over too, marked as late, with the watermark that refused them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from driftwarden.sources.files import existing_paths
from driftwarden.streaming.drift import DriftMonitor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTED = "window_start timestamp, class int, feature string, share int, value double, n long"
HANDED = "window_start timestamp, class int, feature string, value double, n long, late boolean, watermark timestamp"
LATE = "batch_id long, window_start timestamp, class int, feature string, value double, n long, watermark timestamp"


def merge_counts(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the sums of their counts."""
    distinct, where = np.unique(values, return_inverse=True)
    return distinct, np.bincount(where, counts, len(distinct)).astype(np.int64)


class WindowCounts(StatefulProcessor):
    """Counts of one (window, class, feature, share) until its window closes."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "values_ binary, counts_ binary")

    def _rows(self, key: tuple, values: np.ndarray, counts: np.ndarray, late: bool, watermark: int) -> pd.DataFrame:
        start, class_, feature, _ = key
        return pd.DataFrame(
            {
                "window_start": pd.Series([pd.Timestamp(start)] * len(values), dtype="datetime64[us]"),
                "class": pd.Series([class_] * len(values), dtype="Int32"),
                "feature": feature,
                "value": values,
                "n": counts,
                "late": late,
                "watermark": pd.Series([pd.Timestamp(watermark, unit="ms")] * len(values), dtype="datetime64[us]"),
            }
        )

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        values, counts = merge_counts(np.concatenate([p["value"] for p in parts]), np.concatenate([p["n"] for p in parts]))
        watermark = timerValues.getCurrentWatermarkInMs()
        end = int(pd.Timestamp(key[0]).value // 1_000_000) + self.window_ms
        if end <= watermark:
            yield self._rows(key, values, counts, True, watermark)
            return
        if self.counts.exists():
            old_values, old_counts = (np.frombuffer(raw, kind) for raw, kind in zip(self.counts.get(), ("<f8", "<i8")))
            values, counts = merge_counts(np.concatenate([old_values, values]), np.concatenate([old_counts, counts]))
        else:
            self.handle.registerTimer(end)
        self.counts.update((values.astype("<f8").tobytes(), counts.astype("<i8").tobytes()))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counts.exists():
            values, counts = (np.frombuffer(raw, kind) for raw, kind in zip(self.counts.get(), ("<f8", "<i8")))
            self.counts.clear()
            yield self._rows(key, values, counts, False, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


@dataclass
class WindowedDrift(DriftMonitor):
    """One verdict per time window of a scored stream, given when the window closes.

    ``delay`` is how long a window waits for rows after its end. ``shares`` is the number of keys that the values
    of a (window, class, feature) are spread over. The stream's session needs the RocksDB state store
    (``use_state_store``). A null prediction or value is not counted, but its time moves the watermark, so a row
    with a far time and no prediction closes all windows of a stream that ends.
    """

    delay: str = "1 hour"
    shares: int = 16

    @property
    def late_path(self) -> str:
        return f"{self.folder}/late"

    def use_state_store(self) -> None:
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def window_ms(self) -> int:
        width = self.spark.range(1).select(F.expr(f"timestamp'1970-01-01 00:00:00' + INTERVAL {self.every}").alias("t"))
        return int(width.select(F.unix_millis("t") - F.unix_millis(F.expr("timestamp'1970-01-01 00:00:00'"))).first()[0])

    def counted(self, scored: DataFrame) -> DataFrame:
        """Counts per Arrow batch: (window_start, class, feature, share, value, n)."""
        timed = scored.withColumn(self.timestamp, F.col(self.timestamp).cast("timestamp")).withWatermark(self.timestamp, self.delay)
        start = F.window(self.timestamp, self.every)["start"]
        rows = timed.select(
            start.alias("window_start"),
            F.col(self.prediction).cast("int").alias("class"),
            *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(self.columns)],
        )
        names, shares = self.columns, self.shares

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch]).filter(batch.column("class").is_valid())
                for i, name in enumerate(names):
                    some = table.select(["window_start", "class", f"v{i}"]).rename_columns(["window_start", "class", "value"])
                    some = some.filter(some.column("value").is_valid())
                    found = some.group_by(["window_start", "class", "value"]).aggregate([([], "count_all")])
                    if not found.num_rows:
                        continue
                    value = found.column("value").to_numpy()
                    # + 0.0 makes the two zeros one; equal values go to the same share.
                    share = (np.ascontiguousarray(value + 0.0).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(shares)
                    yield pa.RecordBatch.from_arrays(
                        [
                            found.column("window_start").combine_chunks(),
                            found.column("class").combine_chunks(),
                            pa.array([name] * len(value)),
                            pa.array(share.astype(np.int32)),
                            pa.array(value + 0.0),
                            found.column("count_all").combine_chunks().cast(pa.int64()),
                        ],
                        names=["window_start", "class", "feature", "share", "value", "n"],
                    )

        return rows.mapInArrow(run, COUNTED)

    def handed_over(self, scored: DataFrame) -> DataFrame:
        """The counts of windows that close, each once, and of rows that come too late."""
        keyed = self.counted(scored).groupBy("window_start", "class", "feature", "share")
        return keyed.transformWithStateInPandas(WindowCounts(self.window_ms()), HANDED, "Append", "EventTime")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Verdicts of the windows that closed in this batch, from its rows alone; late rows go to a table of their own."""
        batch = batch.persist()
        try:
            closed = batch.filter(~F.col("late")).select("window_start", "class", "feature", "value", "n")
            self._write(self.window_verdicts(closed), batch_id, self.verdicts_path)
            late = batch.filter("late").select("window_start", "class", "feature", "value", "n", "watermark")
            self._write(late, batch_id, self.late_path)
        finally:
            batch.unpersist()

    def _write(self, rows: DataFrame, batch_id: int, path: str) -> None:
        named = rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    def start(self, scored: DataFrame, checkpoint: str, drain: bool = False) -> StreamingQuery:
        self.use_state_store()
        return super().start(self.handed_over(scored), checkpoint, drain)

    def late_rows(self) -> DataFrame:
        """(batch_id, window_start, class, feature, value, n, watermark) of rows whose window had closed."""
        if not existing_paths(self.spark, [self.late_path]):
            return self.spark.createDataFrame([], LATE)
        return self.spark.read.schema(LATE).parquet(self.late_path)
