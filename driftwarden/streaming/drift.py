"""Drift verdicts over a scored stream.

Each micro-batch is reduced to counts per (window, class, feature, value) and written to its own
folder, named by window and batch number. A batch that runs again overwrites exactly its own
folders, so counts are never added twice. The verdict of a window is computed from the sum of its
folders and from the stored counts of the training rows; the rows themselves are not kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwarden.functions.columns import flag
from driftwarden.operators.decide import verdict
from driftwarden.operators.distance import distances, mean_over_features, melt, to_long_form
from driftwarden.plans.scale import cut
from driftwarden.sources.files import existing_paths

COUNTS = "window_start timestamp, batch_id long, class int, feature string, value double, n long"
VERDICTS = (
    "batch_id long, window_start timestamp, decision string, confidence_level string, decision_code int, risk_level string, "
    "action string, overall_similarity double, estimated_accuracy double, rows long"
)


def training_counts(train: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """The training side as counts per (class, feature, value): a digest to store once."""
    rows = train.select(F.col(label).cast("int").alias("class"), *columns)
    counts = melt(rows, ["class"], columns).filter(F.col("value").isNotNull()).groupBy("class", "feature", "value")
    return counts.agg(F.count(F.lit(1)).alias("n")).select("class", "feature", F.col("value").cast("double").alias("value"), "n")


@dataclass
class DriftMonitor:
    """Verdict per time window of a scored stream.

    ``folder`` is on storage that all executors share. ``training`` holds the counts from
    ``training_counts``, ``baseline`` the stored distances."""

    spark: SparkSession
    folder: str
    training: DataFrame
    baseline: DataFrame
    columns: list[str]
    classes: list[int]
    every: str = "1 hour"
    timestamp: str = "timestamp"
    prediction: str = "prediction"
    layout: str = "auto"
    keep: str | None = None

    @property
    def counts_path(self) -> str:
        return f"{self.folder}/counts"

    @property
    def verdicts_path(self) -> str:
        return f"{self.folder}/verdicts"

    def batch_counts(self, batch: DataFrame) -> DataFrame:
        start = F.window(F.col(self.timestamp).cast("timestamp"), self.every)["start"]
        rows = batch.select(start.alias("window_start"), F.col(self.prediction).cast("int").alias("class"), *self.columns)
        return (
            melt(rows, ["window_start", "class"], self.columns)
            .filter(F.col("value").isNotNull())
            .groupBy("window_start", "class", "feature", F.col("value").cast("double").alias("value"))
            .agg(F.count(F.lit(1)).alias("n"))
        )

    def stored_counts(self) -> DataFrame:
        return self.spark.read.schema(COUNTS).parquet(self.counts_path)

    def window_verdicts(self, counts: DataFrame) -> DataFrame:
        """Verdict per window from counts (window_start, class, feature, value, n)."""
        # The digest of the training rows (not the rows) is repeated per window of the batch. The
        # window starts come as one array, so there is no join and no hot key.
        windows = counts.agg(F.collect_set("window_start")).scalar()
        first = self.training.withColumn("window_start", F.explode(windows))
        columns = ["window_start", "class", "feature", "value", "n"]
        sides = (
            first.select(*columns)
            .withColumn("is_train", F.lit(True))
            .unionByName(counts.select(*columns).withColumn("is_train", F.lit(False)))
        )
        keys = ["window_start", "class", "feature"]
        both = sides.groupBy(*keys, "value").agg(
            F.sum(F.col("n") * flag(F.col("is_train"))).alias("x"), F.sum(F.col("n") * flag(~F.col("is_train"))).alias("y")
        )
        per_feature = distances(both, keys, layout=self.layout)
        runtime = to_long_form(mean_over_features(per_feature, self.classes, ["window_start"]), ["window_start", "class"])
        rows = counts.filter(F.col("feature") == self.columns[0]).groupBy("window_start").agg(F.sum("n").alias("rows"))
        found = verdict(self.baseline, runtime, ["window_start"])
        return found.join(rows, "window_start", "left").select(
            "window_start", "decision", "confidence_level", "decision_code", "risk_level", "action", "overall_similarity",
            "estimated_accuracy", "rows",
        )

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Merge one micro-batch and renew the verdicts of the windows that it touches."""
        counted = self.batch_counts(batch).withColumn("batch_id", F.lit(batch_id).cast("long"))
        (
            counted.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("window_start", "batch_id")
            .parquet(self.counts_path)
        )
        stored = self.stored_counts()
        touched = stored.filter(F.col("batch_id") == batch_id).select("window_start").distinct()
        # Folders of later batches are ignored, so a repeated batch gives the same verdict.
        open_counts = stored.filter(F.col("batch_id") <= batch_id).join(touched, "window_start", "left_semi")
        if self.keep:
            newest = stored.agg(F.max("window_start")).scalar()
            open_counts = open_counts.filter(F.col("window_start") >= newest - F.expr(f"INTERVAL {self.keep}"))
        merged = open_counts.groupBy("window_start", "class", "feature", "value").agg(F.sum("n").alias("n"))
        (
            self.window_verdicts(merged)
            .withColumn("batch_id", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(self.verdicts_path)
        )

    def start(self, scored: DataFrame, checkpoint: str, drain: bool = False) -> StreamingQuery:
        # Every micro-batch reads the digest and the baseline: they are stored here, not counted again.
        self.training, self.baseline = cut(self.training), cut(self.baseline)
        writer = scored.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime="30 seconds")).start()

    def verdicts(self) -> DataFrame:
        """The latest verdict of each window."""
        if not existing_paths(self.spark, [self.verdicts_path]):
            return self.spark.createDataFrame([], VERDICTS)
        stored = self.spark.read.schema(VERDICTS).parquet(self.verdicts_path)
        others = [c for c in stored.columns if c != "window_start"]
        latest = stored.groupBy("window_start").agg(F.max_by(F.struct(*others), "batch_id").alias("v"))
        return latest.select("window_start", "v.*")
