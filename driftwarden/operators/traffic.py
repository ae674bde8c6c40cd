"""Time-window aggregates of scored traffic; the same functions serve batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.functions.columns import nan_to_null

MEANS = ["flow_byts_s", "flow_pkts_s", "pkt_size_avg"]


def traffic_windows(df: DataFrame, every: str = "30 seconds", timestamp: str = "timestamp") -> DataFrame:
    """Flows, anomalies, their rate and mean traffic figures per tumbling window; empty windows do
    not appear. A traffic column that the input lacks is null."""
    present = set(df.columns)
    means = [F.avg(c).alias(c) if c in present else F.lit(None).cast("double").alias(c) for c in MEANS]
    grouped = df.groupBy(F.window(timestamp, every)).agg(
        F.count("prediction").alias("total_flows"),
        F.sum("prediction").alias("anomaly_count"),
        F.avg("prediction").alias("anomaly_rate"),
        F.avg("prediction_probability").alias("avg_probability"),
        *means,
    )
    return grouped.filter(F.col("total_flows") > 0).select(F.col("window.start").alias("window_start"), *grouped.columns[1:])


def rate_bands(windows: DataFrame, medium: float = 25.0, high: float = 50.0) -> DataFrame:
    """Anomaly rate in percent and its band: High and Medium from their lines upward, else Low."""
    percent = nan_to_null("anomaly_rate") * 100
    band = F.when(percent >= high, "High").when(percent >= medium, "Medium").otherwise("Low")
    return windows.withColumns({"anomaly_percent": percent, "rate_band": band})
