"""Stand-in inputs: the operators' input tables, derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["flow_duration", "pkt_len_mean", "pkt_size_avg", "rst_flag_cnt"]
TARGET_PORTS = [1, 3, 5, 7, 9]
CLASSES = [0, 1]
SPLIT_DATE = "1998-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flow_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows from ``lineitem``. The score is a fixed function of two columns, so no model is needed."""
    syn = F.round(F.col("l_discount") * 100).cast("long")
    rst = F.round(F.col("l_tax") * 100).cast("long")
    score = (syn + rst).cast("double") / F.lit(18.0)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws(
            "-",
            *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            cents.cast("string"),
        ).alias("row_key"),
        F.col("l_shipdate").alias("ts"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src_ip"),
        F.concat(F.lit("d"), F.col("l_partkey").cast("string")).alias("dst_ip"),
        F.col("l_linenumber").alias("dst_port"),
        F.col("l_returnflag").alias("protocol"),
        F.col("l_extendedprice").cast("long").alias("flow_duration"),
        F.col("l_quantity").cast("long").alias("pkt_len_mean"),
        (F.col("l_extendedprice") / F.col("l_quantity")).cast("long").alias("pkt_size_avg"),
        syn.alias("syn_flag_cnt"),
        rst.alias("rst_flag_cnt"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("label"),
        F.when(F.col("l_shipdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz"), "train")
        .otherwise("runtime")
        .alias("side"),
        score.alias("prediction_probability"),
        F.when(score > 0.5, 1).otherwise(0).alias("prediction"),
    )


def train_rows(flows: DataFrame) -> DataFrame:
    return flows.filter(F.col("side") == "train")


def runtime_rows(flows: DataFrame) -> DataFrame:
    return flows.filter(F.col("side") == "runtime")


def drift_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same flows with the runtime side moved, so that drift is found."""
    moved = F.col("side") == "runtime"
    return flow_view(spark, sf_dir).withColumns(
        {
            "flow_duration": F.when(moved, (F.col("flow_duration") * 1.3).cast("long")).otherwise(
                F.col("flow_duration")
            ),
            "pkt_len_mean": F.when(moved, F.col("pkt_len_mean") + 10).otherwise(F.col("pkt_len_mean")),
        }
    )


def traffic_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored traffic records from ``events``."""
    probability = F.least(F.lit(1.0), F.col("value") / 100)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.col("event_type"),
        F.col("value").alias("flow_byts_s"),
        (F.col("value") / 10).alias("flow_pkts_s"),
        F.regexp_extract("props", r'"k": ([0-9]+)', 1).try_cast("int").alias("pkt_size_avg"),
        probability.alias("prediction_probability"),
        F.when(probability > 0.5, 1).otherwise(0).alias("prediction"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
    )


def dirty_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic with nulls, NaN and infinities in ``flow_byts_s``, set by ``event_id``."""
    i = F.col("event_id")
    return traffic_view(spark, sf_dir).withColumn(
        "flow_byts_s",
        F.when(i % 17 == 0, F.lit(None).cast("double"))
        .when(i % 19 == 0, F.lit(float("nan")))
        .when(i % 23 == 0, F.lit(float("inf")))
        .when(i % 29 == 0, F.lit(float("-inf")))
        .otherwise(F.col("flow_byts_s")),
    )


def vector_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-length arrays on two sides, from ``embeddings``: labels 0-4 against 5-9."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "embedding",
        "label",
        F.when(F.col("label") < 5, "x").otherwise("y").alias("side"),
    )
