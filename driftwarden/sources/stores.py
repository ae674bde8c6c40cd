"""Baseline distances and fitted models as tables and folders."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.sources.files import existing_paths

# run_id, class, accuracy, measure, distance: one row per run, class and measure.
BASELINE_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("measure", T.StringType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("class", T.IntegerType()),
    ]
)


def save_baseline(df: DataFrame, path: str, mode: str = "append") -> None:
    """Store distance rows in folders per class, so that a class can be read alone."""
    rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in BASELINE_SCHEMA.fields])
    rows.write.mode(mode).partitionBy("class").parquet(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    if not existing_paths(spark, [path]):
        raise FileNotFoundError(f"no baseline at {path}")
    return spark.read.schema(BASELINE_SCHEMA).parquet(path)


def save_runs(df: DataFrame, path: str) -> None:
    """Store distance rows under their runs: a run that is saved again replaces itself, others stay.

    A run's folder is exchanged when all its rows are written, so a save that fails or is repeated leaves one whole run,
    also if it has fewer classes than before. Different runs may be saved at the same time. Rows with a
    null run are one run; columns beyond those of a baseline are not kept; an empty table changes nothing.
    """
    rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in BASELINE_SCHEMA.fields])
    # One file per run: a run has as many rows as classes and measures.
    dealt = rows.repartition("run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    dealt.partitionBy("run_id").parquet(path)


def load_runs(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The rows of all runs, or of one (only its folder is read). Two rows for one run, class and measure are an error."""
    if not existing_paths(spark, [path]):
        raise FileNotFoundError(f"no baseline at {path}")
    rows = spark.read.schema(BASELINE_SCHEMA).parquet(path)
    if run_id is not None:
        rows = rows.filter(F.col("run_id") == run_id)
    twice = rows.groupBy("run_id", "class", "measure").count().filter("count > 1").head(1)
    if twice:
        raise ValueError(f"run {twice[0].run_id}, class {twice[0]['class']}, measure {twice[0].measure} is stored twice in {path}")
    return rows.select(*BASELINE_SCHEMA.fieldNames())


def save_model(model: PipelineModel, path: str) -> None:
    """Scaling and classifier are stages of one pipeline and are stored together."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
