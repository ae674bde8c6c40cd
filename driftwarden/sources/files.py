"""File sources and sinks."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

FLOW_SCHEMA = T.StructType(
    [
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("flow_duration", T.DoubleType()),
        T.StructField("fwd_pkt_len_max", T.DoubleType()),
        T.StructField("fwd_pkt_len_mean", T.DoubleType()),
        T.StructField("fwd_pkt_len_std", T.DoubleType()),
        T.StructField("pkt_len_mean", T.DoubleType()),
        T.StructField("pkt_len_std", T.DoubleType()),
        T.StructField("fwd_iat_tot", T.DoubleType()),
        T.StructField("pkt_size_avg", T.DoubleType()),
        T.StructField("fwd_seg_size_avg", T.DoubleType()),
        T.StructField("syn_flag_cnt", T.LongType()),
        T.StructField("rst_flag_cnt", T.LongType()),
        T.StructField("flow_byts_s", T.DoubleType()),
        T.StructField("flow_pkts_s", T.DoubleType()),
        T.StructField("Label", T.IntegerType()),
    ]
)


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist, on any file system Spark knows. Glob patterns are allowed."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        matches = p.getFileSystem(conf).globStatus(p)
        if matches is not None and len(matches) > 0:
            found.append(path)
    return found


def csv_headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Column names of every CSV file below the paths, by file; files without a line are left out.

    One job with a task per file, which ends after the file's first line; a row per file reaches the driver."""
    # A file fills its partition whatever its size, so no task has two files or part of one.
    whole = {"spark.sql.files.maxPartitionBytes": str(1 << 50), "spark.sql.files.openCostInBytes": str(1 << 50)}
    before = {k: spark.conf.get(k) for k in whole}
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))

    def first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    try:
        for key, value in whole.items():
            spark.conf.set(key, value)
        found = lines.mapInArrow(first_line, "file string, line string").collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return {r.file: [name.strip() for name in next(csv.reader([r.line.lstrip("\ufeff")]), [])] for r in found}


def skipped_files(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """(path, missing): the CSV files that ``read_flows`` leaves out, with the required columns each lacks."""
    found = existing_paths(spark, paths)
    headers = csv_headers(spark, found) if found else {}
    rows = [(f, sorted(set(required) - set(h))) for f, h in sorted(headers.items())]
    return spark.createDataFrame([r for r in rows if r[1]], "path string, missing array<string>")


def read_flows(
    spark: SparkSession,
    paths: list[str],
    schema: T.StructType = FLOW_SCHEMA,
    fmt: str = "csv",
    required: list[str] | None = None,
    keep_corrupt: bool = False,
    ignore_corrupt_files: bool = False,
) -> DataFrame:
    """Read flow files with a fixed schema.

    Absent paths are skipped, and so are files without the ``required`` columns (``skipped_files``
    lists them). A line that does not fit the schema does not stop the job: its bad fields are null,
    and with ``keep_corrupt`` the raw line is kept in ``_corrupt_record``. A file that can't be read
    is an error, unless ``ignore_corrupt_files`` says that the rest of such files may be missing.

    A path may be a file, a folder or a glob. Every CSV file's own header is looked up, in one job;
    files with the same header share one scan.
    """
    found = existing_paths(spark, paths)
    if fmt != "csv":
        reader = spark.read.schema(schema).option("ignoreCorruptFiles", ignore_corrupt_files)
        if required:
            found = [p for p in found if set(required) <= set(spark.read.format(fmt).load(p).columns)]
        if not found:
            return spark.createDataFrame([], schema)
        return reader.format(fmt).load(found)

    by_header: dict[tuple[str, ...], list[str]] = {}
    for path, header in (csv_headers(spark, found) if found else {}).items():
        if not required or set(required) <= set(header):
            by_header.setdefault(tuple(header), []).append(path)
    want = {f.name: f for f in schema.fields}
    parts = []
    for header, files in by_header.items():
        # CSV columns are positional, so each header order gets its own schema.
        fields = [want.get(name, T.StructField(f"_extra_{i}", T.StringType())) for i, name in enumerate(header)]
        file_schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
        raw = (
            spark.read.schema(file_schema)
            .option("header", True)
            .option("enforceSchema", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .option("ignoreCorruptFiles", ignore_corrupt_files)
            .csv(files)
        )
        have = set(header)
        cols = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        parts.append(raw.select(*cols, *([CORRUPT] if keep_corrupt else [])))
    if not parts:
        extra = [T.StructField(CORRUPT, T.StringType())] if keep_corrupt else []
        return spark.createDataFrame([], T.StructType([*schema.fields, *extra]))
    return union_sources(parts)


def union_sources(dfs: list[DataFrame]) -> DataFrame:
    """Concatenate by column name; a column that one side lacks is null there."""
    if not dfs:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail before any job runs if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; present: {df.columns}")
    return df


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Predictions as CSV with a header, written by all tasks in parallel."""
    df.write.mode(mode).option("header", True).csv(path)


def report_json(df: DataFrame, columns: list[str | Column] | None = None, name: str = "report") -> DataFrame:
    """One JSON document per row."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias(name))


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_flow_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = FLOW_SCHEMA,
    fmt: str = "csv",
    max_files: int | None = None,
) -> DataFrame:
    """Unbounded source over a folder into which flow files arrive.

    A CSV file whose header differs from the schema stops the stream instead of being read by position."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)
