"""Projection, cleaning and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.functions.columns import all_of, count_if, flag, is_floating, is_infinite, is_unclean, to_long
from driftwarden.plans.ranks import row_numbers
from driftwarden.plans.scale import lookup_join
from driftwarden.sources.files import require_columns

IDENTIFIERS = ["src_ip", "dst_ip", "timestamp"]


def normalise_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("(", "").replace(")", "")


def normalise_names(df: DataFrame) -> DataFrame:
    """Trim and lower the column names, blanks to underscores, brackets removed."""
    return df.toDF(*[normalise_name(c) for c in df.columns])


def drop_identifiers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop identifying columns; absent ones are ignored."""
    return df.drop(*(IDENTIFIERS if columns is None else columns))


def null_inf_audit(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing (null or NaN) and infinite counts, one row per column, in one pass."""
    names = columns or df.columns
    counts = []
    for c in names:
        floating = is_floating(df, c)
        missing = F.col(c).isNull() | F.isnan(c) if floating else F.col(c).isNull()
        counts.append(
            F.struct(
                F.lit(c).alias("column"),
                count_if(missing).alias("missing"),
                (count_if(is_infinite(c)) if floating else F.lit(0).cast("long")).alias("infinite"),
            )
        )
    return df.agg(F.array(*counts).alias("audit")).select(F.inline("audit"))


def sanitise_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null, NaN and infinities to 0, then truncation to long."""
    return df.withColumns({c: to_long(c) for c in columns})


def drop_unclean_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Keep rows without null, NaN or infinity in the given columns (default: all)."""
    return df.filter(all_of([~is_unclean(df, c) for c in (columns or df.columns)]))


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null and NaN to the column's mean over the present values. Infinities must be gone before.

    All means come from one aggregate, read as a scalar subquery."""
    valid = {c: F.when(~is_unclean(df, c), F.col(c).cast("double")) for c in columns}
    means = df.agg(F.struct(*[F.avg(v).alias(c) for c, v in valid.items()]).alias("m")).scalar()
    present = {c: F.when(~(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))), F.col(c).cast("double")) for c in columns}
    return df.withColumns({c: F.coalesce(present[c], means.getField(c)) for c in columns})


def select_features(df: DataFrame, columns: list[str], label: str | None = None) -> DataFrame:
    """The features in a fixed order, then the label."""
    return require_columns(df, [*columns, *([label] if label else [])]).select(*columns, *([label] if label else []))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of ``column`` and their ordinals 0, 1, ..."""
    distinct = df.select(column).filter(F.col(column).isNotNull()).distinct()
    ranked = row_numbers(distinct, [column], "code")
    return ranked.withColumn("code", (F.col("code") - 1).cast("int"))


def encode_label(df: DataFrame, column: str, output: str = "code") -> DataFrame:
    """Ordinal of each row's value among the sorted distinct values.

    The codes are broadcast if a count shows that they are few, else joined by shuffle."""
    codes = label_codes(df, column).withColumnRenamed("code", output)
    return lookup_join(df, codes, [column], "check", "left")


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    """An indicator column ``<column>_<value>`` per value."""
    return df.withColumns({f"{column}_{v}": flag(F.col(column) == F.lit(v)) for v in values})


def binarise_label(df: DataFrame, column: str, output: str = "binary") -> DataFrame:
    """Two classes become 0/1 in sorted order; any other number of classes is an error.

    The check and the codes come from one two-valued aggregate (smallest and largest value)."""
    ends = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high")).alias("e")).scalar()
    low, high = ends.getField("low"), ends.getField("high")
    wrong = F.raise_error(F.concat(F.lit(f"{column} has not two classes: "), F.col(column).cast("string")))
    return df.withColumn(
        output,
        F.when(F.col(column).isNull(), F.lit(None).cast("int"))
        .when((F.col(column) == low) & (low != high), F.lit(0))
        .when((F.col(column) == high) & (low != high), F.lit(1))
        .otherwise(wrong.cast("int")),
    )


def add_sample_id(df: DataFrame, order: list[str], name: str = "Sample_ID", layout: str = "auto") -> DataFrame:
    """1..n in the given order."""
    return row_numbers(df, order, name, layout=layout)


def filter_label_ports(
    df: DataFrame, ports: list[int], label: str = "Label", port: str = "dst_port", value: int = 1
) -> DataFrame:
    """Rows of one label on the listed ports; both conditions reach the file scan."""
    return df.filter((F.col(label) == value) & F.col(port).isin(ports))


def class_slices(
    train: DataFrame, runtime: DataFrame, columns: list[str], label: str = "label", prediction: str = "prediction",
    extra: list[str] | None = None,
) -> DataFrame:
    """Training rows by true label and runtime rows by predicted label, tagged with ``side``.

    The class is a column; nothing loops over classes."""
    extra = extra or []
    left = train.select(*extra, F.col(label).cast("int").alias("class"), F.lit("train").alias("side"), *columns)
    right = runtime.select(*extra, F.col(prediction).cast("int").alias("class"), F.lit("runtime").alias("side"), *columns)
    return left.unionByName(right)


def split_by_correctness(
    df: DataFrame, correct: bool, truth: str = "label", prediction: str = "prediction", only_class: int | None = None
) -> DataFrame:
    """Rows that were predicted rightly or wrongly, of one class if given."""
    same = F.col(truth) == F.col(prediction)
    rows = df.filter(same if correct else ~same)
    return rows if only_class is None else rows.filter(F.col(truth) == only_class)


def anomalous_windows(df: DataFrame, count: str = "anomaly_count") -> DataFrame:
    """Time windows that hold at least one anomaly."""
    return df.filter(F.col(count) > 0)


def predicted_anomalies(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    return df.filter(F.col(prediction) == 1)


