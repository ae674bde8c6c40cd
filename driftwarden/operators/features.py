"""Feature scores, scaling and principal components."""

from __future__ import annotations

from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.functions.columns import ratio
from driftwarden.operators.distance import melt


def anova_f_scores(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """One-way F per feature, from count, mean and squared deviations per (feature, label)."""
    v = F.col("value").cast("double")
    groups = (
        melt(df, [label], columns)
        .filter(F.col(label).isNotNull() & F.col("value").isNotNull())
        .groupBy("feature", label)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("var"))
    )
    n, m = F.col("n").cast("double"), F.col("m")
    whole = groups.groupBy("feature").agg(
        F.count(F.lit(1)).alias("classes"),
        F.sum(n).alias("rows"),
        F.sum(n * F.col("var")).alias("within"),
        F.sum(n * m).alias("total"),
        F.collect_list(F.struct(n.alias("n"), m.alias("m"))).alias("parts"),
    )
    # Between-group squares around the grand mean; the list holds one entry per label.
    grand = F.col("total") / F.col("rows")
    between = F.aggregate(F.col("parts"), F.lit(0.0), lambda acc, p: acc + p["n"] * F.pow(p["m"] - grand, F.lit(2.0)))
    degrees = (F.col("classes") - 1).cast("double"), F.col("rows") - F.col("classes")
    return whole.select("feature", ratio(ratio(between, degrees[0]), ratio(F.col("within"), degrees[1])).alias("f_score"))


def select_k_best(df: DataFrame, label: str, columns: list[str], k: int = 10) -> DataFrame:
    """The k features with the highest F; ties by name."""
    return anova_f_scores(df, label, columns).orderBy(F.desc_nulls_last("f_score"), "feature").limit(k)


def finite(column: str) -> Column:
    """The column as a double; null, NaN and infinities count as 0."""
    x = F.col(column).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def scaling_moments(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of the cleaned values per column: one row reaches the driver."""
    row = train.agg(
        *[F.avg(finite(c)).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(finite(c)).alias(f"s_{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 0.0) for i, c in enumerate(columns)}


def standardise(train: DataFrame, apply_to: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """z-scores with the training mean and population deviation; a constant column gives 0.

    The moments come as one scalar subquery, so nothing is joined."""
    moments = train.agg(
        F.struct(
            *[F.avg(finite(c)).alias(f"m_{c}") for c in columns], *[F.stddev_pop(finite(c)).alias(f"s_{c}") for c in columns]
        ).alias("m")
    ).scalar()
    with_moments = apply_to.withColumn("_m", moments)
    scaled = {
        f"{c}{suffix}": F.coalesce(
            F.try_divide(F.col(c).cast("double") - F.col(f"_m.m_{c}"), F.nullif(F.col(f"_m.s_{c}"), F.lit(0.0))), F.lit(0.0)
        )
        for c in columns
    }
    return with_moments.withColumns(scaled).drop("_m")


def _centred(df: DataFrame, columns: list[str], moments: dict[str, tuple[float, float]], scale: bool) -> DataFrame:
    shifted = {
        f"_c_{c}": (F.col(c).cast("double") - m) / (s if scale and s > 0 else 1.0) for c, (m, s) in moments.items()
    }
    return VectorAssembler(inputCols=[f"_c_{c}" for c in columns], outputCol="_vector").transform(df.withColumns(shifted))


def fit_pca(df: DataFrame, columns: list[str], k: int, scale: bool = False) -> tuple[PCAModel, DataFrame]:
    """Model and centred rows. Spark's PCA does not centre on transform, so the rows are centred."""
    rows = _centred(df, columns, scaling_moments(df, columns), scale)
    return PCA(k=k, inputCol="_vector", outputCol="_projected").fit(rows), rows


def pca(df: DataFrame, columns: list[str], k: int = 7, keep: list[str] | None = None, scale: bool = False) -> DataFrame:
    """Rows projected on k components named ``Principal component 1``.., with the kept columns."""
    model, rows = fit_pca(df, columns, k, scale)
    parts = model.transform(rows).withColumn("_p", vector_to_array("_projected"))
    return parts.select(*[F.col("_p")[i].alias(f"Principal component {i + 1}") for i in range(k)], *(keep or []))


def explained_variance(df: DataFrame, columns: list[str], scale: bool = False) -> DataFrame:
    """Share and running share of the variance per component; one row per component."""
    model, _ = fit_pca(df, columns, len(columns), scale)
    shares = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)]
    table = df.sparkSession.createDataFrame(shares, "component int, explained double")
    return table.withColumn(
        "cumulative", F.sum("explained").over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0))
    )
