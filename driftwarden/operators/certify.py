"""Certificates of fitted models: what the training table alone says a right fit has to give.

Each compares a model with sums over the rows it was fitted on, in one aggregation, so that a result
of an iterative fit can be checked without running the fit again.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.operators.features import finite, fit_pca
from driftwarden.operators.models import probability_of_one
from driftwarden.plans.scale import scratch_path

INTERCEPT = "(intercept)"
LEAF = "_model_leaf"


def logistic_optimum(
    train: DataFrame, model: PipelineModel, columns: list[str], label: str = "label", c: float = 1.0, within: float = 1e-6
) -> DataFrame:
    """(feature, target, gradient, at_optimum): is the gradient of the penalised loss 0 at the fitted weights?

    At the optimum the sum of p * x and the weight over ``c`` together equal ``target``, the sum of label * x. ``gradient`` is
    what they differ by as a share of the sum of absolute x. The intercept has no penalty. Rows with a null label
    take no part; a feature that is 0 everywhere is at its optimum if its weight is 0.
    """
    fitted = model.stages[-1]
    weights = {INTERCEPT: 0.0, **{name: float(w) for name, w in zip(columns, fitted.coefficients)}}
    values = {INTERCEPT: F.lit(1.0), **{name: finite(name) for name in columns}}
    y = F.col(label).cast("double")
    rows = model.transform(train.filter(F.col(label).isNotNull()))
    sums = [
        F.struct(
            F.lit(name).alias("feature"),
            F.coalesce(F.sum(y * x), F.lit(0.0)).alias("target"),
            (F.coalesce(F.sum((probability_of_one() - y) * x), F.lit(0.0)) + weights[name] / c).alias("off"),
            F.sum(F.abs(x)).alias("size"),
        )
        for name, x in values.items()
    ]
    told = rows.agg(F.array(*sums).alias("sums")).select(F.inline("sums"))
    gradient = F.coalesce(F.try_divide("off", "size"), F.col("off"))
    return told.select("feature", "target", gradient.alias("gradient"), (F.abs(gradient) <= within).alias("at_optimum"))


def stored_leaves(train: DataFrame, model: PipelineModel) -> DataFrame:
    """(tree, leaf, counts): the leaves of a forest as stored, with their label counts, numbered as rows are routed."""
    path = scratch_path(train.sparkSession, "forest")
    model.stages[-1].write().overwrite().save(path)
    nodes = train.sparkSession.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    # A forest has a bounded number of nodes, whatever the rows; leaves count in the order of their nodes.
    place = F.row_number().over(Window.partitionBy("tree").orderBy("id")) - 1
    return nodes.filter("leftChild < 0").select("tree", place.alias("leaf"), F.col("impurityStats").alias("counts"))


def forest_agreement(train: DataFrame, model: PipelineModel, label: str = "label", classes: int = 2) -> DataFrame:
    """(tree, rows, one count per class, leaves, agreeing): rows routed to each leaf against the counts it keeps.

    ``agreeing`` counts the leaves whose counts of every class are those of the rows that reach them. It is all
    of them for a forest fitted on these rows without bootstrap; with it, trees keep counts of redrawn rows.
    """
    routed = model.copy()
    routed.stages[-1].setLeafCol(LEAF)
    counts = [F.count_if(F.col(label) == k).cast("double") for k in range(classes)]
    found = (
        routed.transform(train.filter(F.col(label).isNotNull()))
        .select(label, F.posexplode(vector_to_array(LEAF)).alias("tree", "leaf"))
        .groupBy("tree", F.col("leaf").cast("int").alias("leaf"))
        .agg(F.array(*counts).alias("routed"))
    )
    none = F.array(*[F.lit(0.0)] * classes)
    both = stored_leaves(train, model).join(found, ["tree", "leaf"], "full")
    both = both.withColumns({c: F.coalesce(c, none) for c in ("counts", "routed")})
    per_class = [F.sum(F.col("routed")[k]).cast("long").alias(f"class_{k}") for k in range(classes)]
    return both.groupBy("tree").agg(
        F.sum(F.aggregate("routed", F.lit(0.0), lambda acc, n: acc + n)).cast("long").alias("rows"),
        *per_class,
        F.count(F.lit(1)).alias("leaves"),
        F.count_if(F.col("counts") == F.col("routed")).alias("agreeing"),
    )


def component_spectrum(df: DataFrame, columns: list[str], scale: bool = False) -> DataFrame:
    """(power, total, uncorrelated, descending): sums of powers of the variances of all principal components.

    As many power sums as columns determine the variances, and each equals the trace of that power of the
    covariance matrix of the columns. ``uncorrelated`` says that no two components vary together, ``descending`` that
    the first has the largest variance, and so on. One aggregation over the projected rows; one row reaches the driver.
    """
    d = len(columns)
    model, rows = fit_pca(df, columns, d, scale)
    parts = model.transform(rows).select(vector_to_array("_projected").alias("p"))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    told = parts.agg(*[F.covar_pop(F.col("p")[i], F.col("p")[j]).alias(f"c_{i}_{j}") for i, j in pairs])
    own = F.array(*[F.col(f"c_{i}_{i}") for i in range(d)])
    most = F.array_max(own) * 1e-9
    apart = F.forall(F.array(*[F.col(f"c_{i}_{j}") for i, j in pairs if i < j], F.lit(0.0)), lambda c: F.abs(c) <= most)
    falling = F.forall(F.sequence(F.lit(1), F.lit(d)), lambda i: (i == d) | (F.get(own, i - 1) >= F.get(own, i)))
    powers = told.select(own.alias("own"), apart.alias("uncorrelated"), falling.alias("descending"))
    powers = powers.select("*", F.explode(F.sequence(F.lit(1), F.lit(d))).alias("power"))
    total = F.aggregate("own", F.lit(0.0), lambda acc, v: acc + F.pow(v, F.col("power").cast("double")))
    return powers.select("power", total.alias("total"), "uncorrelated", "descending")
