"""Two-sample distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden import views
from driftwarden.catalog.base import DRIFT, FLOW, PLACES, ROUNDED, distance_ctes, per_class, query, with_ctes
from driftwarden.operators import clean, distance, sketched
from driftwarden.views import CLASSES, FEATURES


def sliced_flows(spark, sf_dir, drifted: bool = False) -> DataFrame:
    flows = (views.drift_view if drifted else views.flow_view)(spark, sf_dir)
    return clean.class_slices(views.train_rows(flows), views.runtime_rows(flows), FEATURES)


def rounded(df: DataFrame, keys: list[str], measures: list[str] | None = None) -> DataFrame:
    return df.select(*keys, *[F.round(m, PLACES[m]).alias(m) for m in (measures or PLACES)])


STEPS = with_ctes(FLOW, *distance_ctes()[:4], select="SELECT class, feature, value, cx, cy, nx, ny, next_value FROM stepped")


def steps(spark, sf_dir, layout):
    counts = distance.value_counts_by_side(sliced_flows(spark, sf_dir), ["class"], FEATURES)
    return distance.ecdf_steps(counts, ["class", "feature"], layout=layout).drop("position")


@query("k0_ecdf_steps", STEPS)
def k0(spark, sf_dir):
    return steps(spark, sf_dir, "auto")


@query("k0_ecdf_steps_split", STEPS)
def k0_split(spark, sf_dir):
    return steps(spark, sf_dir, "split")


def _single(measure: str) -> None:
    name = measure.lower()
    number = distance.MEASURES.index(measure) + 1
    sql = with_ctes(
        FLOW,
        *distance_ctes(),
        select=f"SELECT class, feature, round({measure}, {PLACES[measure]}) AS {measure} FROM measured WHERE feature = 'flow_duration'",
    )

    @query(f"k{number}_{name}", sql)
    def run(spark, sf_dir):
        found = getattr(distance, name)(sliced_flows(spark, sf_dir), "flow_duration", keys=["class"])
        return rounded(found, ["class", "feature"], [measure])


for _m in distance.MEASURES:
    _single(_m)


FEATURE_DISTANCES = with_ctes(FLOW, *distance_ctes(), select=f"SELECT class, feature, {ROUNDED} FROM measured")


@query("k7_feature_distances", FEATURE_DISTANCES)
def k7(spark, sf_dir):
    return rounded(distance.feature_distances(sliced_flows(spark, sf_dir), FEATURES), ["class", "feature"])


@query("k7_feature_distances_split", FEATURE_DISTANCES)
def k7_split(spark, sf_dir):
    return rounded(distance.feature_distances(sliced_flows(spark, sf_dir), FEATURES, layout="split"), ["class", "feature"])


@query(
    "k7_feature_distances_full_boundary",
    with_ctes(FLOW, *distance_ctes(less=1), select=f"SELECT class, feature, {ROUNDED} FROM measured"),
)
def k7_full(spark, sf_dir):
    return rounded(distance.feature_distances(sliced_flows(spark, sf_dir), FEATURES, boundary="full"), ["class", "feature"])


def _class_sql(source: str) -> str:
    pre = [FLOW] if source == "flow" else [FLOW, DRIFT]
    return with_ctes(
        *pre,
        *distance_ctes(source),
        per_class(),
        "listed AS (SELECT unnest([0, 1, 2]) AS class)",
        select=f"""
SELECT class, CAST(1 AS DOUBLE) AS accuracy, {', '.join(f"round(coalesce({m}, CAST('nan' AS DOUBLE)), {p}) AS {m}" for m, p in PLACES.items())}
FROM listed LEFT JOIN per_class USING (class)""",
    )


@query("k8_class_distances", _class_sql("flow"))
def k8(spark, sf_dir):
    """Class 2 has no rows, so its record is NaN."""
    found = distance.class_distances(sliced_flows(spark, sf_dir), FEATURES, [*CLASSES, 2], accuracy=1.0)
    return rounded(found, ["class", "accuracy"])


@query("k8_class_distances_drifted", _class_sql("drift"))
def k8_drifted(spark, sf_dir):
    found = distance.class_distances(sliced_flows(spark, sf_dir, True), FEATURES, [*CLASSES, 2], accuracy=1.0)
    return rounded(found, ["class", "accuracy"])


SKETCHED_SQL = ", ".join(f"round({m}, {PLACES[m]}) AS {m}, NOT isnan({m}) AS {m}_within" for m in sketched.SKETCHED)


@query("k7_sketched_distances", with_ctes(FLOW, *distance_ctes(less=1), select=f"SELECT class, feature, {SKETCHED_SQL} FROM measured"))
def k7_sketched(spark, sf_dir):
    """The exact distances, and whether those from sketches lie within their stated bound of them."""
    sliced = sliced_flows(spark, sf_dir)
    exact = distance.feature_distances(sliced, FEATURES, boundary="full", measures=sketched.SKETCHED)
    found = sketched.sketched_distances(sliced, FEATURES)
    found = found.select("class", "feature", *[F.struct(m, f"{m}_error").alias(f"{m}_found") for m in sketched.SKETCHED])
    both = exact.join(found, ["class", "feature"])
    within = [
        (F.abs(F.col(m) - F.col(f"{m}_found.{m}")) <= F.col(f"{m}_found.{m}_error") + 1e-9).alias(f"{m}_within") for m in sketched.SKETCHED
    ]
    return both.select("class", "feature", *[F.round(m, PLACES[m]).alias(m) for m in sketched.SKETCHED], *within)
