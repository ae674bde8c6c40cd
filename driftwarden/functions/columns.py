"""Column expressions shared by the operators. All stay inside Spark's generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")
# The largest double that still fits into a long after truncation, and the smallest.
LONG_TOP = float(2**63 - 1024)
LONG_BOTTOM = -float(2**63)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def is_infinite(c: Column | str) -> Column:
    return F.abs(col(c)) == F.lit(INF)


def is_unclean(df: DataFrame, name: str) -> Column:
    """Null, NaN or infinite; only floating columns can be the latter two."""
    c = F.col(name)
    return c.isNull() | F.isnan(c) | is_infinite(c) if is_floating(df, name) else c.isNull()


def nan_to_null(c: Column | str) -> Column:
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def to_long(c: Column | str) -> Column:
    """Truncate to long; null, NaN and infinities become 0, out-of-range values the nearest long."""
    x = col(c).cast("double")
    bounded = F.least(F.greatest(x, F.lit(LONG_BOTTOM)), F.lit(LONG_TOP))
    return F.when(x.isNull() | F.isnan(x) | is_infinite(x), F.lit(0)).otherwise(bounded.cast("long"))


def ratio(top: Column, bottom: Column, empty: float | None = None) -> Column:
    """Double division; a zero or null denominator gives ``empty``."""
    share = F.try_divide(top.cast("double"), bottom.cast("double"))
    return share if empty is None else F.coalesce(share, F.lit(float(empty)))


def flag(condition: Column) -> Column:
    """1 where true, else 0; null counts as false."""
    return F.when(condition, 1).otherwise(0)


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(flag(condition)), F.lit(0)).cast("long")


def decide_at(probability: Column | str, threshold: float = 0.5) -> Column:
    """1 if strictly above the threshold. A null or NaN probability gives 0."""
    p = nan_to_null(probability)
    return flag(p > F.lit(threshold))


def label_text(prediction: Column | str) -> Column:
    return F.when(col(prediction) == 1, F.lit("Anomaly")).otherwise(F.lit("Normal"))


def risk_band(probability: Column | str) -> Column:
    p = nan_to_null(probability)
    return F.when(p > 0.8, "High").when(p > 0.5, "Medium").otherwise("Low")


def graded(value: Column | str, steps: list[tuple[float, object]], lowest: object) -> Column:
    """Value of the first step whose lower edge is reached. Null and NaN take the lowest grade:
    Spark orders NaN above every number, so it must not reach the comparisons."""
    v = nan_to_null(value)
    first, *rest = steps
    chain = F.when(v >= first[0], F.lit(first[1]))
    for edge, result in rest:
        chain = chain.when(v >= edge, F.lit(result))
    return chain.otherwise(F.lit(lowest))


def wilson_bounds(p: Column | str, n: Column | str, z: float = 3.29) -> tuple[Column, Column]:
    """Lower and upper Wilson bound of a proportion ``p`` over ``n`` trials; null where n = 0."""
    p, n = col(p).cast("double"), col(n).cast("double")
    z2 = z * z
    spread = z * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(z2), 4 * n), n))
    middle = p + F.try_divide(F.lit(z2), 2 * n)
    scale = 1 + F.try_divide(F.lit(z2), n)
    return F.try_divide(middle - spread, scale), F.try_divide(middle + spread, scale)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def half_up(fraction: float, total: Column) -> Column:
    """``fraction`` of a count, rounded half up."""
    return F.floor(F.lit(float(fraction)) * total + F.lit(0.5))

