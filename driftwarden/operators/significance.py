"""Resampled p-values of the distances, maps over array positions, and the Chernoff distance.

A replicate draws na and, on its own, nb rows from the pool of both sides, each without replacement
(``method="bootstrap"``), or na rows and leaves the rest to the other side (``"permutation"``).
The p-value is the number of replicates 1..B-1 whose distance exceeds the observed one, over B.

Two forms give such draws:

* ``hash_pvalues`` draws rows by hash rank. Rows times replicates pass through the job, so it suits
  moderate tables; the same rows are drawn on any partitioning and by any engine with md5.
* ``count_pvalues`` draws from the counts per distinct value. The rows are read once. The distinct
  values of a group are cut into buckets of equal size; one task splits a replicate's draw over the
  buckets (multivariate hypergeometric), and each bucket then draws its own part and contributes to
  sums and extremes. No task holds more than one bucket, and the result does not depend on
  partitioning, since buckets follow from the exact position of a value.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.functions.columns import count_if, flag, ratio
from driftwarden.operators.distance import CUT, distances, melt, to_long_form, value_counts_by_side
from driftwarden.plans.draws import cutoffs, draw
from driftwarden.plans.ranks import prefix_sums
from driftwarden.plans.scale import lookup_join

# Numpy draws hypergeometric variates exactly below this population.
EXACT_POPULATION = 10**9
# Replicates whose first-level draws one task makes.
B_CHUNK = 64
# Replicates whose draws by hash are counted side by side.
TOGETHER = 10


# --- draws by hash ----------------------------------------------------------------------------


def _draw_limits(
    df: DataFrame, keys: list[str], row_key: list[str], replicates: int, seed: int, side: str, first: str, method: str, max_keys: int | None
) -> tuple[DataFrame, DataFrame, int | None]:
    """Rows times replicates with their draws ``_h``, the cut-offs per (keys, b), and a bound on their number."""
    if method not in ("bootstrap", "permutation"):
        raise ValueError("method is 'bootstrap' or 'permutation'")
    repeated = df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates - 1))))
    hashed = repeated.withColumn("_h", draw(seed, "resample", F.col("b"), *row_key))
    # One md5 per row and replicate gives two independent 64-bit draws.
    first_draw, second_draw = F.substring("_h", 1, 16), F.substring("_h", 17, 16)
    on_first = F.col(side) == F.lit(first)
    if method == "bootstrap":
        both = F.array(
            F.struct(F.lit(0).alias("w"), first_draw.alias("d")), F.struct(F.lit(1).alias("w"), second_draw.alias("d"))
        )
    else:
        both = F.array(F.struct(F.lit(0).alias("w"), first_draw.alias("d")))
    drawn = hashed.select(*keys, "b", on_first.alias("_first"), F.inline(both))

    def want(total: Column) -> Column:
        return F.when(F.col("w") == 0, F.col("marked")).otherwise(total - F.col("marked"))

    bound = None if max_keys is None else max_keys * replicates * 2
    limits = cutoffs(drawn, [*keys, "b", "w"], "d", want, bound, marked=F.col("_first"))
    per_draw = limits.groupBy(*keys, "b").agg(
        F.max(F.when(F.col("w") == 0, F.col("cutoff"))).alias("_cut_x"),
        F.max(F.when(F.col("w") == 1, F.col("cutoff"))).alias("_cut_y"),
    )
    return hashed, per_draw, bound


def resample_rows(
    df: DataFrame,
    keys: list[str],
    row_key: list[str],
    replicates: int,
    seed: int,
    side: str = "side",
    first: str = "train",
    method: str = "bootstrap",
    max_keys: int | None = None,
) -> DataFrame:
    """Rows times replicates ``b`` = 1..replicates-1 with ``x`` and ``y``: drawn for either side.

    ``max_keys`` bounds the number of key values, if known, so that cut-offs can be broadcast."""
    hashed, per_draw, bound = _draw_limits(df, keys, row_key, replicates, seed, side, first, method, max_keys)
    joined = lookup_join(hashed, per_draw, [*keys, "b"], bound)
    x = flag(F.substring("_h", 1, 16) <= F.col("_cut_x"))
    y = 1 - x if method == "permutation" else flag(F.substring("_h", 17, 16) <= F.col("_cut_y"))
    return joined.withColumns({"x": x, "y": y}).drop("_h", "_cut_x", "_cut_y").filter(F.col("x") + F.col("y") > 0)


def drawn_counts(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    row_key: list[str],
    replicates: int,
    seed: int,
    side: str = "side",
    first: str = "train",
    method: str = "bootstrap",
    max_keys: int | None = None,
) -> DataFrame:
    """Counts (keys, b, feature, value, x, y) of what ``resample_rows`` draws, values that no draw hits left out.

    A row is read once per ``TOGETHER`` replicates: its draws are compared in place, and a value's counts for these
    replicates are added side by side, so neither the features nor the groups are repeated per replicate."""
    _, per_draw, _ = _draw_limits(df, keys, row_key, replicates, seed, side, first, method, max_keys)
    chunk = F.floor((F.col("b") - 1) / TOGETHER).cast("int")
    marks = {f"_{cut_}{i}": F.max(F.when(F.col("b") % TOGETHER == (i + 1) % TOGETHER, F.col(f"_cut_{cut_}"))) for i in range(TOGETHER) for cut_ in "xy"}
    limits = per_draw.groupBy(*keys, chunk.alias("_chunk")).agg(*[c.alias(n) for n, c in marks.items()])
    chunks = -(-(replicates - 1) // TOGETHER)
    rows = df.select(*dict.fromkeys([*keys, *row_key, *columns])).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    rows = lookup_join(rows, limits, [*keys, "_chunk"], None if max_keys is None else max_keys * chunks)
    x_bits = y_bits = F.lit(0).cast("long")
    named = rows.withColumns({f"_h{i}": draw(seed, "resample", F.col("_chunk") * TOGETHER + i + 1, *row_key) for i in range(TOGETHER)})
    for i in range(TOGETHER):
        x = flag(F.substring(f"_h{i}", 1, 16) <= F.col(f"_x{i}"))
        y = 1 - x if method == "permutation" else flag(F.substring(f"_h{i}", 17, 16) <= F.col(f"_y{i}"))
        drawn = F.col(f"_x{i}").isNotNull()
        x_bits = x_bits.bitwiseOR(F.shiftleft(F.when(drawn, x).otherwise(0).cast("long"), i))
        y_bits = y_bits.bitwiseOR(F.shiftleft(F.when(drawn, y).otherwise(0).cast("long"), i))
    packed = named.select(*keys, "_chunk", *columns, x_bits.alias("_xs"), y_bits.alias("_ys"))

    def bit(name: str, i: int) -> Column:
        return F.shiftright(name, i).bitwiseAND(F.lit(1).cast("long"))

    added = (
        melt(packed, [*keys, "_chunk", "_xs", "_ys"], columns)
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "_chunk", "feature", "value")
        .agg(*[F.sum(bit(f"_{s}s", i)).alias(f"{s}{i}") for i in range(TOGETHER) for s in "xy"])
    )
    each = [
        F.struct((F.col("_chunk") * TOGETHER + i + 1).cast("int").alias("b"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"))
        for i in range(TOGETHER)
    ]
    apart = added.select(*keys, "feature", "value", F.inline(F.array(*each)))
    return apart.filter(F.col("x") + F.col("y") > 0).select(*keys, "b", "feature", "value", "x", "y")


def _exceedance(boot: DataFrame, observed: DataFrame, keys: list[str], measure: str, replicates: int) -> DataFrame:
    """Share of replicates beyond the observed distance; both rounded so that equal sums tie."""
    found = boot.join(observed.withColumnRenamed(measure, "distance"), keys)
    return found.groupBy(*keys, "distance").agg(
        (count_if(F.round(measure, 9) > F.round("distance", 9)) / F.lit(float(replicates))).alias("p_value")
    )


def hash_pvalues(
    sliced: DataFrame,
    columns: list[str],
    measure: str,
    row_key: list[str],
    replicates: int = 1000,
    seed: int = 42,
    keys: list[str] | None = None,
    method: str = "bootstrap",
    boundary: str = "reference",
    max_keys: int | None = None,
) -> DataFrame:
    """(keys, feature, distance, p_value) with rows drawn by hash rank."""
    keys = ["class"] if keys is None else keys
    groups = [*keys, "feature"]
    observed = distances(value_counts_by_side(sliced, keys, columns), groups, boundary=boundary, measures=[measure])
    counts = drawn_counts(sliced, keys, columns, row_key, replicates, seed, method=method, max_keys=max_keys)
    boot = distances(counts, [*keys, "b", "feature"], boundary=boundary, measures=[measure])
    return _exceedance(boot, observed, groups, measure, replicates)


# --- draws from counts ------------------------------------------------------------------------


def _log_factorial_step(start: float, step: float) -> float:
    """log((start + step)!) - log(start!) without the cancellation of two large logarithms."""
    end = start + step
    if min(start, end) < 1000:
        return math.lgamma(end + 1) - math.lgamma(start + 1)
    tail = (1 / end - 1 / start) / 12 - (1 / end**3 - 1 / start**3) / 360
    return (start + 0.5) * math.log1p(step / start) + step * math.log(end) - step + tail


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good items among n drawn without replacement, for populations of any size.

    Ratio of uniforms with a table-mountain hat (Stadlober): about the same few tries for any
    population, and no part of the distribution is cut. Numpy's generator does the same below its limit."""
    low, high = max(0, n - bad), min(n, good)
    if low >= high:
        return low
    total = good + bad
    if total < EXACT_POPULATION:
        return int(rng.hypergeometric(good, bad, n))
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    mean = n * (good / total)
    width = math.sqrt(mean * (bad / total) * ((total - n) / (total - 1)) + 0.5)
    # 2 * sqrt(2 / e) and 3 - 2 * sqrt(3 / e), the hat's width and offset.
    reach = 2 * math.sqrt(2 / math.e) * width + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + reach * (v - 0.5) / u)
        if not low <= k <= high:
            continue
        d = k - mode
        height = -(
            _log_factorial_step(mode, d)
            + _log_factorial_step(good - mode, -d)
            + _log_factorial_step(n - mode, -d)
            + _log_factorial_step(bad - n + mode, d)
        )
        if 2 * math.log(u) <= height:
            return int(k)


def split_draw(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of n items drawn without replacement fall into each of the given cells."""
    total = int(sizes.sum())
    if total < EXACT_POPULATION:
        return rng.multivariate_hypergeometric(sizes, n, method="marginals")
    result = np.zeros(len(sizes), dtype=np.int64)
    left, rest = int(n), total
    for i, size in enumerate(sizes):
        rest -= int(size)
        result[i] = hypergeometric(rng, int(size), rest, left)
        left -= int(result[i])
    return result


def _key_number(values: tuple) -> int:
    return zlib.crc32(repr(values).encode())


def partial_measures(x, y, value, next_value, off_x, off_y, nx: int, ny: int, less: int) -> tuple:
    """A bucket's share of the six measures: four sums, the largest and the smallest step."""
    cx, cy = off_x + np.cumsum(x), off_y + np.cumsum(y)
    n, c = nx + ny, cx + cy
    inside = (c <= n - less) & (x + y > 0)
    # Values that no draw hit are skipped, so a gap runs from one hit value to the next.
    h = np.abs(cy / ny - cx / nx)
    signed = cy / ny - cx / nx
    sd = np.sqrt(c.astype(float) * (n - c) / n)
    scaled = np.divide(h, sd, out=np.zeros_like(h), where=sd > 0)
    reach = c <= n - less
    w = np.where(reach, next_value - value, 0.0)
    # h is constant between hits, so summing over every value with its own gap equals summing over
    # hit values with their longer gaps.
    return (
        float(scaled[inside].sum()),
        float(h[inside].sum()),
        float((scaled * w)[reach].sum()),
        float((h * w)[reach].sum()),
        float(max(0.0, signed[inside].max(initial=0.0))),
        float(min(0.0, signed[inside].min(initial=0.0))),
    )


PARTIALS = ["ad", "cvm", "dts", "wd", "up", "down"]


def count_pvalues(
    counts: DataFrame,
    keys: list[str],
    replicates: int = 1000,
    seed: int = 42,
    method: str = "bootstrap",
    boundary: str = "reference",
    bucket_size: int = 16_384,
    layout: str = "auto",
) -> DataFrame:
    """(keys, measure, distance, p_value) for all six measures, from counts (keys, value, x, y)."""
    if method not in ("bootstrap", "permutation"):
        raise ValueError("method is 'bootstrap' or 'permutation'")
    less, b_count = CUT[boundary], replicates
    placed = (
        prefix_sums(counts, keys, "value", ["x", "y"], layout)
        .filter((F.col("all_x") > 0) & (F.col("all_y") > 0))
        .withColumn("bucket", F.floor((F.col("position") - 1) / bucket_size))
        .select(
            *keys, "bucket", F.col("value").cast("double").alias("value"), F.col("next_value").cast("double").alias("next_value"),
            F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"),
            F.col("all_x").alias("nx"), F.col("all_y").alias("ny"),
        )
    )
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.select(*keys).schema.fields)
    totals = placed.groupBy(*keys, "bucket").agg(
        F.sum("x").alias("bx"), F.sum("y").alias("by"), F.max("nx").alias("nx"), F.max("ny").alias("ny")
    )

    def split_replicates(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        group, first_b = key[:-1], int(key[-1]) * B_CHUNK
        nx, ny = int(pdf["nx"].iloc[0]), int(pdf["ny"].iloc[0])
        bx, by = pdf["bx"].to_numpy(np.int64), pdf["by"].to_numpy(np.int64)
        blocks = []
        for b in range(first_b, min(first_b + B_CHUNK, b_count)):
            if b == 0:
                e, f = bx, by
            else:
                rng = np.random.default_rng([seed, _key_number(group), b, 0])
                e = split_draw(rng, bx + by, nx)
                f = bx + by - e if method == "permutation" else split_draw(rng, bx + by, ny)
            blocks.append(np.column_stack([pdf["bucket"], np.full(len(e), b), e, f, np.cumsum(e) - e, np.cumsum(f) - f]))
        out = pd.DataFrame(np.concatenate(blocks), columns=["bucket", "b", "e", "f", "off_e", "off_f"])
        for place, (k, v) in enumerate(zip(keys, group)):
            out.insert(place, k, v)
        return out

    chunks = (b_count + B_CHUNK - 1) // B_CHUNK
    replicated = totals.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    parts = replicated.groupBy(*keys, "chunk").applyInPandas(
        split_replicates, f"{key_schema}, bucket long, b int, e long, f long, off_e long, off_f long"
    )

    def draw_bucket(key: tuple, rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("value")
        group, bucket = key[:-2], int(key[-2])
        x, y = rows["x"].to_numpy(np.int64), rows["y"].to_numpy(np.int64)
        value, following = rows["value"].to_numpy(float), rows["next_value"].to_numpy(float)
        nx, ny = int(rows["nx"].iloc[0]), int(rows["ny"].iloc[0])
        found = []
        for b, e, f, off_e, off_f in plan[["b", "e", "f", "off_e", "off_f"]].itertuples(index=False):
            if b == 0:
                ex, fy = x, y
            else:
                rng = np.random.default_rng([seed, _key_number(group), int(b), 1 + bucket])
                ex = split_draw(rng, x + y, int(e))
                fy = x + y - ex if method == "permutation" else split_draw(rng, x + y, int(f))
            found.append((*group, int(b), *partial_measures(ex, fy, value, following, off_e, off_f, nx, ny, less)))
        return pd.DataFrame(found, columns=[*keys, "b", *PARTIALS])

    # A bucket of counts is small and is repeated per chunk of replicates, so that no task has them all.
    every_chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    of_chunk = parts.withColumn("chunk", F.floor(F.col("b") / B_CHUNK).cast("int"))
    pieces = (
        placed.withColumn("chunk", every_chunk)
        .groupBy(*keys, "bucket", "chunk")
        .cogroup(of_chunk.groupBy(*keys, "bucket", "chunk"))
        .applyInPandas(draw_bucket, f"{key_schema}, b int, " + ", ".join(f"{c} double" for c in PARTIALS))
    )
    whole = pieces.groupBy(*keys, "b").agg(
        *[F.sum(c).alias(c) for c in ("ad", "cvm", "dts", "wd")], F.max("up").alias("up"), F.min("down").alias("down")
    )
    wide = whole.select(
        *keys,
        "b",
        F.col("ad").alias("Anderson_Darling"),
        F.col("cvm").alias("CVM"),
        F.col("dts").alias("DTS"),
        F.greatest(F.col("up"), -F.col("down")).alias("Kolmogorov_Smirnov"),
        (F.col("up") + F.abs("down")).alias("Kuiper"),
        F.col("wd").alias("Wasserstein"),
    )
    # One row per group and replicate, each with six numbers: compared within the group's array.
    per_group = to_long_form(wide, [*keys, "b"]).groupBy(*keys, "measure").agg(
        F.max(F.when(F.col("b") == 0, F.round("distance", 9))).alias("_seen"),
        F.max(F.when(F.col("b") == 0, F.col("distance"))).alias("distance"),
        F.collect_list(F.when(F.col("b") > 0, F.round("distance", 9))).alias("_boot"),
    )
    beyond = F.size(F.filter("_boot", lambda d: d > F.col("_seen")))
    return per_group.select(*keys, "measure", "distance", (beyond / F.lit(float(b_count))).alias("p_value"))


def distance_pvalues(
    sliced: DataFrame, columns: list[str], keys: list[str] | None = None, **options
) -> DataFrame:
    """p-values of all six measures per (keys, feature), drawn from counts."""
    keys = ["class"] if keys is None else keys
    return count_pvalues(value_counts_by_side(sliced, keys, columns), [*keys, "feature"], **options)


# --- maps over array positions ----------------------------------------------------------------


def position_counts(df: DataFrame, array: str, keys: list[str], x: Column, y: Column) -> DataFrame:
    """Counts per (keys, position, value) of arrays of one length."""
    flat = df.select(*keys, x.alias("_x"), y.alias("_y"), F.posexplode(array).alias("position_in_array", "value"))
    return (
        flat.filter(F.col("value").isNotNull())
        .groupBy(*keys, F.col("position_in_array").alias("pos"), F.col("value").cast("double").alias("value"))
        .agg(F.sum("_x").alias("x"), F.sum("_y").alias("y"))
    )


def mask_map(found: DataFrame, alpha: float) -> DataFrame:
    """Distances whose p-value exceeds alpha become 0 in ``masked``."""
    return found.withColumn("masked", F.when(F.col("p_value") > alpha, 0.0).otherwise(F.col("distance")))


def position_distance_map(
    df: DataFrame,
    array: str,
    row_key: list[str],
    side: str = "side",
    first: str = "x",
    keys: list[str] | None = None,
    measure: str = "Wasserstein",
    alpha: float = 0.05,
    replicates: int = 1000,
    seed: int = 42,
    draws: str = "counts",
    max_keys: int | None = None,
) -> DataFrame:
    """Distance, p-value and masked distance per (keys, position), from every row of both sides.

    ``draws="counts"`` resamples each position from its counts, ``"hash"`` draws whole rows."""
    keys = list(keys or [])
    on_first = F.col(side) == F.lit(first)
    counts = position_counts(df, array, keys, flag(on_first), flag(~on_first))
    if draws == "counts":
        found = count_pvalues(counts, [*keys, "pos"], replicates, seed).filter(F.col("measure") == measure).drop("measure")
        return mask_map(found, alpha)
    observed = distances(counts, [*keys, "pos"], measures=[measure])
    bound = 1 if not keys else max_keys
    drawn = resample_rows(df.select(*keys, *row_key, side, array), keys, row_key, replicates, seed, side, first, max_keys=bound)
    boot = distances(position_counts(drawn, array, [*keys, "b"], F.col("x"), F.col("y")), [*keys, "b", "pos"], measures=[measure])
    return mask_map(_exceedance(boot, observed, [*keys, "pos"], measure, replicates), alpha)


def map_similarity(found: DataFrame, keys: list[str] | None = None, value: str = "distance") -> DataFrame:
    """One minus the mean of the non-zero values of a map."""
    grouped = found.groupBy(*keys) if keys else found.groupBy()
    return grouped.agg((1 - F.avg(F.when(F.col(value) != 0, F.col(value)))).alias("similarity"))


def permutation_ttest_map(
    df: DataFrame,
    array: str,
    row_key: list[str],
    side: str = "side",
    first: str = "x",
    alpha: float = 0.05,
    iterations: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """Pooled two-sample t per array position, two-sided; the threshold is the (1 - alpha) quantile
    of max |t| over random relabellings, and values below it are 0 in ``masked``.

    Means and variances of whole vectors are aggregated on the JVM, combined before the shuffle;
    the shuffle carries two vectors per relabelling and task."""
    relabelled = resample_rows(
        df.select(*row_key, side, array), [], row_key, iterations + 1, seed, side, first, "permutation", max_keys=1
    )
    observed = df.select(
        F.lit(0).alias("b"), array, flag(F.col(side) == F.lit(first)).alias("x")
    )
    rows = observed.unionByName(relabelled.select("b", array, "x"))
    vectors = rows.select("b", "x", array_to_vector(F.col(array).cast("array<double>")).alias("v"))
    stats = vectors.groupBy("b", "x").agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")
    ).select("b", "x", vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v"), F.col("s.count").alias("n"))
    on_x = F.col("x") == 1

    def of(condition: Column, name: str) -> Column:
        return F.first(F.when(condition, F.struct("m", "v", "n")), ignorenulls=True).alias(name)

    pairs = stats.groupBy("b").agg(of(on_x, "p"), of(~on_x, "q"))
    nx, ny = F.col("p.n").cast("double"), F.col("q.n").cast("double")
    zipped = F.arrays_zip(F.col("p.m").alias("a"), F.col("q.m").alias("c"), F.col("p.v").alias("d"), F.col("q.v").alias("e"))

    def t_value(z: Column) -> Column:
        pooled = ((nx - 1) * z["d"] + (ny - 1) * z["e"]) / (nx + ny - 2)
        return F.coalesce(F.try_divide(z["a"] - z["c"], F.sqrt(pooled * (1 / nx + 1 / ny))), F.lit(0.0))

    values = pairs.select("b", F.transform(zipped, t_value).alias("t")).withColumn(
        "peak", F.array_max(F.transform("t", lambda v: F.abs(v)))
    )
    # One number per relabelling: the exact quantile buffers at most ``iterations`` values.
    threshold = values.filter(F.col("b") > 0).agg(F.percentile("peak", F.lit(1.0 - alpha))).scalar()
    flat = values.filter(F.col("b") == 0).select(F.posexplode("t").alias("pos", "t")).withColumn("threshold", threshold)
    return flat.withColumn("masked", F.when(F.abs("t") < F.col("threshold"), 0.0).otherwise(F.col("t")))


# --- Chernoff distance ------------------------------------------------------------------------


def chernoff_univariate(df: DataFrame, columns: list[str], side: str = "side", first: str = "train") -> DataFrame:
    """Chernoff distance per feature from the two means and population variances, and the error
    bound exp(-distance)."""
    on_first = F.col(side) == F.lit(first)
    v = F.col("value").cast("double")
    stats = melt(df, [side], columns).groupBy("feature").agg(
        F.avg(F.when(on_first, v)).alias("m0"), F.avg(F.when(~on_first, v)).alias("m1"),
        F.var_pop(F.when(on_first, v)).alias("v0"), F.var_pop(F.when(~on_first, v)).alias("v1"),
    )
    v0, v1 = F.col("v0"), F.col("v1")
    spread = 0.25 * F.log(0.25 * (ratio(v0, v1) + ratio(v1, v0)) + 0.5)
    gap = 0.25 * ratio(F.pow(F.col("m0") - F.col("m1"), F.lit(2.0)), v0 + v1)
    return stats.select("feature", (spread + gap).alias("chernoff")).withColumn("error_bound", F.exp(-F.col("chernoff")))


def chernoff_from_moments(m0, m1, s0, s1) -> float:
    """Multivariate form from two mean vectors and covariance matrices."""
    m0, m1, s0, s1 = (np.asarray(a, dtype=float) for a in (m0, m1, s0, s1))
    middle = (s0 + s1) / 2
    gap = m0 - m1
    logdet = [np.linalg.slogdet(s)[1] for s in (middle, s0, s1)]
    return float(0.125 * gap @ np.linalg.solve(middle, gap) + 0.5 * (logdet[0] - 0.5 * (logdet[1] + logdet[2])))


def chernoff_multivariate(df: DataFrame, columns: list[str], side: str = "side", first: str = "train") -> DataFrame:
    """Multivariate Chernoff distance. Means and covariances come from one distributed aggregation;
    only the resulting d x d matrices reach numpy, in one row."""
    on_first = F.col(side) == F.lit(first)
    d = len(columns)
    pick = {s: {c: F.when(on_first if s == 0 else ~on_first, F.col(c).cast("double")) for c in columns} for s in (0, 1)}
    moments = df.agg(
        *[F.array(*[F.avg(pick[s][c]) for c in columns]).alias(f"m{s}") for s in (0, 1)],
        *[F.array(*[F.covar_pop(pick[s][a], pick[s][b]) for a in columns for b in columns]).alias(f"s{s}") for s in (0, 1)],
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [
                chernoff_from_moments(r.m0, r.m1, np.reshape(r.s0, (d, d)), np.reshape(r.s1, (d, d))) for r in pdf.itertuples()
            ]
            yield pd.DataFrame({"chernoff": values})

    return moments.mapInPandas(solve, "chernoff double").withColumn("error_bound", F.exp(-F.col("chernoff")))


__all__ = [
    "chernoff_from_moments",
    "chernoff_multivariate",
    "chernoff_univariate",
    "count_pvalues",
    "distance_pvalues",
    "hash_pvalues",
    "map_similarity",
    "permutation_ttest_map",
    "position_distance_map",
    "resample_rows",
]
