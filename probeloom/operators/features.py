"""Library-size normalization, variance selection and frozen z-scoring.

Counts stay sparse (absent = 0) until a bounded set of features is selected.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeloom.functions import vectors as V
from probeloom.functions.arrow import task_function
from probeloom.functions.scalars import TARGET_SUM, VARIANCE_FLOOR, log_rate, safe_scale
from probeloom.session import bounded_rows, settle

MAX_GROUPS = 10_000
MAX_FOLDS = 10_000
# Coordinates summed by Summarizer differ in their last bits from run to run; where
# such variances are ranked, they are compared to this precision.
RANK_DECIMALS = 12
# Sums are taken of values cut at 2^-44, as two whole numbers of these many bits below
# one. Whole numbers add up to the same total in any order, and can be taken off again.
HIGH_BITS, LOW_BITS = 20, 24


def with_totals(counts: DataFrame) -> DataFrame:
    """Attach the library size over all features unless the source knows it."""
    if "total" in counts.columns:
        return counts
    totals = counts.groupBy("entity_id").agg(F.sum("cnt").alias("total"))
    return counts.join(totals, "entity_id")


def normalize_log(counts: DataFrame, target: float = TARGET_SUM) -> DataFrame:
    """Add ``x``, the log of the scaled rate; sums run over all features."""
    return with_totals(counts).withColumn("x", log_rate(F.col("cnt"), F.col("total"), target))


def sum_duplicates(counts: DataFrame) -> DataFrame:
    """Merge repeated (entity, feature) rows."""
    keys = [c for c in counts.columns if c != "cnt"]
    return counts.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def moments(n: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
    """Mean and population variance over ``n`` entities, absent rows being 0."""
    mean = s1 / n
    return mean, F.greatest(s2 / n - mean * mean, F.lit(0.0))


def exact_sum(x: Column) -> Column:
    """Order-independent sum: a struct of two longs, see :func:`total`.

    Holds as long as the absolute values add up to less than 2^43 over fewer than
    2^39 rows; beyond that the long sum overflows, which is an error.
    """
    scaled = x * F.lit(float(1 << HIGH_BITS))
    high = F.floor(scaled)
    low = F.floor((scaled - high) * F.lit(float(1 << LOW_BITS)) + F.lit(0.5))
    return F.struct(F.sum(high).alias("high"), F.sum(low).alias("low"))


def exact_zero() -> Column:
    return F.struct(F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """a + b, or a - b, of exact sums."""
    return F.struct((a["high"] + sign * b["high"]).alias("high"), (a["low"] + sign * b["low"]).alias("low"))


def total(s: Column) -> Column:
    """The double that an exact sum stands for."""
    return s["high"] / F.lit(float(1 << HIGH_BITS)) + s["low"] / F.lit(float(1 << (HIGH_BITS + LOW_BITS)))


def feature_moments(log_counts: DataFrame, n_entities: int, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Mean and variance per key, with the same bits however the rows are partitioned."""
    sums = log_counts.groupBy(*keys).agg(exact_sum(F.col("x")).alias("s1"), exact_sum(F.col("x") * F.col("x")).alias("s2"))
    mean, variance = moments(F.lit(float(n_entities)), total(F.col("s1")), total(F.col("s2")))
    return sums.select(*keys, mean.alias("mean"), variance.alias("variance"))


def select_features(stats: DataFrame, n_features: int, position: str = "feature_id") -> DataFrame:
    """Top features by variance, renumbered in source order.

    Ties go to the lower position. The top-k is a distributed take-ordered; the
    renumbering window sees at most ``n_features`` rows.
    """
    top = stats.filter(F.col("variance") > VARIANCE_FLOOR).orderBy(F.col("variance").desc(), F.col(position).asc()).limit(n_features)
    place = Window.orderBy(position)
    return top.withColumn("out_pos", F.row_number().over(place) - 1).withColumn(
        "scale", safe_scale(F.col("variance"))
    )


def fit_features(log_train: DataFrame, n_train: int, n_features: int = 2000) -> DataFrame:
    """Fitted transform: feature_id, out_pos, mean, scale, variance."""
    if n_features < 1 or n_train < 2:
        raise ValueError("Need a positive feature count and at least two training entities")
    fitted = select_features(feature_moments(log_train, n_train), n_features)
    return fitted.select("feature_id", "out_pos", "mean", "scale", "variance")


def fit_panel(log_train: DataFrame, n_train: int, panel: DataFrame) -> DataFrame:
    """Fitted transform for a fixed ordered panel (feature_id, out_pos).

    Constant panel features stay, with scale 1; absent ones have mean 0.
    """
    stats = feature_moments(log_train.join(panel.select("feature_id"), "feature_id", "left_semi"), n_train)
    return panel.join(stats, "feature_id", "left").select(
        "feature_id", "out_pos",
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        safe_scale(F.coalesce("variance", F.lit(0.0))).alias("scale"),
        F.coalesce("variance", F.lit(0.0)).alias("variance"),
    )


def settle_fitted(fitted: DataFrame, n_features: int) -> DataFrame:
    """Evaluate a fitted transform once; its size is the requested feature count."""
    return settle(fitted, max_rows=n_features, name="fitted")


def fitted_arrays(fitted: DataFrame, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    rows = bounded_rows(fitted.select("out_pos", "mean", "scale"), n_features, "fitted features")
    rows.sort(key=lambda r: r["out_pos"])
    return np.array([r["mean"] for r in rows]), np.array([r["scale"] for r in rows])


def scatter_scaled(mean: np.ndarray, scale: np.ndarray):
    """Column function (positions, values) -> dense z-scored vector.

    Arrow-batched: stored values are placed into a zero matrix, then the whole
    batch is centred, so an absent feature becomes -mean/scale.
    """
    p = len(mean)

    @task_function("array<float>")
    def dense(positions: pa.Array, values: pa.Array) -> pa.Array:
        n = len(positions)
        x = np.zeros((n, p))
        lengths = np.diff(positions.offsets.to_numpy())
        rows = np.repeat(np.arange(n), lengths)
        x[rows, positions.flatten().to_numpy(zero_copy_only=False)] = values.flatten().to_numpy(
            zero_copy_only=False
        )
        x = ((x - mean) / scale).astype(np.float32)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * p)
        return pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))

    return dense


def transform_vectors(log_counts: DataFrame, entities: DataFrame, fitted: DataFrame,
                      n_features: int) -> DataFrame:
    """entities plus ``vec``: frozen transform applied to every entity (unique entity_id).

    Counts are cut to the fitted features first, so a collected list is never
    longer than the selection. Entity rows are stacked under them and meet
    their values in one grouped shuffle; entities without a selected feature
    stay, counts of other entities drop out.
    """
    mean, scale = fitted_arrays(fitted, n_features)
    others = [c for c in entities.columns if c != "entity_id"]
    kept = log_counts.join(fitted.select("feature_id", "out_pos"), "feature_id").select("entity_id", "out_pos", "x")
    about = entities.select("entity_id", F.struct(F.lit(True).alias("_known"), *others).alias("_about"))
    lists = kept.unionByName(about, allowMissingColumns=True).groupBy("entity_id").agg(
        F.max("_about").alias("_about"), F.collect_list("out_pos").alias("_p"), F.collect_list("x").alias("_v")
    ).filter("_about._known")
    dense = scatter_scaled(mean, scale)
    return lists.select("entity_id", *[F.col(f"_about.{c}").alias(c) for c in others], dense("_p", "_v").alias("vec"))


# --- fold-wise statistics -----------------------------------------------------

def excluded_moments(log_counts: DataFrame, sizes: dict[str, int], folds: Sequence[Sequence[str]]) -> DataFrame:
    """fold, feature_id, mean, variance over the entities outside the groups that each fold leaves out.

    Sums are exact, so one scan keyed by (group, feature) serves all folds: a fold
    takes the sums of its groups off those of all. Features that no training entity
    of a fold has keep mean and variance 0. ``log_counts``: grp, feature_id, x;
    ``sizes``: entities per group.
    """
    if len(sizes) > MAX_GROUPS or len(folds) > MAX_FOLDS:
        raise ValueError(f"More than {MAX_GROUPS} groups or {MAX_FOLDS} folds")
    per_group = log_counts.groupBy("grp", "feature_id").agg(
        exact_sum(F.col("x")).alias("s1"), exact_sum(F.col("x") * F.col("x")).alias("s2")
    )
    per_feature = per_group.groupBy("feature_id").agg(
        F.collect_list(F.struct("grp", "s1", "s2")).alias("parts"),
        *[F.struct(F.sum(f"{s}.high").alias("high"), F.sum(f"{s}.low").alias("low")).alias(f"all_{s}") for s in ("s1", "s2")],
    )
    n_all = sum(sizes.values())
    listed = F.array(*[
        F.struct(F.lit(i).alias("fold"), F.lit(float(n_all - sum(sizes[g] for g in left))).alias("n"),
                 F.array(*[F.lit(g) for g in left]).alias("left_out"))
        for i, left in enumerate(folds)
    ])
    opened = per_feature.select("feature_id", "parts", "all_s1", "all_s2", F.inline(listed))
    gone = F.filter("parts", lambda part: F.array_contains("left_out", part["grp"]))

    def kept(s: str) -> Column:
        return total(combine(F.col(f"all_{s}"), F.aggregate(gone, exact_zero(), lambda acc, part: combine(acc, part[s])), -1))

    mean, variance = moments(F.col("n"), kept("s1"), kept("s2"))
    return opened.select("fold", "feature_id", mean.alias("mean"), variance.alias("variance"))


def fold_moments(log_counts: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Training mean and variance of every feature for every left-out group (outer_grp)."""
    names = sorted(sizes)
    found = excluded_moments(log_counts, sizes, [(g,) for g in names])
    return found.select(F.element_at(F.array(*[F.lit(g) for g in names]), F.col("fold") + 1).alias("outer_grp"), "feature_id", "mean", "variance")


def select_per_fold(fold_stats: DataFrame, n_features: int, fold: str = "outer_grp") -> DataFrame:
    """Top features by training variance inside every fold, renumbered in source order.

    The ranking carries a limit, so each task forwards at most ``n_features``
    rows per fold however large the vocabulary is; the renumbering window sees
    only the selected rows.
    """
    ranked = Window.partitionBy(fold).orderBy(F.col("variance").desc(), "feature_id")
    place = Window.partitionBy(fold).orderBy("feature_id")
    return (
        fold_stats.filter(F.col("variance") > VARIANCE_FLOOR)
        .withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= n_features).drop("_rank")
        .withColumn("out_pos", F.row_number().over(place) - 1)
        .withColumn("scale", safe_scale(F.col("variance")))
    )


def sparse_vectors(log_counts: DataFrame, entities: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """entities plus ``vec``, the stored values at ``places`` (feature_id, pos) as a sparse vector.

    Counts are cut to the places before they are collected, and meet their entity row
    in one grouped shuffle; entities without any of the features stay.
    """
    others = [c for c in entities.columns if c != "entity_id"]
    kept = log_counts.join(places, "feature_id").select("entity_id", F.struct(F.col("pos").cast("int").alias("pos"), "x").alias("_at"))
    about = entities.select("entity_id", F.struct(F.lit(True).alias("_known"), *others).alias("_about"))
    lists = kept.unionByName(about, allowMissingColumns=True).groupBy("entity_id").agg(
        F.max("_about").alias("_about"), F.array_sort(F.collect_list("_at")).alias("_at")
    ).filter("_about._known")
    vec = F.struct(F.lit(width).alias("size"), F.col("_at.pos").alias("pos"), F.col("_at.x").alias("val"))
    return lists.select("entity_id", *[F.col(f"_about.{c}").alias(c) for c in others], vec.alias("vec"))


# --- dense vectors ------------------------------------------------------------

def vector_moments(vectors: DataFrame, keys: Sequence[str] = (), vec: str = "vec") -> DataFrame:
    """keys, n, mean and population variance arrays per coordinate, in one pass."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    m = vectors.groupBy(*keys).agg(
        Summarizer.metrics("count", "mean", "variance").summary(v).alias("m")
    )
    n = F.col("m.count").cast("double")
    return m.select(
        *keys,
        F.col("m.count").alias("n"),
        vector_to_array("m.mean").alias("mean"),
        F.transform(vector_to_array("m.variance"), lambda s: s * (n - 1.0) / n).alias("variance"),
    )


def standardize(vectors: DataFrame, stats: DataFrame, keys: Sequence[str] = (), vec: str = "vec") -> DataFrame:
    """(x - mean)/sd per coordinate with statistics from :func:`vector_moments`.

    Without keys the statistics are one row of model size and become literals.
    With keys (folds, methods) there is one row per key; a size check decides
    between a broadcast and an ordinary join.
    """
    scaled = stats.select(
        *keys, F.col("mean").alias("_mean"), F.transform("variance", lambda v: safe_scale(v)).alias("_scale")
    )
    if keys:
        joined = vectors.join(settle(scaled, max_rows=MAX_GROUPS), list(keys))
        mean, scale = F.col("_mean"), F.col("_scale")
    else:
        row = scaled.first()
        joined, mean, scale = vectors, V.literal(row["_mean"]), V.literal(row["_scale"])
    centred = F.zip_with(F.col(vec).cast("array<double>"), mean, lambda x, m: x - m)
    return joined.withColumn(vec, F.zip_with(centred, scale, lambda x, sd: x / sd)).drop("_mean", "_scale")
