"""Summaries across groups and methods, and rules that pick one candidate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeloom.operators.metrics import METRICS
from probeloom.session import settle


def group_means(rows: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Average seeds inside each (method, scaling, grp) first."""
    return rows.groupBy("method", "scaling", "grp").agg(*[F.avg(m).alias(m) for m in metrics])


def two_level_summary(rows: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean and sample SD over groups; groups are the replication unit."""
    return group_means(rows, metrics).groupBy("method", "scaling").agg(
        *[f(m).alias(f"{m}_{name}") for m in metrics for name, f in (("mean", F.avg), ("std", F.stddev_samp))]
    )


def seed_variation(rows: DataFrame, metric: str = "macro_f1") -> DataFrame:
    return rows.groupBy("method", "scaling", "grp").agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"),
        F.min(metric).alias("min"), F.max(metric).alias("max"),
    )


def paired_differences(rows: DataFrame, base: str, others: Sequence[str], metric: str = "macro_f1") -> DataFrame:
    """Per group: standard minus none for each method, each method minus ``base``."""
    methods = [base, *others]
    cells = [f"{m}_{s}" for m in methods for s in ("standard", "none")]
    wide = (
        group_means(rows, [metric]).withColumn("cell", F.concat_ws("_", "method", "scaling"))
        .groupBy("grp").pivot("cell", cells).agg(F.first(metric))
    )
    out = [(F.col(f"{m}_standard") - F.col(f"{m}_none")).alias(f"{m}_standard_minus_none") for m in methods]
    out += [
        (F.col(f"{m}_standard") - F.col(f"{base}_standard")).alias(f"{m}_minus_{base}_standard") for m in others
    ]
    return wide.select("grp", *out)


def _best(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key. Candidate tables hold one row per fit."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(place)).filter("_rn = 1").drop("_rn")


def best_c(rows: DataFrame, keys: Sequence[str] = ("feature_set",), score: str = "val_macro_f1") -> DataFrame:
    """Converged fits only; highest score, then the smallest C."""
    return _best(rows.filter("converged"), keys, [F.col(score).desc(), F.col("C").asc()])


def best_lambda(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A penalty counts only if all its inner fits converged; ties go to the larger."""
    table = rows.groupBy(*keys, "lambda").agg(
        F.bool_and("converged").alias("all_converged"), F.avg("macro_f1").alias("mean_macro_f1")
    ).filter("all_converged")
    return _best(table, keys, [F.col("mean_macro_f1").desc(), F.col("lambda").desc()]).drop("all_converged")


def rank_dictionaries(best: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Score desc, fewer atoms, fewer active atoms, name. Strict one-to-one merge."""
    best, diagnostics = settle(best), settle(diagnostics)
    repeated = best.select("candidate").unionByName(diagnostics.select("candidate")).groupBy("candidate").agg(
        F.count(F.lit(1)).alias("n")
    )
    if not repeated.filter("n <> 2").isEmpty():
        raise ValueError("Candidates and diagnostics do not match one to one")
    merged = best.join(diagnostics, "candidate")
    place = Window.orderBy(
        F.col("val_macro_f1").desc(), F.col("atoms").asc(),
        F.col("validation_mean_active_atoms").asc(), F.col("candidate").asc(),
    )
    return merged.withColumn("rank", F.row_number().over(place))
