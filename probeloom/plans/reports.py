"""Summary of evaluations and the report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.functions.scalars import fixed_text, percent_text
from probeloom.operators import checks
from probeloom.operators.checks import CheckFailed, assert_empty
from probeloom.sources.readers import read_reports

METRIC_FILE = (
    "method string, candidate string, C double, split string, n_rows long, macro_f1 double, accuracy double, "
    "balanced_accuracy double, log_loss double"
)


def summarize_evaluations(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """One row per evaluation; all must share one split and exactly one cohort."""
    rows = read_reports(spark, [f"{f}/metrics" for f in folders], METRIC_FILE)
    if rows.select("split").distinct().count() != 1:
        raise CheckFailed("the evaluations are of different splits")
    first = spark.read.parquet(f"{folders[0]}/predictions")
    for other in folders[1:]:
        assert_empty(checks.cohort_differences(first, spark.read.parquet(f"{other}/predictions")), f"{other}: cohort")
    return rows


def label_group_counts(entities: DataFrame, groups: Sequence[str], weight: str | None = None) -> DataFrame:
    """label x group counts with totals on both margins.

    ``weight`` names a column of pre-aggregated row counts. The margins are
    taken from the small table of cells.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    cells = entities.groupBy("label", "grp").agg(n.alias("n"))
    wide = cells.cube("label", "grp").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    named = wide.select(
        F.when(F.col("g").bitwiseAND(2) != 0, "Total").otherwise(F.col("label")).alias("label"),
        F.when(F.col("g").bitwiseAND(1) != 0, "Total").otherwise(F.col("grp")).alias("grp"), "n",
    )
    return named.groupBy("label").pivot("grp", [*groups, "Total"]).agg(F.sum("n")).na.fill(0)


def ranked_grid(ranking: DataFrame) -> DataFrame:
    return ranking.orderBy("rank").select(
        "atoms", "alpha", F.format_string("%.4g", "C").alias("C"),
        fixed_text(F.col("val_macro_f1"), 6).alias("macro_f1"),
        percent_text(F.col("validation_active_fraction")).alias("active_percent"),
        fixed_text(F.col("validation_relative_mse"), 4).alias("relative_mse"),
    )


def f1_by_group(group_means: DataFrame, seed_variation: DataFrame, methods: Sequence[str],
                seeded: str = "dictionary") -> DataFrame:
    """Standardized F1 per group and method, with the seed SD of the seeded method."""
    wide = group_means.filter("scaling = 'standard'").groupBy("grp").pivot("method", list(methods)).agg(F.first("macro_f1"))
    spread = seed_variation.filter(f"scaling = 'standard' AND method = '{seeded}'").select("grp", "std")
    return wide.join(spread, "grp").select(
        "grp", *[fixed_text(F.col(m), 6).alias(m) for m in methods], fixed_text(F.col("std"), 6).alias("seed_sd")
    )


def f1_by_class(reports: dict[str, DataFrame]) -> DataFrame:
    """Per-class F1 of each method next to the support."""
    out = None
    for name, df in reports.items():
        one = df.filter("label NOT IN ('accuracy', 'macro avg', 'weighted avg')").select(
            "label", "support", fixed_text(F.col("f1_score"), 4).alias(name)
        )
        out = one if out is None else out.join(one.drop("support"), "label")
    return out


def selected_activity(activity: DataFrame, top_features: DataFrame, pairs: Sequence[tuple[int, str]], n_top: int = 3) -> DataFrame:
    """Chosen (atom, label) pairs with leading positive features and standardized means per split."""
    spark = activity.sparkSession
    wanted = spark.createDataFrame([(int(a), str(c)) for a, c in pairs], "atom int, label string")
    named = top_features.filter(f"sign = 'positive' AND rank <= {n_top}").groupBy("atom").agg(
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("feature")))), lambda s: s["feature"])).alias("features")
    )
    wide = activity.join(F.broadcast(wanted), ["atom", "label"]).groupBy("atom", "label").pivot(
        "split", ["train", "validation"]).agg(F.first("standardized_mean"))
    return wide.join(named, "atom", "left").select(
        "atom", "features", "label", fixed_text(F.col("train"), 3).alias("train"), fixed_text(F.col("validation"), 3).alias("validation")
    )
