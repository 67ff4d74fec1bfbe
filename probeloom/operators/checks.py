"""Fail-closed data checks.

Each function returns the violations as a DataFrame; an empty result means the
check holds. Two-sided comparisons tag, union and group by key instead of
joining, so a key repeated many times is pre-aggregated before the shuffle and
can neither skew nor multiply rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeloom.functions import vectors as V
from probeloom.functions.scalars import ACTIVE_THRESHOLD, is_blank, is_finite
from probeloom.session import bounded_rows

MAX_CLASSES = 10_000


class CheckFailed(ValueError):
    """A data check found violations."""


def assert_empty(violations: DataFrame, what: str, examples: int = 5) -> None:
    rows = violations.limit(examples).collect()
    if rows:
        shown = "; ".join(str(r.asDict()) for r in rows)
        raise CheckFailed(f"{what}: {shown}")


def _tagged(sides: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Per key, the number of rows each side holds."""
    stacked = reduce(
        DataFrame.unionByName,
        [df.select(*keys, F.lit(name).alias("_side")) for name, df in sides.items()],
    )
    return stacked.groupBy(*keys).agg(
        *[F.count_if(F.col("_side") == name).alias(name) for name in sides]
    )


# --- identity and completeness ------------------------------------------------

def duplicate_ids(df: DataFrame, key: str = "entity_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def blank_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the number of NULL or blank values in each column."""
    return df.agg(*[F.count_if(is_blank(F.col(c).cast("string"))).alias(c) for c in columns])


def entity_violations(entities: DataFrame, columns: Sequence[str] = ("entity_id", "label", "grp")) -> DataFrame:
    """Duplicate IDs and blank fields, as (check, key, n_rows)."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | is_blank(F.col(c).cast("string"))
    return (
        entities.groupBy(F.col("entity_id").cast("string").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_blank"))
        .filter("n > 1 OR n_blank > 0")
        .select(
            F.when(F.col("n_blank") > 0, "blank_field").otherwise("duplicate_id").alias("check"),
            "key", F.col("n").alias("n_rows"),
        )
    )


def exclusion_violations(entities: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Listed IDs that repeat or that no entity has."""
    sides = _tagged(
        {"known": entities.select(F.col("entity_id").cast("string")),
         "listed": exclusions.select(F.col("entity_id").cast("string"))},
        ["entity_id"],
    )
    return sides.filter("listed > 1 OR (listed > 0 AND known = 0)").select(
        F.when(F.col("known") == 0, "unknown_id").otherwise("duplicate_id").alias("check"),
        F.col("entity_id").alias("key"), F.col("listed").alias("n_rows"),
    )


def domain_violations(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Values outside a closed list, and listed values that never occur."""
    seen = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    wanted = df.sparkSession.createDataFrame([(v,) for v in domain], "value string")
    return (
        seen.join(F.broadcast(wanted.withColumn("expected", F.lit(True))), "value", "full_outer")
        .filter("n_rows IS NULL OR expected IS NULL")
        .select("value", F.when(F.col("n_rows").isNull(), "absent").otherwise("unexpected").alias("problem"))
    )


def coverage_gaps(df: DataFrame, row: str, column: str) -> DataFrame:
    """Pairs (row value, column value) that never occur together.

    ``column`` is a class-like vocabulary and its values are listed on the
    driver up to MAX_CLASSES; ``row`` values are unlimited. Each row value
    compares the short set it has with that list, so no product of the two
    sides is formed.
    """
    pairs = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("_n"))
    listed = [r[0] for r in bounded_rows(pairs.select(column).distinct(), MAX_CLASSES, column)]
    every = F.array(*[F.lit(v) for v in sorted(listed)])
    return pairs.groupBy(row).agg(F.collect_set(column).alias("_has")).select(
        row, F.explode(F.array_except(every, F.col("_has"))).alias(column)
    )


def partition_violations(everything: DataFrame, kept: DataFrame, removed: DataFrame,
                         key: str = "entity_id") -> DataFrame:
    """IDs that are not in exactly one of ``kept`` and ``removed``."""
    sides = _tagged({"in_all": everything, "in_kept": kept, "in_removed": removed}, [key])
    return sides.filter("in_all <> 1 OR in_kept + in_removed <> 1")


def membership_diff(expected: DataFrame, actual: DataFrame, key: str = "entity_id") -> DataFrame:
    """IDs of one side only, as (key, side)."""
    sides = _tagged({"expected": expected, "actual": actual}, [key])
    return sides.filter("expected = 0 OR actual = 0").select(
        key, F.when(F.col("actual") == 0, "missing").otherwise("extra").alias("side")
    )


def membership_summary(expected: DataFrame, actual: DataFrame, key: str = "entity_id") -> DataFrame:
    """One row: matched, missing and extra ID counts."""
    return _tagged({"expected": expected, "actual": actual}, [key]).agg(
        F.count_if((F.col("expected") > 0) & (F.col("actual") > 0)).alias("n_matched"),
        F.count_if(F.col("actual") == 0).alias("n_missing"),
        F.count_if(F.col("expected") == 0).alias("n_extra"),
    )


def key_overlap(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key column: distinct values on both sides and on one, and rows whose value the other side has.

    All keys share one pass: a row is opened into its (key, value) pairs, which are
    counted per side before they meet. NULL is a value like any other.
    """
    def opened(df: DataFrame, side: int) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
        return df.select(F.inline(pairs)).withColumn("side", F.lit(side))

    both = opened(expected, 0).unionByName(opened(actual, 1)).groupBy("key", "value").agg(
        F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    shared = (F.col("a") > 0) & (F.col("b") > 0)
    return both.groupBy("key").agg(
        F.count_if(shared).alias("n_shared"), F.count_if(F.col("b") == 0).alias("n_expected_only"), F.count_if(F.col("a") == 0).alias("n_actual_only"),
        F.coalesce(F.sum(F.when(shared, F.col("a"))), F.lit(0)).alias("expected_rows_shared"),
        F.coalesce(F.sum(F.when(shared, F.col("b"))), F.lit(0)).alias("actual_rows_shared"))


def cohort_differences(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("entity_id", "label")) -> DataFrame:
    """Rows (ID, label) whose multiplicity differs between two cohorts."""
    sides = _tagged({"n_left": left, "n_right": right}, list(keys))
    return sides.filter("n_left <> n_right")


def attribute_mismatch(manifest: DataFrame, artifact: DataFrame, columns: Sequence[str],
                       key: str = "entity_id") -> DataFrame:
    """Rows whose attributes disagree with the manifest, one row per column."""
    theirs = artifact.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    entries = F.array(*[
        F.struct(
            F.lit(c).alias("attribute"),
            F.col(c).cast("string").alias("expected"),
            F.col(f"_{c}").cast("string").alias("actual"),
        )
        for c in columns
    ])
    return (
        manifest.select(key, *columns).join(theirs, key)
        .select(key, F.inline(entries))
        .filter(~F.col("expected").eqNullSafe(F.col("actual")))
    )


def count_differences(actual: DataFrame, recorded: DataFrame, key: str, value: str = "n_rows") -> DataFrame:
    """Keys whose actual and recorded totals differ; both sides hold one row per key."""
    both = actual.select(key, F.col(value).alias("actual"), F.lit(None).cast("long").alias("recorded")).unionByName(
        recorded.select(key, F.lit(None).cast("long").alias("actual"), F.col(value).alias("recorded"))
    )
    return (
        both.groupBy(key).agg(F.max("actual").alias("actual"), F.max("recorded").alias("recorded"))
        .filter("NOT (actual <=> recorded)")
    )


# --- values -------------------------------------------------------------------

def vector_violations(df: DataFrame, dim: int | None = None, vec: str = "vec", key: str = "entity_id") -> DataFrame:
    """Vectors that are missing, have a wrong length or a non-finite entry.

    Without ``dim`` the most frequent length is the right one.
    """
    if dim is None:
        dim = df.agg(F.mode(F.when(F.col(vec).isNotNull(), F.size(vec)), True)).first()[0]
    yes = F.lit(True)
    return df.select(
        key,
        F.size(vec).alias("dim"),
        F.coalesce(F.when(F.col(vec).isNotNull(), F.size(vec) != F.lit(dim)), yes).alias("wrong_length"),
        F.coalesce(~V.all_finite(F.col(vec)), yes).alias("not_finite"),
    ).filter("wrong_length OR not_finite")


def is_valid_count(value: Column, tol: float = 1e-6) -> Column:
    x = value.cast("double")
    return is_finite(x) & (x >= 0) & (F.abs(x - F.rint(x)) <= tol)


def count_violations(df: DataFrame, value: str = "cnt") -> DataFrame:
    """Counts that are missing, not finite, negative or not whole."""
    return df.filter(~F.coalesce(is_valid_count(F.col(value)), F.lit(False)))


def empty_entities(entities: DataFrame, counts: DataFrame, key: str = "entity_id", value: str = "cnt") -> DataFrame:
    """Entities whose counts are absent or sum to nothing."""
    totals = counts.groupBy(key).agg(F.sum(value).alias("_total"))
    return entities.join(totals, key, "left").filter("coalesce(_total, 0) <= 0").drop("_total")


def order_differences(left: DataFrame, right: DataFrame, position: str, item: str) -> DataFrame:
    """Positions at which two ordered lists disagree."""
    both = left.select(position, F.col(item).alias("l"), F.lit(None).cast("string").alias("r")).unionByName(
        right.select(position, F.lit(None).cast("string").alias("l"), F.col(item).alias("r"))
    )
    return (
        both.groupBy(position).agg(F.max("l").alias("left_item"), F.max("r").alias("right_item"))
        .filter("NOT (left_item <=> right_item)")
    )


def probability_violations(predictions: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Predictions whose probabilities are missing, not finite or do not add up to one."""
    bad = ~V.all_finite(F.col("probs")) | (F.abs(F.col("mass") - 1.0) > tol)
    return predictions.withColumn("mass", V.total(F.col("probs"))).filter(F.coalesce(bad, F.lit(True)))


def metric_differences(stored: DataFrame, computed: DataFrame, keys: Sequence[str],
                       metrics: Sequence[str], tol: float = 1e-12) -> DataFrame:
    """Metrics whose stored value is not the recomputed one, one row per metric."""
    theirs = computed.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    entries = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("stored"), F.col(f"_{m}").alias("computed"))
        for m in metrics
    ])
    return (
        stored.select(*keys, *metrics).join(theirs, list(keys), "full_outer")
        .select(*keys, F.inline(entries))
        .filter("stored IS NULL OR computed IS NULL OR abs(stored - computed) > " + repr(tol))
    )


def fold_leaks(folds: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Groups standing on both sides of a fold, or held out only in part.

    ``folds``: outer_grp, grp, role ('train' or 'hold'). With ``entities`` (grp) a
    held group must also have all of its rows in the fold.
    """
    sides = folds.groupBy("outer_grp", "grp").agg(
        F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "hold").alias("n_hold")
    )
    wrong = (
        ((F.col("n_train") > 0) & (F.col("n_hold") > 0))
        | ((F.col("outer_grp") == F.col("grp")) & (F.col("n_train") > 0))
        | ((F.col("outer_grp") != F.col("grp")) & (F.col("n_hold") > 0))
    )
    if entities is None:
        return sides.filter(wrong)
    sizes = entities.groupBy("grp").agg(F.count(F.lit(1)).alias("_size"))
    held = folds.select("outer_grp").distinct().join(sizes, F.col("outer_grp") == F.col("grp"))
    both = sides.join(held, ["outer_grp", "grp"], "full").na.fill(0, subset=["n_train", "n_hold"])
    short = (F.col("outer_grp") == F.col("grp")) & ~F.col("n_hold").eqNullSafe(F.col("_size"))
    return both.filter(wrong | short).drop("_size")


def atom_violations(atoms: DataFrame, limit: float = 1.00001) -> DataFrame:
    """Atoms that are missing, not finite or longer than ``limit``."""
    bad = (F.col("norm") > limit) | ~V.all_finite(F.col("weights"))
    return atoms.withColumn("norm", V.norm(F.col("weights"))).filter(F.coalesce(bad, F.lit(True))).select("atom", "norm")


def digest_differences(recorded: DataFrame, actual: DataFrame, key: str = "path") -> DataFrame:
    """Files that are missing, new or changed against recorded digests."""
    both = recorded.select(key, F.col("sha256").alias("recorded"), F.lit(None).cast("string").alias("actual")).unionByName(
        actual.select(key, F.lit(None).cast("string").alias("recorded"), F.col("sha256").alias("actual"))
    )
    return (
        both.groupBy(key).agg(F.max("recorded").alias("recorded"), F.max("actual").alias("actual"))
        .filter("NOT (recorded <=> actual)")
    )
