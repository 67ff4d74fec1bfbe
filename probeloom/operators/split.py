"""Stratified train / validation / test split with rare-label exclusion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeloom.functions.scalars import (
    MINIMUM_LABEL_ROWS, SPLIT_PERCENTS, SPLITS, order_key,
)
from probeloom.operators import checks
from probeloom.operators.ranking import ROWS_PER_BUCKET, cut_keys
from probeloom.session import settle

LISTED = "listed"
RARE = "label_below_minimum"


@dataclass(frozen=True)
class Split:
    manifest: DataFrame        # entity_id, label, grp, split
    excluded: DataFrame        # entity_id, label, grp, reason
    split_counts: DataFrame    # label, train, validation, test, total
    label_counts: DataFrame    # label, original, after_listed, retained
    train_rows: int
    bounds: DataFrame          # label and its cut keys; one row per retained label
    seed: int
    names: Sequence[str]

    def assign(self, rows: DataFrame) -> DataFrame:
        """Add ``split`` to any rows with entity_id and label.

        A lookup of a few keys per label and a comparison; rows are not
        shuffled. Rows of excluded labels drop out.
        """
        return _assign(rows, self.bounds, self.seed, self.names)


def apportion(n: Column, percents: Sequence[int] = SPLIT_PERCENTS) -> Column:
    """Largest-remainder sizes of ``n`` over integer percents; ties go left.

    Sizes come from integer products, so rounding cannot move a row between splits.
    """
    floors = [F.floor(n * F.lit(p) / F.lit(100)) for p in percents]
    spare = n
    for f in floors:
        spare = spare - f
    by_remainder = F.array_sort(
        F.array(*[
            F.struct((-F.pmod(n * F.lit(p), F.lit(100))).alias("rem"), F.lit(i).alias("pos"))
            for i, p in enumerate(percents)
        ])
    )
    lucky = F.transform(F.slice(by_remainder, F.lit(1), spare.cast("int")), lambda s: s["pos"])
    return F.array(*[
        (f + F.array_contains(lucky, i).cast("long")) for i, f in enumerate(floors)
    ])


def stage_counts(flagged: DataFrame, minimum: int) -> DataFrame:
    """label, original, after_listed, retained from one aggregate."""
    after = F.count_if(~F.col("listed"))
    return flagged.groupBy("label").agg(
        F.count(F.lit(1)).alias("original"),
        after.alias("after_listed"),
        F.when(after >= minimum, after).otherwise(F.lit(0)).cast("long").alias("retained"),
    )


def flag_listed(entities: DataFrame, exclusions: DataFrame | None) -> DataFrame:
    """Add ``listed``: the entity is on the supplied exclusion list."""
    if exclusions is None:
        return entities.withColumn("listed", F.lit(False))
    ids = exclusions.select(F.col("entity_id").cast("string")).distinct().withColumn("_hit", F.lit(True))
    return entities.join(ids, "entity_id", "left").withColumn(
        "listed", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def stratified_split(
    entities: DataFrame,
    exclusions: DataFrame | None = None,
    seed: int = 42,
    minimum: int = MINIMUM_LABEL_ROWS,
    percents: Sequence[int] = SPLIT_PERCENTS,
    validate: bool = True,
    per_bucket: int = ROWS_PER_BUCKET,
) -> Split:
    """Deterministic split within each label.

    Rows are ordered inside their label by md5(seed:id), so the result does not
    depend on input order or partitioning. The rows standing at the cumulative
    split sizes are found first (a few per label); assigning a split is then a
    comparison with those keys. Entities are scanned, never shuffled by label.
    """
    if validate:
        checks.assert_empty(checks.entity_violations(entities), "entity metadata")
        if exclusions is not None:
            checks.assert_empty(checks.exclusion_violations(entities, exclusions), "exclusion list")
    flagged = flag_listed(
        entities.select(*[F.col(c).cast("string") for c in ("entity_id", "label", "grp")]), exclusions
    )
    counts = settle(stage_counts(flagged, minimum))
    sizes = counts.filter("retained > 0").select(
        "label", F.col("retained").alias("total"), apportion(F.col("retained"), percents).alias("sizes")
    )
    n_rows, train_rows, smallest = sizes.agg(
        F.sum("total"), F.sum(F.col("sizes")[0]), F.min(F.array_min("sizes"))
    ).first()
    if not n_rows:
        raise ValueError("the exclusions leave nothing to split")
    if validate and smallest == 0:
        raise ValueError("a label is too rare to reach all of the splits")
    running, steps = F.lit(0).cast("long"), []
    for i in range(len(percents) - 1):
        running = running + F.col("sizes")[i]
        steps.append(running.alias(f"r{i}"))
    cuts = sizes.select(
        "label", F.posexplode(F.array(*steps)).alias("cut", "rank")
    ).filter("rank > 0")

    kept = flagged.filter(~F.col("listed")).join(sizes.select("label"), "label", "left_semi")
    keyed = kept.select("label", order_key(seed, F.col("entity_id")).alias("order_key"), "entity_id")
    keys = cut_keys(keyed, cuts, n_rows, per_bucket)
    bounds = settle(
        keys.groupBy("label").agg(*[
            F.max(F.when(F.col("cut") == i, F.struct("cut_key", "cut_id"))).alias(f"upto{i}")
            for i in range(len(percents) - 1)
        ])
    )
    names = SPLITS if len(percents) == 3 else tuple(f"part{i}" for i in range(len(percents)))
    manifest = _assign(flagged.filter(~F.col("listed")), bounds, seed, names).select(
        "entity_id", "label", "grp", "split"
    )
    excluded = (
        flagged.join(counts.filter("retained = 0").select("label", F.lit(True).alias("rare")), "label", "left")
        .filter(F.col("listed") | F.col("rare"))
        .select(
            "entity_id", "label", "grp",
            F.when(F.col("listed"), F.lit(LISTED)).otherwise(F.lit(RARE)).alias("reason"),
        )
    )
    split_counts = sizes.select(
        "label", *[F.col("sizes")[i].alias(n) for i, n in enumerate(names)], "total"
    )
    return Split(manifest, excluded, split_counts, counts.orderBy("label"), train_rows, bounds, seed, names)


def _assign(rows: DataFrame, bounds: DataFrame, seed: int, names: Sequence[str]) -> DataFrame:
    here = F.struct(
        order_key(seed, F.col("entity_id")).alias("cut_key"), F.col("entity_id").alias("cut_id")
    )
    assigned = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        inside = F.coalesce(here <= F.col(f"upto{i}"), F.lit(False))
        assigned = F.when(inside, F.lit(names[i])).otherwise(assigned)
    drop = [f"upto{i}" for i in range(len(names) - 1)]
    return rows.join(bounds, "label").withColumn("split", assigned).drop(*drop)


def nested_samples(entities: DataFrame, sizes: Sequence[int], seed: int = 42,
                   per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Seeded samples in which each smaller sample is a prefix of the larger.

    Returns entity_id and ``smallest``: the least listed size whose sample holds
    the row. Rows beyond the largest size are left out.
    """
    ordered = sorted(set(sizes))
    spark = entities.sparkSession
    keyed = entities.select(
        F.lit("all").alias("label"),
        order_key(seed, F.col("entity_id")).alias("order_key"),
        F.col("entity_id").cast("string").alias("entity_id"),
    )
    n_rows = entities.count()
    cuts = spark.createDataFrame(
        [("all", i, min(s, n_rows)) for i, s in enumerate(ordered)], "label string, cut int, rank long"
    )
    keys = {r["cut"]: r for r in cut_keys(keyed, F.broadcast(cuts), n_rows, per_bucket).collect()}
    smallest = F.lit(None).cast("long")
    for i in reversed(range(len(ordered))):
        k = keys[i]
        inside = (F.col("order_key") < k["cut_key"]) | (
            (F.col("order_key") == k["cut_key"]) & (F.col("entity_id") <= k["cut_id"])
        )
        smallest = F.when(inside, F.lit(ordered[i]).cast("long")).otherwise(smallest)
    return keyed.select("entity_id", smallest.alias("smallest")).filter("smallest IS NOT NULL")
