"""Coordinate export to named count tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probeloom.operators import checks
from probeloom.operators.checks import CheckFailed, assert_empty
from probeloom.session import materialize, settle
from probeloom.sources.readers import read_text_table, stored_coordinates
from probeloom.sources.writers import refuse_existing, write_report, write_table


def read_ordered(spark: SparkSession, path: str, columns: Sequence[str], out: str = "pos", sep: str = ",") -> DataFrame:
    """``columns`` of a text table (header, one file or many in path order) with the 0-based place of each line.

    Files are read in parallel splits. A row's place is its place in its split plus the
    rows of all splits before, one number per split; rows are never sorted.
    """
    rows = read_text_table(spark, path, columns, sep, with_place=True)
    stored = materialize(rows, "ordered")
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = settle(
        stored.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
        .select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return stored.join(splits, ["_file", "_block"]).select(
        (F.col("_offset") + F.col("_row") - F.col("_first")).alias(out), *columns)


def convert_counts(spark: SparkSession, matrix: str, features: str, entities: str, path: str,
                   feature_column: str = "feature_id", entity_columns: Sequence[str] = ("entity_id", "label", "grp")) -> dict:
    """Feature x entity coordinate text and two name tables to counts, features and entities in a new folder.

    Names belong to the positions of the matrix by their order of lines. Refused are other
    numbers of names than the size line says, repeated or blank names, blank labels or groups,
    coordinates that occur twice, and counts that are not finite, whole and at least 0.
    What was written is read back and compared.
    """
    refuse_existing(spark, path)
    entries, (n_features, n_entities, n_entries) = stored_coordinates(spark, matrix)
    named = {"features": read_ordered(spark, features, [feature_column], "feature_pos").withColumnRenamed(feature_column, "feature_id"),
             "entities": read_ordered(spark, entities, list(entity_columns), "entity_pos").toDF("entity_pos", "entity_id", "label", "grp")}
    for name, wanted in (("features", n_features), ("entities", n_entities)):
        found = named[name].count()
        if found != wanted:
            raise CheckFailed(f"{name}: {found} names for {wanted} positions of the matrix")
    assert_empty(checks.entity_violations(named["features"].withColumnRenamed("feature_id", "entity_id"), ["entity_id"]), "feature names")
    assert_empty(checks.entity_violations(named["entities"]), "entities")
    repeated = entries.groupBy("feature_pos", "entity_pos").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
    assert_empty(repeated, "coordinates that occur twice")
    assert_empty(checks.count_violations(entries), "counts must be finite, whole and not negative")
    joined = entries.join(named["features"], "feature_pos").join(named["entities"].select("entity_pos", "entity_id"), "entity_pos")
    counts = write_table(joined.select("entity_id", "feature_id", "feature_pos", F.round("cnt").cast("long").alias("cnt")), f"{path}/counts")
    stored = {name: write_table(df, f"{path}/{name}", verify=True) for name, df in named.items()}
    kept = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("total")).first()
    total = entries.agg(F.sum(F.round("cnt").cast("long"))).first()[0]
    if kept["n"] != n_entries or kept["total"] != total:
        raise CheckFailed(f"{path}: {kept['n']} stored entries with total {kept['total']}, the export has {n_entries} with {total}")
    return write_report(spark, dict(n_features=stored["features"].count(), n_entities=stored["entities"].count(), n_entries=n_entries,
                                    total=int(total or 0)), f"{path}/report")
