"""Joins of features with an ordered panel, and of vectors with a reference list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.operators.checks import CheckFailed
from probeloom.operators.ranking import rank_rows


def feature_positions(feature_ids: DataFrame) -> DataFrame:
    """feature_id, feature_pos: zero-based rank of each distinct feature name."""
    return rank_rows(feature_ids.select("feature_id").distinct(), ["feature_id"], "feature_pos")


def map_panel(panel: DataFrame, features: DataFrame, source: str) -> DataFrame:
    """Every panel row with a presence flag and the matching position, else -1.

    The panel is short next to the vocabulary, so the vocabulary is cut down to
    panel names first (the semi join broadcasts the panel when it is small) and
    only the hits take part in the outer join.
    """
    hits = features.select(F.col("feature_id").alias("feature_name"), "feature_pos").join(
        panel.select("feature_name"), "feature_name", "left_semi"
    )
    return panel.join(hits, "feature_name", "left").select(
        "panel_pos", "panel_id", "feature_name",
        F.col("feature_pos").isNotNull().alias("present"),
        F.coalesce("feature_pos", F.lit(-1)).cast("long").alias("feature_index"),
        F.lit(source).alias("mapping_source"),
    )


def panel_coverage(mapping: DataFrame) -> DataFrame:
    return mapping.agg(
        F.count(F.lit(1)).alias("n_panel"),
        F.count_if("present").alias("n_matched"),
        F.count_if(~F.col("present")).alias("n_missing"),
        (F.avg(F.col("present").cast("double")) * 100.0).alias("coverage_percent"),
    )


def restrict_panel(mapping: DataFrame) -> DataFrame:
    """Matched panel rows, renumbered without gaps in panel order."""
    return rank_rows(
        mapping.filter("present").select("panel_pos", "feature_name", "feature_index"),
        ["panel_pos"], "out_pos",
    )


def align_vectors(reference: DataFrame, vectors: DataFrame, vec: str = "vec", strict: bool = True) -> DataFrame:
    """Reference rows with their vectors; a reference ID without one is an error."""
    theirs = vectors.select("entity_id", vec)
    aligned = reference.join(theirs, "entity_id", "left")
    if strict:
        missing = reference.join(theirs, "entity_id", "left_anti")
        n = missing.count()
        if n:
            shown = [r[0] for r in missing.select("entity_id").orderBy("entity_id").limit(5).collect()]
            raise CheckFailed(f"missing {n} reference entities, for example {shown}")
    return aligned
