"""Stale stages, and chains of provenance with their first broken link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.operators.checks import assert_empty
from probeloom.session import materialize

MAX_DEPTH = 1000


def changed_stages(stage_files: DataFrame, current: DataFrame) -> DataFrame:
    """stage, n_changed: stages with a recorded file that is gone or differs.

    ``stage_files``: stage, path, sha256. ``current``: path, sha256.
    """
    now = current.select("path", F.col("sha256").alias("actual"))
    differing = stage_files.join(now, "path", "left").filter("NOT (sha256 <=> actual)")
    return differing.groupBy("stage").agg(F.count(F.lit(1)).alias("n_changed"))


def stale_stages(changed: DataFrame, needs: DataFrame) -> DataFrame:
    """stage, depth: changed stages (0) and everything built on them.

    ``needs``: stage, required. Each round joins only the stages found last and
    keeps the newly reached ones, so cycles end and no path is walked twice.
    """
    reached = materialize(changed.select("stage", F.lit(0).alias("depth")).distinct(), "stale")
    frontier = reached
    for depth in range(1, MAX_DEPTH):
        following = (
            needs.join(frontier.select(F.col("stage").alias("required")), "required").select("stage").distinct()
            .join(reached.select("stage"), "stage", "left_anti").select("stage", F.lit(depth).alias("depth"))
        )
        frontier = materialize(following, "stale")
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
    raise ValueError(f"dependencies deeper than {MAX_DEPTH}")


def broken_links(links: DataFrame, current: DataFrame) -> DataFrame:
    """child, parent, broken: one row per link; it is broken if any record of it differs from what is there now.

    ``links``: child, parent, sha256 (of the parent when the child was made).
    ``current``: path, sha256. A parent that is gone, or was recorded without a digest, breaks the link.
    """
    now = current.select(F.col("path").alias("parent"), F.col("sha256").alias("actual"))
    same = F.coalesce(F.col("sha256") == F.col("actual"), F.lit(False))
    return links.filter("child IS NOT NULL AND parent IS NOT NULL").join(now, "parent", "left").groupBy("child", "parent").agg(
        F.bool_or(~same).alias("broken")
    )


def provenance(links: DataFrame, current: DataFrame) -> DataFrame:
    """artifact, ancestor, depth, path, first_broken, status: a row for each artifact and each of its ancestors.

    ``path`` is the shortest chain from the artifact to the ancestor (of equal ones the least, name by
    name), ``first_broken`` the first link on it, from the artifact, that no longer holds.
    ``status`` is ``cycle`` where an artifact is its own ancestor, else ``broken`` or ``whole``.
    Only pairs found last are walked on, so a cycle ends and each pair is reached once.
    """
    edges = materialize(broken_links(links, current), "provenance-links")
    steps = edges.select(F.col("child").alias("node"), F.col("parent").alias("next"), F.col("broken").alias("cut"))
    arrow = F.concat("node", F.lit(" <- "), "next")
    frontier = edges.select(F.col("child").alias("artifact")).distinct().select(
        "artifact", F.col("artifact").alias("node"), F.array("artifact").alias("path"), F.lit(None).cast("string").alias("first_broken")
    )
    reached = None
    for depth in range(1, MAX_DEPTH):
        onward = frontier.join(steps, "node").select(
            "artifact", F.col("next").alias("ancestor"), F.concat("path", F.array("next")).alias("path"),
            F.coalesce("first_broken", F.when(F.col("cut"), arrow)).alias("first_broken"),
        )
        found = onward.groupBy("artifact", "ancestor").agg(F.min(F.struct("path", "first_broken")).alias("least"))
        if reached is not None:
            found = found.join(reached.select("artifact", "ancestor"), ["artifact", "ancestor"], "left_anti")
        found = materialize(found.select("artifact", "ancestor", F.lit(depth).alias("depth"), "least.path", "least.first_broken"), "provenance")
        if found.isEmpty():
            break
        reached = found if reached is None else reached.unionByName(found)
        frontier = found.filter("artifact <> ancestor").select("artifact", F.col("ancestor").alias("node"), "path", "first_broken")
    else:
        raise ValueError(f"chains longer than {MAX_DEPTH}")
    reached = found if reached is None else reached
    status = F.when(F.col("artifact") == F.col("ancestor"), "cycle").when(F.col("first_broken").isNotNull(), "broken").otherwise("whole")
    return reached.withColumn("status", status)


def check_provenance(links: DataFrame, current: DataFrame) -> DataFrame:
    """The chains of :func:`provenance`; CheckFailed names those with a broken link or a cycle."""
    found = provenance(links, current)
    assert_empty(found.filter("status <> 'whole'").select("artifact", "status", F.coalesce("first_broken", F.array_join("path", " <- ")).alias("link")).distinct(),
                 "provenance does not hold")
    return found
