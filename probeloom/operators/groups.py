"""Leave-one-group-out folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.session import bounded_rows

MAX_GROUPS = 10_000
MINIMUM_GROUPS = 4


def group_sizes(entities: DataFrame) -> dict[str, int]:
    """Entities per group, sorted by group; folds exist once per group."""
    rows = bounded_rows(entities.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), MAX_GROUPS, "groups")
    return {r["grp"]: r["n"] for r in sorted(rows, key=lambda r: r["grp"])}


def group_folds(entities: DataFrame, minimum: int = MINIMUM_GROUPS) -> DataFrame:
    """entity rows once per outer group, with role 'hold' or 'train'."""
    groups = list(group_sizes(entities))
    if len(groups) < minimum:
        raise ValueError(f"{len(groups)} groups cannot be nested; {minimum} is the least")
    outer = F.explode(F.array(*[F.lit(g) for g in groups])).alias("outer_grp")
    return entities.select(outer, "*").withColumn(
        "role", F.when(F.col("grp") == F.col("outer_grp"), "hold").otherwise("train")
    )


def nested_folds(groups: list[str]) -> list[tuple[str, str | None]]:
    """(outer, inner) pairs followed by (outer, None) for each outer group."""
    return [(o, i) for o in groups for i in [*[g for g in groups if g != o], None]]
