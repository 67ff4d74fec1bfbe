"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Groups that hold at least this share of the rows are joined by broadcast. At
# most 1 / HOT_SHARE such groups can exist, which bounds what is broadcast.
HOT_SHARE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def same(a, b):
    return a.eqNullSafe(b)


def attach_group_facts(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one ``groups`` row per key, safe for hot keys.

    Groups with at least HOT_SHARE of all rows (no more than 1 / HOT_SHARE of
    them) are broadcast, so their rows stay where they are. The rest is joined by
    shuffle; there no key has more rows than HOT_SHARE of the total.
    """
    least = max(2, int(total * HOT_SHARE))
    hot = groups.filter(F.col(size) >= least)
    cold = groups.filter(F.col(size) < least)
    there = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return there.unionByName(rest)
