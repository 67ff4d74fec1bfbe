"""Results stay exact and work stays spread when one key holds much of the data."""

import hashlib

import pytest
from pyspark.sql import functions as F

from probeloom.operators import checks, split
from probeloom.operators.ranking import rank_rows

N = 30_000


@pytest.fixture(scope="module")
def entities(spark):
    """Half of the rows carry one label, the rest spread over 20."""
    return spark.range(N).select(
        F.concat(F.lit("e"), F.col("id")).alias("entity_id"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 20)).alias("label"),
        F.lit("g").alias("grp"),
    )


def expected(rows):
    by_label = {}
    for r in rows:
        by_label.setdefault(r["label"], []).append(r["entity_id"])
    out = {}
    for ids in by_label.values():
        ids.sort(key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
        n = len(ids)
        sizes = [n * p // 100 for p in (70, 15, 15)]
        for _, i in sorted((-(n * p % 100), i) for i, p in enumerate((70, 15, 15)))[:n - sum(sizes)]:
            sizes[i] += 1
        for k, i in enumerate(ids):
            out[i] = "train" if k < sizes[0] else "validation" if k < sizes[0] + sizes[1] else "test"
    return out


@pytest.mark.parametrize("per_bucket", [1_000_000, 2_000, 100])
def test_hot_label_split_is_exact(entities, per_bucket):
    result = split.stratified_split(entities, validate=False, per_bucket=per_bucket)
    assert {r["entity_id"]: r["split"] for r in result.manifest.collect()} == expected(entities.collect())


def test_hot_value_is_ranked_across_tasks(spark, entities):
    ranked = rank_rows(entities.repartition(8).select("label", "entity_id"), ["label", "entity_id"], "rank")
    order = sorted((r["label"], r["entity_id"]) for r in entities.collect())
    assert [(r["label"], r["entity_id"]) for r in ranked.orderBy("rank").collect()] == order
    assert [r["rank"] for r in ranked.select("rank").orderBy("rank").collect()] == list(range(N))


def test_hot_key_checks_do_not_explode(spark):
    left = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("entity_id"))
    right = left.limit(39_999)
    assert checks.membership_diff(left, left).isEmpty()
    diff = checks.cohort_differences(left, right, ("entity_id",)).collect()
    assert len(diff) == 1
    assert checks.duplicate_ids(left).collect()[0]["n_rows"] == 13_334
