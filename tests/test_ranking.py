import numpy as np
import pytest
from pyspark.sql import functions as F

from probeloom.operators.ranking import bucket_digits, exact_quantile, rank_rows, values_at


def test_rank_rows_numbers_a_hot_value(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 101).alias("v"))
    got = rank_rows(df.repartition(6), ["v", "id"], "rank").collect()
    want = {r["id"]: i for i, r in enumerate(sorted(df.collect(), key=lambda r: (r["v"], r["id"])))}
    assert {r["id"]: r["rank"] for r in got} == want


def test_rank_rows_uses_no_single_partition_window(spark):
    plan = rank_rows(spark.range(100).toDF("v"), ["v"], "r")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_bucket_digits():
    assert bucket_digits(10, 100) == 1
    assert bucket_digits(1600, 100) == 1
    assert bucket_digits(1601, 100) == 2


CASES = {
    "mixed": np.concatenate([np.zeros(700), np.random.default_rng(1).normal(size=1300), np.full(400, 0.5)]),
    "constant": np.full(900, -3.25),
    "two": np.concatenate([np.full(999, 1.0), [np.nextafter(1.0, 2.0)]]),
    "wide": np.random.default_rng(2).normal(size=801) * 10.0 ** np.random.default_rng(3).integers(-300, 300, 801),
    "signed zeros": np.array([-0.0, 0.0, -1e-320, 1e-320, -0.0]),
    "infinite": np.array([-np.inf, -1.0, 2.0, np.inf, np.inf]),
    "one": np.array([7.0]),
}


@pytest.mark.parametrize("name", CASES)
def test_exact_quantile(spark, name):
    values = CASES[name]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(4)
    for q in (0.0, 0.25, 0.5, 0.95, 1.0):
        want = np.sort(values)[[int(np.floor((len(values) - 1) * q)), int(np.ceil((len(values) - 1) * q))]]
        h = (len(values) - 1) * q
        want = want[0] if want[0] == want[1] else want[0] + (want[1] - want[0]) * (h - np.floor(h))
        assert exact_quantile(df, "v", q) == want


def test_nan_is_the_largest_value(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "v double")
    assert exact_quantile(df, "v", 0.0) == 1.0 and np.isnan(exact_quantile(df, "v", 1.0))


def test_radix_selection_needs_no_sort(spark):
    """Four counting scans and the row count; no exchange carries rows."""
    tracker = spark.sparkContext.statusTracker()
    df = spark.createDataFrame([(float(i % 13),) for i in range(5000)], "v double").repartition(4).cache()
    df.count()
    spark.sparkContext.setJobGroup("radix", "")
    assert values_at(df, "v", [0, 2500, 4999]) == [0.0, 6.0, 12.0]
    spark.sparkContext.setJobGroup("rest", "")
    assert len(tracker.getJobIdsForGroup("radix")) <= 12


def test_exact_quantile_of_nothing(spark):
    assert exact_quantile(spark.createDataFrame([], "v double"), "v", 0.5) is None
