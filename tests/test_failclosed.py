"""Checks and digests must refuse what they cannot vouch for."""

import pytest
from pyspark.sql import functions as F

from probeloom.operators import checks, metrics
from probeloom.operators.coding import lasso_rows
from probeloom.sources import digests, writers

import numpy as np


def test_missing_values_are_violations(spark):
    vecs = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None), ("c", [1.0]), ("d", [1.0, 3.0])], "entity_id string, vec array<double>")
    assert {r["entity_id"] for r in checks.vector_violations(vecs, 2).collect()} == {"b", "c"}
    assert {r["entity_id"] for r in checks.vector_violations(vecs).collect()} == {"b", "c"}
    probs = spark.createDataFrame([("a", [0.5, 0.5]), ("b", None), ("c", [None, 1.0])], "entity_id string, probs array<double>")
    assert {r["entity_id"] for r in checks.probability_violations(probs).collect()} == {"b", "c"}
    atoms = spark.createDataFrame([(1, [1.0]), (2, None), (3, [2.0])], "atom int, weights array<double>")
    assert {r["atom"] for r in checks.atom_violations(atoms).collect()} == {2, 3}


def test_fields_cannot_flow_into_each_other(spark):
    one = spark.createDataFrame([("a|=b", "c")], "x string, y string")
    two = spark.createDataFrame([("a", "b|=c")], "x string, y string")
    assert digests.checksum(one) != digests.checksum(two)
    assert digests.checksum(one) == digests.checksum(one.select("y", "x"))


def test_held_group_must_be_whole(spark):
    entities = spark.createDataFrame([("g",)] * 3 + [("h",)] * 2, "grp string")
    rows = [("g", "g", "hold")] * 3 + [("g", "h", "train")] * 2 + [("h", "h", "hold"), ("h", "g", "train")]
    folds = spark.createDataFrame(rows, "outer_grp string, grp string, role string")
    assert [r["outer_grp"] for r in checks.fold_leaks(folds, entities).collect()] == ["h"]
    assert checks.fold_leaks(folds).count() == 0


def test_a_fold_is_written_once(spark, folder):
    fold = spark.createDataFrame([("g", 1.0)], "outer_grp string, f double")
    writers.append_fold(fold, f"{folder}/folds")
    writers.append_fold(fold.withColumn("outer_grp", F.lit("h")), f"{folder}/folds")
    with pytest.raises(FileExistsError):
        writers.append_fold(fold, f"{folder}/folds")
    assert spark.read.parquet(f"{folder}/folds").count() == 2


def test_classes_without_true_rows_stay(spark):
    rows = [("a", "a", [0.8, 0.1, 0.1]), ("a", "c", [0.2, 0.1, 0.7]), ("b", "b", [0.1, 0.8, 0.1])]
    table = metrics.confusion(spark.createDataFrame(rows, "label string, prediction string, probs array<double>"), "abc")
    matrix = {r["label"]: (r["a"], r["b"], r["c"]) for r in metrics.confusion_matrix(table, "abc").collect()}
    assert matrix == {"a": (1, 0, 1), "b": (0, 1, 0), "c": (0, 0, 0)}
    report = {r["label"]: r for r in metrics.report(table, labels="abc").collect()}
    assert report["c"]["f1_score"] == 0.0 and report["c"]["support"] == 0
    assert report["macro avg"]["f1_score"] == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert metrics.scalar_metrics(table, classes="abcd").first()["macro_f1"] == pytest.approx((2 / 3 + 1) / 4)
    with pytest.raises(ValueError):
        metrics.confusion_matrix(table, "ab")


def test_codes_that_do_not_settle_are_an_error():
    d = np.array([[1.0, 0.0], [0.999, 0.0447]])
    with pytest.raises(ArithmeticError):
        lasso_rows(np.array([[3.0, 5.0]]), d, 0.01, max_sweeps=2)
