import pytest
from pyspark.sql import functions as F

from probeloom.functions.scalars import merged_object, text_of
from probeloom.operators import checks


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_entity_violations(spark):
    df = spark.createDataFrame(
        [("a", "x", "g"), ("a", "x", "g"), ("b", " ", "g"), ("c", None, "g"), ("d", "x", "g")],
        "entity_id string, label string, grp string")
    assert ids(checks.entity_violations(df), "check", "key", "n_rows") == [
        ("blank_field", "b", 1), ("blank_field", "c", 1), ("duplicate_id", "a", 2)]
    assert checks.blank_counts(df, ["label", "grp"]).first().asDict() == {"label": 2, "grp": 0}
    with pytest.raises(checks.CheckFailed):
        checks.assert_empty(checks.duplicate_ids(df), "ids")


def test_domain_and_coverage(spark):
    df = spark.createDataFrame([("x", "train"), ("x", "test"), ("y", "train"), ("y", "other")], "label string, split string")
    assert ids(checks.domain_violations(df, "split", ["train", "validation", "test"]), "value", "problem") == [
        ("other", "unexpected"), ("validation", "absent")]
    assert ids(checks.coverage_gaps(df, "label", "split"), "label", "split") == [("x", "other"), ("y", "test")]


def test_partition_and_membership(spark):
    def make(*values):
        return spark.createDataFrame([(v,) for v in values], "entity_id string")
    bad = checks.partition_violations(make("a", "b", "c", "d"), make("a", "b"), make("b", "c", "e"))
    assert ids(bad, "entity_id") == [("b",), ("d",), ("e",)]
    assert ids(checks.membership_diff(make("a", "b"), make("b", "c")), "entity_id", "side") == [("a", "missing"), ("c", "extra")]
    assert checks.membership_summary(make("a", "b"), make("b", "c")).first().asDict() == {
        "n_matched": 1, "n_missing": 1, "n_extra": 1}


def test_repeated_keys_do_not_multiply(spark):
    left = spark.createDataFrame([("a", "x")] * 500, "entity_id string, label string")
    right = spark.createDataFrame([("a", "x")] * 499, "entity_id string, label string")
    assert ids(checks.cohort_differences(left, right), "entity_id", "n_left", "n_right") == [("a", 500, 499)]


def test_attribute_mismatch_is_null_safe(spark):
    left = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "entity_id string, label string")
    right = spark.createDataFrame([("a", "x"), ("b", None), ("c", None)], "entity_id string, label string")
    assert ids(checks.attribute_mismatch(left, right, ["label"]), "entity_id", "expected") == [("b", "y")]


def test_value_checks(spark):
    nan, inf = float("nan"), float("inf")
    counts = spark.createDataFrame([(1.0,), (2.0000001,), (1.5,), (-1.0,), (nan,), (inf,), (None,)], "cnt double")
    assert checks.count_violations(counts).count() == 5
    vecs = spark.createDataFrame(
        [("a", [1.0, 2.0]), ("b", [1.0]), ("c", [nan, 1.0]), ("d", [1.0, None]), ("e", [inf, 0.0])],
        "entity_id string, vec array<double>")
    assert ids(checks.vector_violations(vecs, 2), "entity_id") == [("b",), ("c",), ("d",), ("e",)]
    probs = spark.createDataFrame([([0.5, 0.5],), ([0.6, 0.5],)], "probs array<double>")
    assert checks.probability_violations(probs).count() == 1
    atoms = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "atom int, weights array<double>")
    assert ids(checks.atom_violations(atoms), "atom") == [(2,)]


def test_empty_entities(spark):
    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    counts = spark.createDataFrame([("a", 1), ("b", 0)], "entity_id string, cnt int")
    assert ids(checks.empty_entities(entities, counts), "entity_id") == [("b",), ("c",)]


def test_order_metric_and_digest_differences(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "pos int, item string")
    b = spark.createDataFrame([(0, "x"), (1, "z"), (2, "w")], "pos int, item string")
    assert ids(checks.order_differences(a, b, "pos", "item"), "pos") == [(1,), (2,)]
    m = spark.createDataFrame([("k", 0.5, 0.1), ("l", 0.5, 0.1)], "key string, f double, g double")
    n = m.withColumn("g", F.when(F.col("key") == "l", 0.2).otherwise(F.col("g")))
    assert ids(checks.metric_differences(m, n, ["key"], ["f", "g"]), "key", "metric") == [("l", "g")]
    d1 = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, sha256 string")
    d2 = spark.createDataFrame([("p", "1"), ("r", "3")], "path string, sha256 string")
    assert ids(checks.digest_differences(d1, d2), "path") == [("q",), ("r",)]


def test_fold_leaks(spark):
    df = spark.createDataFrame(
        [("a", "a", "hold"), ("a", "b", "train"), ("b", "a", "train"), ("b", "b", "hold"), ("b", "b", "train")],
        "outer_grp string, grp string, role string")
    assert ids(checks.fold_leaks(df), "outer_grp", "grp") == [("b", "b")]


def test_overlap_of_several_keys(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "x", "p"), (3, "y", "p")], "i int, s string, t string")
    b = spark.createDataFrame([(3, "x", None), (4, "z", None)], "i int, s string, t string")
    got = {r["key"]: tuple(r)[1:] for r in checks.key_overlap(a, b, ["i", "s", "t"]).collect()}
    assert got == {"i": (1, 2, 1, 1, 1), "s": (1, 1, 1, 2, 1), "t": (1, 1, 0, 1, 2)}
    plan = checks.key_overlap(a, b, ["i", "s", "t"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_merged_objects_and_bytes(spark):
    rows = [('{"a":1,"b":{"c":[1,2]},"t":"x\\"y"}', '{"b":null,"a":2.5}'), (None, '{"z":"é","a":true}'), ('{}', None), ('[1]', '{"q":1}')]
    df = spark.createDataFrame(rows, "a string, b string").select(merged_object(F.col("a"), F.col("b")).alias("m"))
    assert [r["m"] for r in df.collect()] == ['{"a":2.5,"b":null,"t":"x\\"y"}', '{"a":true,"z":"é"}', "{}", '{"q":1}']
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xff"),), (None,)], "b binary").select(text_of(F.col("b")).alias("t"))
    assert [r["t"] for r in raw.collect()] == ["é", None, None]
