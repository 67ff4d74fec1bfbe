import numpy as np
import pytest
from pyspark.sql import functions as F

from probeloom.functions.scalars import round_floats
from probeloom.operators import features, groups
from probeloom.operators.checks import CheckFailed
from probeloom.operators.panels import align_vectors, map_panel, panel_coverage, restrict_panel

N, P = 40, 12


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(0)
    x = rng.poisson(0.8, size=(N, P))
    x[:, 0] += 1          # every entity has counts
    x[:, 5] = x[:, 4]     # equal variance only if totals agree; see ties below
    x[:, 7] = 0           # never seen
    return x


@pytest.fixture(scope="module")
def counts(spark, matrix):
    rows = [(f"e{i:02d}", f"f{j:02d}", int(matrix[i, j])) for i in range(N) for j in range(P) if matrix[i, j]]
    return spark.createDataFrame(rows, "entity_id string, feature_id string, cnt long")


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame([(f"e{i:02d}", "x", str(i % 4)) for i in range(N)],
                                 "entity_id string, label string, grp string")


def dense_log(matrix):
    return np.log1p(matrix * 1e4 / matrix.sum(axis=1, keepdims=True))


def test_fit_and_transform_match_dense_arithmetic(spark, counts, entities, matrix):
    logs = dense_log(matrix)
    train = logs[:30]
    log_counts = features.normalize_log(counts)
    log_train = log_counts.filter("entity_id < 'e30'")
    fitted = features.settle_fitted(features.fit_features(log_train, 30, 6), 6)
    variance = (train ** 2).mean(axis=0) - train.mean(axis=0) ** 2
    order = sorted((j for j in range(P) if variance[j] > 1e-12), key=lambda j: (-round(variance[j], 12), j))[:6]
    chosen = sorted(order)
    rows = sorted(fitted.collect(), key=lambda r: r["out_pos"])
    assert [r["feature_id"] for r in rows] == [f"f{j:02d}" for j in chosen]
    np.testing.assert_allclose([r["mean"] for r in rows], train.mean(axis=0)[chosen], atol=1e-12)
    np.testing.assert_allclose([r["scale"] for r in rows], train.std(axis=0)[chosen], atol=1e-9)
    vectors = features.transform_vectors(log_counts, entities, fitted, 6)
    got = np.array([r["vec"] for r in vectors.orderBy("entity_id").collect()])
    want = ((logs[:, chosen] - train.mean(axis=0)[chosen]) / train.std(axis=0)[chosen]).astype(np.float32)
    np.testing.assert_allclose(got, want, atol=2e-6)


def test_equal_variances_go_to_the_lower_position(spark):
    stats = spark.createDataFrame(
        [("c", 0.0, 1.0), ("a", 0.0, 1.0 + 1e-15), ("b", 0.0, 1.0), ("z", 0.0, 0.0), ("d", 0.0, 2.0)],
        "feature_id string, mean double, variance double")
    got = features.select_features(stats, 3).orderBy("out_pos").collect()
    assert [r["feature_id"] for r in got] == ["a", "b", "d"]


def test_panel_keeps_constant_features(spark, counts, entities):
    panel = spark.createDataFrame([("f07", 0), ("f00", 1), ("zz", 2)], "feature_id string, out_pos int")
    log_counts = features.normalize_log(counts)
    fitted = features.fit_panel(log_counts, N, panel)
    rows = {r["feature_id"]: r for r in fitted.collect()}
    assert rows["f07"]["scale"] == 1.0 and rows["zz"]["mean"] == 0.0 and len(rows) == 3
    vectors = features.transform_vectors(log_counts, entities, fitted, 3)
    assert all(r["vec"][0] == 0.0 and r["vec"][2] == 0.0 for r in vectors.collect())


def test_entities_without_selected_features_stay(spark, entities, counts):
    log_counts = features.normalize_log(counts)
    fitted = spark.createDataFrame([("nothing", 0, 1.0, 2.0, 4.0)],
                                   "feature_id string, out_pos int, mean double, scale double, variance double")
    vectors = features.transform_vectors(log_counts, entities, fitted, 1)
    assert vectors.count() == N and vectors.filter("vec[0] <> -0.5").isEmpty()


def test_duplicates_are_summed(spark):
    df = spark.createDataFrame([("a", "f", 1), ("a", "f", 2), ("a", "g", 1)], "entity_id string, feature_id string, cnt long")
    assert sorted(tuple(r) for r in features.sum_duplicates(df).collect()) == [("a", "f", 3), ("a", "g", 1)]


def test_fold_moments_equal_direct_statistics(spark, counts, entities, matrix):
    logs = dense_log(matrix)
    log_counts = features.normalize_log(counts).join(entities.select("entity_id", "grp"), "entity_id")
    got = features.fold_moments(log_counts, groups.group_sizes(entities))
    for r in got.collect():
        g, j = int(r["outer_grp"]), int(r["feature_id"][1:])
        train = logs[[i for i in range(N) if i % 4 != g]][:, j]
        assert r["mean"] == pytest.approx(train.mean(), abs=1e-12)
        assert r["variance"] == pytest.approx(train.var(), abs=1e-9)
    assert got.count() == 4 * (P - 1)


def test_standardize_uses_population_deviation(spark):
    rows = spark.createDataFrame([("a", [1.0, 5.0]), ("b", [3.0, 5.0])], "entity_id string, vec array<double>")
    stats = features.vector_moments(rows)
    got = {r["entity_id"]: r["vec"] for r in features.standardize(rows, stats).collect()}
    assert got == {"a": [-1.0, 0.0], "b": [1.0, 0.0]}


def test_keyed_standardize(spark):
    rows = spark.createDataFrame([("p", [1.0]), ("p", [3.0]), ("q", [10.0]), ("q", [10.0])], "k string, vec array<double>")
    got = features.standardize(rows, features.vector_moments(rows, ["k"]), ["k"]).collect()
    assert sorted((r["k"], r["vec"][0]) for r in got) == [("p", -1.0), ("p", 1.0), ("q", 0.0), ("q", 0.0)]


def test_panel_mapping(spark):
    panel = spark.createDataFrame([(0, "E1", "b"), (1, "E2", "x"), (2, "E3", "a")], "panel_pos long, panel_id string, feature_name string")
    here = spark.createDataFrame([("a", 0), ("b", 1)], "feature_id string, feature_pos long")
    mapping = map_panel(panel, here, "panel.tsv")
    assert [(r["present"], r["feature_index"]) for r in mapping.orderBy("panel_pos").collect()] == [(True, 1), (False, -1), (True, 0)]
    assert panel_coverage(mapping).first()["coverage_percent"] == pytest.approx(200 / 3)
    assert [(r["feature_name"], r["out_pos"]) for r in restrict_panel(mapping).orderBy("out_pos").collect()] == [("b", 0), ("a", 1)]


def test_alignment_refuses_missing_vectors(spark):
    ref = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    vec = spark.createDataFrame([("b", [1.0]), ("c", [2.0])], "entity_id string, vec array<double>")
    with pytest.raises(CheckFailed, match="missing 1"):
        align_vectors(ref, vec)
    assert align_vectors(ref.filter("entity_id = 'b'"), vec).first()["vec"] == [1.0]


def test_folds_need_four_groups(spark, entities):
    with pytest.raises(ValueError):
        groups.group_folds(entities.filter("grp < '3'"))
    folds = groups.group_folds(entities)
    assert folds.count() == 4 * N
    assert folds.filter("(role = 'hold') <> (grp = outer_grp)").isEmpty()


def test_round_floats_equals_round(spark):
    """Halves (odd multiples of 1/32 at four decimals), neighbours of halves, signs, zeros and values out of range."""
    rng = np.random.default_rng(8)
    halves = np.arange(-2001, 2001, 2) / 32
    near = np.nextafter(halves.astype(np.float32), np.float32(9e9))
    x = np.concatenate([halves, near, rng.normal(size=4000) * 10.0 ** rng.integers(-8, 6, 4000), [0.0, -0.0, -1e-6, 1e-30, 3e9, -1e20, np.inf, -np.inf, np.nan]])
    df = spark.createDataFrame([(float(v),) for v in x.astype(np.float32)], "x float").union(spark.createDataFrame([(None,)], "x float"))
    for decimals in (2, 4, 6):
        pairs = df.select(round_floats(F.col("x"), decimals), F.round(F.col("x").cast("double"), decimals)).collect()
        assert len(pairs) == len(x) + 1 and all(repr(a) == repr(b) for a, b in pairs)
    plan = df.select(round_floats(F.col("x"), 4))._jdf.queryExecution().executedPlan().toString()
    assert "floor" in plan.lower()
