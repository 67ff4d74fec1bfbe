import numpy as np
import pytest
from pyspark.sql import functions as F

from probeloom.operators import features, metrics, probe
from probeloom.plans import probing
from probeloom.operators.checks import CheckFailed

RNG = np.random.default_rng(2)
N, P = 150, 5
Y = np.arange(N) % 3
X = RNG.normal(size=(N, P)) * [1, 3, 0.5, 1, 2] + np.eye(3, P)[Y] * 1.5


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"e{i:03d}", "abc"[Y[i]], str(i % 4), "train" if i < 100 else "validation", [float(v) for v in X[i]]) for i in range(N)]
    return spark.createDataFrame(data, "entity_id string, label string, grp string, split string, vec array<double>").cache()


def gradient(model, x, y, lam):
    p = probe.probabilities(model, x)
    p[np.arange(len(y)), y] -= 1
    return p.T @ x / len(y) + lam * model.coef, p.mean(axis=0)


@pytest.mark.parametrize("C", [0.05, 1.0, 20.0])
def test_fit_reaches_the_stated_optimum(rows, C):
    train = probe.training_rows(rows, ["a", "b", "c"])
    model = probe.fit_probe(train, ["a", "b", "c"], N, C=C, tol=1e-9)
    g, g0 = gradient(model, X, Y, 1 / (N * C))
    assert np.abs(g).max() < 1e-4 and np.abs(g0).max() < 1e-4
    assert model.converged


def test_standard_scaling_equals_explicit_standardization(rows):
    classes = ["a", "b", "c"]
    scaled = features.standardize(rows, features.vector_moments(rows))
    one = probe.fit_probe(probe.training_rows(rows, classes), classes, N, lam=0.01, scaling="standard", tol=1e-10)
    two = probe.fit_probe(probe.training_rows(scaled, classes), classes, N, lam=0.01, tol=1e-10)
    xs = (X - X.mean(axis=0)) / X.std(axis=0)
    np.testing.assert_allclose(probe.probabilities(one, X), probe.probabilities(two, xs), atol=1e-4)


def test_two_classes_use_one_score(rows):
    part = rows.filter("label <> 'c'")
    y, x = Y[Y < 2], X[Y < 2]
    model = probe.fit_probe(probe.training_rows(part, ["a", "b"]), ["a", "b"], len(y), lam=0.1, tol=1e-10)
    w, b = model.coef[1], model.intercept[1]
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs((p - y) @ x / len(y) + 0.1 * w).max() < 1e-4
    assert not model.coef[0].any()


def test_scores_agree_between_forms(rows):
    model = probe.Probe(["a", "b", "c"], RNG.normal(size=(3, P)), RNG.normal(size=3), 1.0, 0, True)
    a = np.array([r["probs"] for r in probe.score(rows, model).orderBy("entity_id").collect()])
    b = np.array([r["probs"] for r in probe.native_score(rows, model).orderBy("entity_id").collect()])
    np.testing.assert_allclose(a, b, atol=1e-12)
    np.testing.assert_allclose(a, probe.probabilities(model, X), atol=1e-12)


def test_shared_scan_confusion_equals_single_models(rows):
    models = [probe.Probe(["a", "b", "c"], RNG.normal(size=(3, P)), RNG.normal(size=3), 1.0, 0, True) for _ in range(3)]
    together = {r["model"]: r for r in metrics.scalar_metrics(probe.confusion_of(rows, models), ["model"]).collect()}
    grouped = {r["model"]: r for r in metrics.scalar_metrics(
        probe.confusion_of(rows, models, groups=["0", "1", "2"]), ["model"]).collect()}
    for i, m in enumerate(models):
        scored = metrics.with_prediction(probe.score(rows, m), m.classes)
        alone = metrics.scored_metrics(scored, m.classes).first()
        part = metrics.scored_metrics(scored.filter(F.col("grp") == str(i)), m.classes).first()
        for k in metrics.METRICS:
            assert together[i][k] == pytest.approx(alone[k], abs=1e-12)
            assert grouped[i][k] == pytest.approx(part[k], abs=1e-12)


def test_search_refines_and_reproduces(rows):
    everything, best = probing.search_c({"x": rows}, coarse=(0.01, 1.0, 100.0), fine_points=5)
    table = everything.collect()
    assert len([r for r in table if r["search_stage"] == "coarse"]) == 3
    winner = best.first()
    top = max(r["val_macro_f1"] for r in table if r["converged"])
    assert winner["val_macro_f1"] == top
    assert winner["C"] == min(r["C"] for r in table if r["val_macro_f1"] == top and r["converged"])
    report = probing.analyse_best({"x": rows}, best)
    assert report.filter("label = 'macro avg'").first()["f1_score"] == pytest.approx(top)
    with pytest.raises(CheckFailed):
        probing.analyse_best({"x": rows}, best.withColumn("val_macro_f1", F.lit(0.123)))


def test_non_convergence_is_an_error(rows):
    with pytest.raises(CheckFailed):
        probe.fit_probe(probe.training_rows(rows, ["a", "b", "c"]), ["a", "b", "c"], N, C=1.0, max_iter=1, strict=True)
