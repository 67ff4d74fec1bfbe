import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probeloom.functions import scalars as S
from probeloom.functions import vectors as V
from probeloom.operators import comparison, metrics

CLASSES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        p = rng.dirichlet([1.0, 1.0, 0.02])
        rows.append((f"e{i}", CLASSES[i % 2], "xy"[i % 2 if i < 50 else 0], [float(v) for v in p]))
    return metrics.with_prediction(
        spark.createDataFrame(rows, "entity_id string, label string, k string, probs array<double>"), CLASSES)


def brute(rows):
    y = [r["label"] for r in rows]
    p = [CLASSES[int(np.argmax(r["probs"]))] for r in rows]
    f1 = []
    recall = []
    for c in sorted(set(y) | set(p)):
        tp = sum(a == c and b == c for a, b in zip(y, p))
        su, pr = y.count(c), p.count(c)
        f1.append(2 * tp / (su + pr))
        if su:
            recall.append(tp / su)
    loss = -np.mean([math.log(max(r["probs"][CLASSES.index(r["label"])], 2.2e-16)) for r in rows])
    return dict(macro_f1=np.mean(f1), accuracy=np.mean([a == b for a, b in zip(y, p)]),
                balanced_accuracy=np.mean(recall), log_loss=loss)


def test_scalar_metrics(predictions):
    got = metrics.scored_metrics(predictions, CLASSES).first().asDict()
    for name, value in brute(predictions.collect()).items():
        assert got[name] == pytest.approx(value, abs=1e-12)


def test_keyed_metrics(predictions):
    for r in metrics.scored_metrics(predictions, CLASSES, ["k"]).collect():
        want = brute(predictions.filter(F.col("k") == r["k"]).collect())
        assert r["macro_f1"] == pytest.approx(want["macro_f1"], abs=1e-12)


def test_confusion_matrix_and_report(predictions):
    table = metrics.confusion(predictions, CLASSES)
    wide = {r["label"]: r.asDict() for r in metrics.confusion_matrix(table, CLASSES).collect()}
    assert sum(wide[l][c] for l in wide for c in CLASSES) == 60
    report = {r["label"]: r for r in metrics.report(table).collect()}
    assert report["macro avg"]["support"] == 60
    assert report["accuracy"]["f1_score"] == pytest.approx(brute(predictions.collect())["accuracy"])


def test_first_maximum_wins(spark):
    df = metrics.with_prediction(spark.createDataFrame([([0.4, 0.4, 0.2],)], "probs array<double>"), CLASSES)
    assert df.first()["prediction"] == "a"


def test_selection_rules(spark):
    rows = spark.createDataFrame(
        [("m", 1.0, 0.9, True), ("m", 0.1, 0.9, True), ("m", 0.01, 0.99, False)],
        "feature_set string, C double, val_macro_f1 double, converged boolean")
    assert comparison.best_c(rows).first()["C"] == 0.1
    inner = spark.createDataFrame(
        [("g", 1e-3, 0.8, True), ("g", 1e-3, 0.6, True), ("g", 1e-2, 0.7, True), ("g", 1e-2, 0.7, True),
         ("g", 1e-1, 0.9, True), ("g", 1e-1, 0.9, False)],
        "grp string, lambda double, macro_f1 double, converged boolean")
    assert comparison.best_lambda(inner, ["grp"]).first()["lambda"] == 1e-2


def test_ranking_ties_and_strict_merge(spark):
    best = spark.createDataFrame([("k2", 0.9), ("k1", 0.9), ("k0", 0.8)], "candidate string, val_macro_f1 double")
    diag = spark.createDataFrame([("k2", 8, 3.0), ("k1", 8, 3.0), ("k0", 4, 1.0)],
                                 "candidate string, atoms int, validation_mean_active_atoms double")
    ranked = comparison.rank_dictionaries(best, diag).orderBy("rank").collect()
    assert [r["candidate"] for r in ranked] == ["k1", "k2", "k0"]
    with pytest.raises(ValueError):
        comparison.rank_dictionaries(best, diag.filter("candidate <> 'k0'"))
    with pytest.raises(ValueError):
        comparison.rank_dictionaries(best, diag.unionByName(diag))


def test_two_level_summary_uses_groups_as_units(spark):
    rows = spark.createDataFrame(
        [("d", s, g, "standard", v, v, v, v) for g, vs in {"p": [0.1, 0.3], "q": [0.6, 0.8]}.items() for s, v in enumerate(vs)],
        "method string, seed long, grp string, scaling string, macro_f1 double, accuracy double, balanced_accuracy double, log_loss double")
    got = comparison.two_level_summary(rows).first()
    assert got["macro_f1_mean"] == pytest.approx(0.45)
    assert got["macro_f1_std"] == pytest.approx(np.std([0.2, 0.7], ddof=1))
    spread = {r["grp"]: r for r in comparison.seed_variation(rows).collect()}
    assert spread["p"]["std"] == pytest.approx(np.std([0.1, 0.3], ddof=1)) and spread["q"]["max"] == 0.8


def test_fine_grid_skips_tested_values(spark):
    got = spark.range(1).select(S.fine_grid(F.lit(1.0)).alias("g")).first()["g"]
    want = [v for v in np.geomspace(0.1, 10, 21) if not np.isclose(np.log(v), np.log([0.1, 1, 10]), atol=1e-10).any()]
    assert len(got) == 18
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_text_functions(spark):
    df = spark.createDataFrame([(" Val ",), ("VALID",), ("test",)], "s string")
    assert [r[0] for r in df.select(S.clean_split(F.col("s"))).collect()] == ["validation", "validation", "test"]
    key = spark.range(1).select(S.candidate_key(F.lit(64), F.lit(2.0), F.lit(42), F.lit(10))).first()[0]
    assert key == "k64_a2.0_s42_e10"


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = df.select(
        V.dot(a, b).alias("dot"), V.norm(a).alias("norm"), V.cosine(a, b).alias("cos"), V.l2_normalize(a).alias("unit"),
        V.softmax(a).alias("soft"), V.gather(a, F.array(F.lit(1), F.lit(0))).alias("swap"),
        V.soft_threshold(F.lit(-3.0), 1.0).alias("shrunk"), V.squared_distance(a, b).alias("d2"),
        V.logistic_pair(F.lit(0.0)).alias("pair"),
    ).first()
    assert (r["dot"], r["norm"], r["cos"], r["d2"]) == (24.0, 5.0, pytest.approx(0.96), 2.0)
    assert r["unit"] == pytest.approx([0.6, 0.8]) and sum(r["soft"]) == pytest.approx(1.0)
    assert r["swap"] == [4.0, 3.0] and r["shrunk"] == -2.0 and r["pair"] == [0.5, 0.5]
