import numpy as np
import pytest

from probeloom.functions.arrow import to_matrix
from probeloom.operators import joint_probe, probe
from probeloom.operators.checks import CheckFailed
from probeloom.operators.joint_probe import View, Wanted, fit_together, whole

RNG = np.random.default_rng(8)
N, P = 180, 6
Y = np.arange(N) % 3
X = RNG.normal(size=(N, P)) * [1, 30, 0.05, 1, 2, 1] + np.eye(3, P)[Y] * [2, 20, 0.1, 0, 0, 0]
X[:, 5] = 4.0                                      # a constant coordinate
GRP = np.arange(N) % 4


@pytest.fixture(scope="module")
def rows(spark):
    data = [(int(Y[i]), int(GRP[i]), [float(v) for v in X[i]]) for i in range(N)]
    return spark.createDataFrame(data, "y int, g int, vec array<double>").repartition(3).cache()


def without(group):
    def take(batch):
        keep = np.flatnonzero(batch.column("g").to_numpy(zero_copy_only=False) != group)
        return keep, to_matrix(batch.column("vec"))[keep]
    return View(take)


def gradient(model, x, y, lam, sd):
    p = probe.probabilities(model, x)
    p[np.arange(len(y)), y] -= 1
    return p.T @ x / len(y) + lam * model.coef * sd ** 2, p.mean(axis=0)


def test_every_fit_reaches_its_own_optimum(rows):
    views = [View(whole), without(0), without(2)]
    keeps = [np.arange(N), np.flatnonzero(GRP != 0), np.flatnonzero(GRP != 2)]
    wanted = [Wanted(v, lam, s) for v in range(3) for lam in (1e-5, 1e-3, 1e-1) for s in ("none", "standard")]
    models = fit_together(rows, views, wanted, ["a", "b", "c"], tolerance=1e-8, strict=True)
    for w, m in zip(wanted, models):
        x, y = X[keeps[w.view]], Y[keeps[w.view]]
        sd = np.where(x.std(axis=0) < 1e-12, 1, x.std(axis=0)) if w.scaling == "standard" else np.ones(P)
        g, g0 = gradient(m, x, y, w.lam, sd)
        # The optimum is that of the fitted coordinates: centred, and scaled where asked for.
        assert np.abs((g - np.outer(g0, x.mean(axis=0))) / sd).max() < 2e-8 and np.abs(g0).max() < 2e-8
        assert m.converged and m.gradient <= 1e-8 and m.iterations < 200


def test_fits_agree_with_single_fits(rows, spark):
    named = spark.createDataFrame([("abc"[Y[i]], [float(v) for v in X[i]]) for i in range(N)], "label string, vec array<double>")
    train = probe.training_rows(named, ["a", "b", "c"]).cache()
    for scaling in ("none", "standard"):
        one = probe.fit_probe(train, ["a", "b", "c"], N, lam=0.01, scaling=scaling, tol=1e-12)
        two, = fit_together(rows, [View(whole)], [Wanted(0, 0.01, scaling)], ["a", "b", "c"], tolerance=1e-9)
        np.testing.assert_allclose(probe.probabilities(one, X), probe.probabilities(two, X), atol=1e-4)


def test_two_classes_use_one_score(rows):
    part = rows.filter("y < 2")
    x, y = X[Y < 2], Y[Y < 2]
    m, = fit_together(part, [View(whole)], [Wanted(0, 0.1)], ["a", "b"], tolerance=1e-9)
    p = 1 / (1 + np.exp(-(x @ m.coef[1] + m.intercept[1])))
    assert not m.coef[0].any() and np.abs((p - y) @ x / len(y) + 0.1 * m.coef[1]).max() < 1e-7


def test_wide_input_starts_from_the_diagonal(rows, monkeypatch):
    monkeypatch.setattr(joint_probe, "FULL_WIDTH", 3)
    m, = fit_together(rows, [View(whole)], [Wanted(0, 1e-3, "standard")], ["a", "b", "c"], tolerance=1e-7, strict=True)
    sd = np.where(X.std(axis=0) < 1e-12, 1, X.std(axis=0))
    g, g0 = gradient(m, X, Y, 1e-3, sd)
    assert np.abs((g - np.outer(g0, X.mean(axis=0))) / sd).max() < 2e-7


def test_a_step_is_one_job_for_all_fits(rows, spark):
    tracker = spark.sparkContext.statusTracker()

    def jobs(wanted):
        spark.sparkContext.setJobGroup(f"fits{len(wanted)}", "")
        models = fit_together(rows, [View(whole), without(1)], wanted, ["a", "b", "c"])
        spark.sparkContext.setJobGroup("rest", "")
        return len(tracker.getJobIdsForGroup(f"fits{len(wanted)}")), max(m.iterations for m in models)

    lams = [10.0 ** -k for k in range(1, 5)]
    one, _ = jobs([Wanted(0, lams[-1])])
    many, steps = jobs([Wanted(v, lam, s) for v in (0, 1) for lam in lams for s in ("none", "standard")])
    per_scan = one / max(1, steps)
    assert many <= 4 * (steps + 12) and many < 8 * one, (one, many, steps, per_scan)


def test_failures_are_reported(rows):
    with pytest.raises(CheckFailed):
        fit_together(rows, [View(whole)], [Wanted(0, 1e-4)], ["a", "b", "c"], max_steps=2, strict=True)
    with pytest.raises(CheckFailed):
        fit_together(rows.filter("g > 9"), [View(whole)], [Wanted(0, 1e-4)], ["a", "b", "c"])
    with pytest.raises(CheckFailed):
        fit_together(rows, [View(whole)], [Wanted(0, 1e-4)], ["a"])


def test_scores_of_a_view(rows):
    models = [probe.Probe(["a", "b", "c"], RNG.normal(size=(3, P)) * 0.02, RNG.normal(size=3), 1.0, 0, True) for _ in range(3)]
    cells = joint_probe.score_together(rows, [View(whole), without(1)], [(0, models[0]), (1, models[1]), (1, models[2])]).collect()
    for i, keep in ((0, np.arange(N)), (1, np.flatnonzero(GRP != 1)), (2, np.flatnonzero(GRP != 1))):
        p = probe.probabilities(models[i], X[keep])
        mine = [c for c in cells if c["model"] == i]
        assert sum(c["n"] for c in mine) == len(keep)
        assert sum(c["n"] for c in mine if c["label"] == c["prediction"]) == (p.argmax(axis=1) == Y[keep]).sum()
        assert sum(c["loss"] for c in mine) == pytest.approx(-np.log(p[np.arange(len(keep)), Y[keep]]).sum(), rel=1e-9)
