import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from probeloom.operators import atoms, checks, coding, dictionary
from probeloom.operators.dictionary import Setting

RNG = np.random.default_rng(5)
D = RNG.normal(size=(6, 10))
D /= np.linalg.norm(D, axis=1, keepdims=True)
X = RNG.normal(size=(80, 10))
ALPHA = 0.3


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(f"e{i:02d}", "ab"[i % 2], str(i % 4), "train" if i < 60 else "validation", [float(v) for v in x]) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "entity_id string, label string, grp string, split string, vec array<double>")


def column(df, name):
    return np.array([r[name] for r in df.orderBy("entity_id").collect()])


def objective(x, z, d, alpha):
    return 0.5 * ((x - z @ d) ** 2).sum(axis=1) + alpha * np.abs(z).sum(axis=1)


def test_codes_are_optimal_and_both_forms_agree(vectors):
    coded = coding.encode(vectors, D, ALPHA)
    z = column(coded, "z")
    assert coding.kkt_rows(X, z, D, ALPHA).max() < 1e-8
    assert (objective(X, z, D, ALPHA) <= objective(X, np.zeros_like(z), D, ALPHA) + 1e-12).all()
    native = vectors.withColumn("z", coding.native_code(F.col("vec"), D, ALPHA, 2000))
    np.testing.assert_allclose(column(native, "z"), z, atol=1e-8)


def test_residual_functions_agree(vectors):
    rough = vectors.withColumn("z", F.transform(F.slice("vec", 1, 6), lambda v: F.when(F.abs(v) > 0.5, v * 0.3).otherwise(0.0)))
    a = column(rough.withColumn("k", coding.native_kkt(F.col("vec"), F.col("z"), D, ALPHA)), "k")
    b = column(rough.withColumn("k", coding.kkt(D, ALPHA)(F.col("vec"), F.col("z"))), "k")
    np.testing.assert_allclose(a, b, atol=1e-12)
    np.testing.assert_allclose(b, coding.kkt_rows(X, column(rough, "z"), D, ALPHA), atol=1e-12)


def test_native_coding_runs_on_a_stream(spark, vectors, folder):
    vectors.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(vectors.schema).parquet(f"{folder}/in")
    coded = stream.select("entity_id", coding.native_code(F.col("vec"), D, ALPHA, 50).alias("z"))
    query = coded.writeStream.format("memory").queryName("coded").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = vectors.select("entity_id", coding.native_code(F.col("vec"), D, ALPHA, 50).alias("z"))
    np.testing.assert_allclose(column(spark.table("coded"), "z"), column(batch, "z"))


def test_reconstruction_metrics(vectors):
    coded = coding.encode(vectors, D, ALPHA)
    z = column(coded, "z")
    got = {r["split"]: r for r in coding.reconstruction_metrics(coded, D).collect()}
    part = slice(60, None)
    assert got["validation"]["mse"] == pytest.approx(((X - z @ D)[part] ** 2).mean())
    assert got["validation"]["zero_reconstruction_mse"] == pytest.approx((X[part] ** 2).mean())
    assert got["validation"]["mean_active_atoms"] == pytest.approx((np.abs(z[part]) > 1e-6).sum(axis=1).mean())


def test_fit_lowers_the_objective_inside_the_unit_ball(spark, vectors):
    settings = [Setting("one", 4, ALPHA, 0, 6), Setting("two", 5, ALPHA, 1, 6)]
    fits = dictionary.fit_dictionaries(vectors, settings, batches=2)
    for fit, s in zip(fits, settings):
        start = dictionary.initial_atoms(vectors, [s])[0]
        before = objective(X, coding.lasso_rows(X, start, ALPHA), start, ALPHA).mean()
        after = objective(X, coding.lasso_rows(X, fit.atoms, ALPHA), fit.atoms, ALPHA).mean()
        assert after < before
        assert np.linalg.norm(fit.atoms, axis=1).max() <= 1 + 1e-9
    table = dictionary.atoms_table(spark, fits)
    assert checks.atom_violations(table).isEmpty()
    found = dictionary.diagnostics(vectors, fits, held=[("3",), ("3",)])
    for row, fit in zip(found, fits):
        z = coding.lasso_rows(X, fit.atoms, ALPHA)
        assert row["objective_per_row"] == pytest.approx(objective(X, z, fit.atoms, ALPHA).mean())
        assert row["train_max_kkt"] < 1e-6 and row["hold_max_kkt"] < 1e-6
        step = fit.atoms - z.T @ (z @ fit.atoms - X) / len(X)
        step /= np.maximum(1, np.linalg.norm(step, axis=1))[:, None]
        assert row["projected_gradient_norm"] == pytest.approx(np.linalg.norm(fit.atoms - step), abs=1e-9)
        hold = X[3::4]
        zh = coding.lasso_rows(hold, fit.atoms, ALPHA)
        assert row["hold_mse"] == pytest.approx(((hold - zh @ fit.atoms) ** 2).mean())


def test_fitting_together_equals_fitting_alone(vectors):
    a, b = Setting("a", 4, ALPHA, 0, 2), Setting("b", 3, 0.6, 1, 3, excluded=("0",))
    both = dictionary.fit_dictionaries(vectors, [a, b], batches=2)
    for fit, s in zip(both, [a, b]):
        alone = dictionary.fit_dictionaries(vectors, [s], batches=2)[0]
        np.testing.assert_allclose(fit.atoms, alone.atoms, atol=1e-9)
        assert fit.steps == alone.steps


def test_held_out_groups_do_not_train(vectors):
    s = Setting("s", 3, ALPHA, 0, 2, excluded=("1", "2"))
    part = vectors.filter("grp IN ('0', '3')")
    np.testing.assert_allclose(
        dictionary.fit_dictionaries(vectors, [s], batches=2)[0].atoms,
        dictionary.fit_dictionaries(part, [s], batches=2)[0].atoms, atol=1e-9)


@pytest.mark.parametrize("n,m", [(1, 1), (4, 4), (5, 6)])
def test_assignment_is_optimal(n, m):
    for seed in range(20):
        w = np.random.default_rng(seed).normal(size=(n, m)).round(1)
        best = max(sum(w[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))
        chosen = atoms.assign(w)
        assert len(set(chosen)) == n and w[np.arange(n), chosen].sum() == pytest.approx(best)


def make_atoms(spark, d):
    return spark.createDataFrame([(k + 1, [float(v) for v in w]) for k, w in enumerate(d)], "atom int, weights array<double>")


def test_pairs_and_matching(spark, vectors):
    other = np.vstack([-D[2], D[0], D[1], D[5], D[4], D[3]])
    za, zb = coding.lasso_rows(X, D, ALPHA), coding.lasso_rows(X, other, ALPHA)
    codes = coding.encode(coding.encode(vectors, D, ALPHA, out="za"), other, ALPHA, out="zb")
    pairs = atoms.atom_pairs(make_atoms(spark, D), make_atoms(spark, other), codes, top=4)
    for r in pairs.collect():
        u, v = za[:, r["atom_a"] - 1], zb[:, r["atom_b"] - 1]
        assert r["correlation"] == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-9)
        assert r["cosine"] == pytest.approx(D[r["atom_a"] - 1] @ other[r["atom_b"] - 1])
    matched = {r["atom_a"]: r for r in atoms.match_atoms(pairs).collect()}
    assert {a: r["atom_b"] for a, r in matched.items()} == {1: 2, 2: 3, 3: 1, 4: 6, 5: 5, 6: 4}
    assert matched[3]["sign"] == -1.0 and matched[3]["code_correlation"] == pytest.approx(1.0)
    assert all(r["top_feature_jaccard"] == 1.0 and r["abs_cosine"] == pytest.approx(1.0) for r in matched.values())
    stable = atoms.stability(atoms.match_atoms(pairs.withColumn("grp", F.lit("g")), ["grp"]), ["grp"]).first()
    assert stable["median_abs_cosine"] == pytest.approx(1.0)


def test_constant_codes_have_no_correlation(spark):
    codes = spark.createDataFrame([([1.0, 0.0], [1.0]), ([1.0, 2.0], [3.0])], "za array<double>, zb array<double>")
    got = {(r["atom_a"], r["atom_b"]): r["correlation"] for r in atoms.code_correlations(codes).collect()}
    assert got == {(1, 1): None, (2, 1): pytest.approx(1.0)}


def test_top_rules_break_ties_both_ways(spark):
    table = make_atoms(spark, [[0.5, -0.5, 0.0, 0.5, -0.5]])
    signed = [(r["sign"], r["rank"], r["pos"]) for r in atoms.top_signed(table, 1).orderBy("sign").collect()]
    assert signed == [("negative", 1, 1), ("positive", 1, 0)]
    assert [r["pos"] for r in atoms.top_absolute(table, 2).orderBy("rank").collect()] == [4, 3]


def test_review(spark, vectors):
    coded = coding.encode(vectors, D, ALPHA)
    z, train = column(coded, "z"), slice(0, 60)
    tables = atoms.review(make_atoms(spark, D), coded, top=3, display=2)
    labels = np.array(["ab"[i % 2] for i in range(80)])
    mean, sd = z[train].mean(axis=0), z[train].std(axis=0)
    for r in tables["activity"].collect():
        part = z[train] if r["split"] == "train" else z[60:]
        mine = part[(labels[train] if r["split"] == "train" else labels[60:]) == r["label"]][:, r["atom"] - 1]
        assert r["n_rows"] == len(mine) and r["mean_activity"] == pytest.approx(mine.mean())
        assert r["standardized_mean"] == pytest.approx((mine.mean() - mean[r["atom"] - 1]) / sd[r["atom"] - 1])
        assert r["active_fraction"] == pytest.approx((np.abs(mine) > 1e-6).mean())
    assert tables["displayed"].count() == 2
    cos = D @ D.T - np.eye(6)
    assert tables["max_cosine"].first()[0] == pytest.approx(np.abs(cos).max())
    for r in tables["diagnostics"].collect():
        assert r["train_active_fraction"] == pytest.approx((np.abs(z[train][:, r["atom"] - 1]) > 1e-6).mean())
    assert coded.transform(atoms.code_usage).filter("unused <> (active_fraction = 0)").isEmpty()


def test_initial_atoms_follow_the_hash_order(vectors):
    import hashlib
    order = sorted(range(80), key=lambda i: hashlib.md5(f"7:e{i:02d}".encode()).hexdigest())
    mean, scale = X.mean(axis=0), X.std(axis=0)
    plain, scaled = dictionary.initial_atoms(vectors, [
        Setting("p", 5, ALPHA, 7), Setting("s", 4, ALPHA, 7, excluded=("2",), mean=mean, scale=scale)])
    want = X[order[:5]]
    np.testing.assert_allclose(plain, want / np.linalg.norm(want, axis=1, keepdims=True))
    want = (X[[i for i in order if i % 4 != 2][:4]] - mean) / scale
    np.testing.assert_allclose(scaled, want / np.linalg.norm(want, axis=1, keepdims=True))


def test_nearly_repeated_atoms_settle():
    """Atoms that all but coincide: coordinate descent creeps, the codes must be optimal all the same."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(5, 30))
    for noise in (1e-1, 1e-3, 1e-5, 0.0):
        d = np.vstack([base, base + noise * rng.normal(size=base.shape), base + noise * rng.normal(size=base.shape)])
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        x = rng.normal(size=(40, 30)) * 5
        for alpha in (0.1, 2.0):
            z = coding.lasso_rows(x, d, alpha)
            assert coding.kkt_rows(x, z, d, alpha).max() <= 1e-6
            plain = coding.lasso_rows(x, base / np.linalg.norm(base, axis=1, keepdims=True), alpha)
            cost = lambda z, d: 0.5 * ((x - z @ d) ** 2).sum() + alpha * np.abs(z).sum()
            assert cost(z, d) <= cost(plain, d[:5]) + 1e-6
            row = coding.active_set_row(d @ d.T, d @ x[0], alpha, np.zeros(15), 1e-9)
            assert coding.kkt_rows(x[:1], row[None], d, alpha).max() <= 1e-6


def test_leading_directions_are_singular_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 4)) @ np.diag([9, 5, 2, 1]) @ rng.normal(size=(4, 25)) + 0.01 * rng.normal(size=(90, 25))
    df = spark.createDataFrame([(f"e{i}", "a", "hold" if i % 3 == 0 else "train", [float(v) for v in x[i]]) for i in range(90)],
                               "entity_id string, label string, grp string, vec array<double>").repartition(3)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    settings = [Setting("a", 3, 1.0, 1), Setting("b", 4, 1.0, 2, excluded=("hold",), mean=mean, scale=scale), Setting("c", 40, 1.0, 3)]
    inputs = [x, ((x - mean) / scale)[[i for i in range(90) if i % 3]], x]
    for s, own, (values, v) in zip(settings, inputs, dictionary.leading_directions(df, settings, power=12)):
        _, want, vt = np.linalg.svd(own, full_matrices=False)
        k = min(s.atoms, 25)
        np.testing.assert_allclose(values, want[:k], rtol=1e-6, atol=1e-6)
        np.testing.assert_allclose(np.abs((v[:3] * vt[:3]).sum(axis=1)), 1, atol=1e-6)
    starts = dictionary.first_atoms(df, [Setting("r", 3, 1.0, 1), Setting("s", 40, 1.0, 1, start="svd")])
    assert [d.shape for d in starts] == [(3, 25), (40, 25)] and not starts[1][25:].any()
    fits = dictionary.fit_dictionaries(df, [Setting("s", 4, 0.5, 1, 3, start="svd")], 2)
    assert np.linalg.norm(fits[0].atoms, axis=1).max() <= 1 + 1e-9
    with pytest.raises(ValueError):
        dictionary.first_atoms(df, [Setting("q", 3, 1.0, 1, start="other")])
