from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from probeloom.functions.arrow import dense_vector
from probeloom.operators import atoms, split
from probeloom.operators.checks import CheckFailed
from probeloom.operators.dictionary import Setting
from probeloom.operators.probe import classes_of
from probeloom.plans import cohort, dictionaries, lineage, probing, reports, study
from probeloom.sources import readers

LABELS = ("a", "b", "c")


@pytest.fixture(scope="module")
def raw(spark):
    """Three classes of 40 entities over four groups; classes prefer different features."""
    rng = np.random.default_rng(11)
    entities, counts = [], []
    for i in range(120):
        y = i % 3
        entities.append((f"e{i:03d}", LABELS[y], f"g{i % 4}"))
        rate = np.full(20, 1.0)
        rate[y * 5:y * 5 + 5] = 4.0
        for j, c in enumerate(rng.poisson(rate)):
            if c:
                counts.append((f"e{i:03d}", f"f{j:02d}", int(c)))
    e = spark.createDataFrame(entities, "entity_id string, label string, grp string").cache()
    c = spark.createDataFrame(counts, "entity_id string, feature_id string, cnt long").cache()
    return e, c


@pytest.fixture(scope="module")
def bundle(spark, raw, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("run"))
    entities, counts = raw
    cohort.save_split(split.stratified_split(entities), entities, f"{root}/split", confirmed=True)
    loaded = cohort.load_cohort(spark, f"{root}/split", entities, counts)
    report = cohort.prepare(loaded, f"{root}/features", n_features=12)
    assert report["n_features_selected"] == 12
    return root


def test_end_to_end(spark, raw, bundle):
    entities, _ = raw
    settings = probing.read_report(spark, f"{bundle}/split/settings")
    vectors = cohort.load_inputs(spark, f"{bundle}/split", f"{bundle}/features")["expression"]
    assert {r[0] for r in vectors.select("split").distinct().collect()} == {"train", "validation"}
    wanted = dictionaries.candidates(readers.grid(spark, [3, 4], [1.0], [0], 2))
    grid = dictionaries.run_grid(vectors, wanted, f"{bundle}/grid", settings["manifest_checksum"], batches=2)
    again = dictionaries.run_grid(vectors, wanted, f"{bundle}/grid", settings["manifest_checksum"], batches=2)
    assert sorted(map(tuple, grid.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(CheckFailed):
        dictionaries.run_grid(vectors, wanted, f"{bundle}/grid", "another split", batches=2)
    folders = {dictionaries.candidate_name(s): f"{bundle}/grid/{dictionaries.candidate_name(s)}" for s in wanted}
    embeddings = entities.select("entity_id", F.array(F.crc32("label").cast("double") / 1e9, F.lit(1.0)).alias("vec"))
    inputs = cohort.load_inputs(spark, f"{bundle}/split", f"{bundle}/features", folders, embeddings)
    assert set(inputs) == {"expression", "embedding", *folders}
    chosen = probing.select_models(inputs, grid, coarse=(0.1, 1.0), fine_points=3)
    assert chosen["recommended"].count() == 3 and chosen["ranking"].count() == 2
    assert reports.ranked_grid(chosen["ranking"]).count() == 2

    model, check = f"{bundle}/model", f"{bundle}/validation"
    probing.train_probe(inputs["expression"], model, "expression", C=1.0)
    found = probing.evaluate_validation(inputs["expression"], model, check, freeze=True)
    assert found["macro_f1"] > 0.8
    everything = spark.read.parquet(f"{bundle}/features/vectors")
    test = probing.evaluate_test(everything, model, f"{bundle}/test", f"{check}/selection")
    assert test["split"] == "test" and test["n_rows"] == 18
    probing.train_probe(inputs["expression"], f"{bundle}/model2", "expression", C=0.01)
    with pytest.raises(CheckFailed):
        probing.evaluate_test(everything, f"{bundle}/model2", f"{bundle}/test2", f"{check}/selection")
    probing.evaluate_validation(inputs["expression"], f"{bundle}/model2", f"{bundle}/validation2")
    table = reports.summarize_evaluations(spark, [check, f"{bundle}/validation2"])
    assert table.count() == 2 and table.select("evaluation_dir").distinct().count() == 2
    with pytest.raises(CheckFailed):
        reports.summarize_evaluations(spark, [check, f"{bundle}/test"])
    per_class = {"x": spark.read.parquet(f"{check}/per_class"), "y": spark.read.parquet(f"{bundle}/validation2/per_class")}
    assert reports.f1_by_class(per_class).count() == 3


def test_changed_inputs_are_refused(spark, raw, bundle):
    entities, counts = raw
    with pytest.raises(CheckFailed):
        cohort.load_cohort(spark, f"{bundle}/split", entities.withColumn("grp", F.lit("g9")), counts)
    with pytest.raises(CheckFailed):
        cohort.load_cohort(spark, f"{bundle}/split", entities, counts.withColumn("cnt", F.col("cnt") + 0.5))
    with pytest.raises(CheckFailed):
        cohort.load_cohort(spark, f"{bundle}/split", entities, counts.filter("entity_id <> 'e005'"))
    with pytest.raises(FileExistsError):
        cohort.save_split(split.stratified_split(entities), entities, f"{bundle}/split")


def test_unconfirmed_splits_are_refused(spark, raw, folder):
    entities, counts = raw
    cohort.save_split(split.stratified_split(entities), entities, f"{folder}/draft")
    with pytest.raises(CheckFailed):
        cohort.load_cohort(spark, f"{folder}/draft", entities, counts)


def test_embeddings_must_cover_the_cohort(spark, raw, bundle):
    entities, _ = raw
    short = entities.filter("entity_id <> 'e000'").select("entity_id", F.array(F.lit(1.0)).alias("vec"))
    with pytest.raises(CheckFailed):
        cohort.load_inputs(spark, f"{bundle}/split", f"{bundle}/features", embeddings=short)


def test_handoff_chain(spark):
    chain = spark.createDataFrame([("prepared", "raw", "1"), ("embedded", "prepared", "2"), ("embedded", "weights", "9")],
                                  "child string, parent string, sha256 string")
    now = spark.createDataFrame([("raw", "1"), ("prepared", "3")], "path string, sha256 string")
    assert sorted(r["parent"] for r in cohort.check_handoff(chain, now).collect()) == ["prepared", "weights"]


def test_stale_stages(spark):
    files = spark.createDataFrame([("a", "p", "1"), ("b", "q", "1"), ("c", "r", "1")], "stage string, path string, sha256 string")
    now = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, sha256 string")
    needs = spark.createDataFrame([("d", "b"), ("e", "d"), ("b", "e"), ("f", "a")], "stage string, required string")
    found = lineage.stale_stages(lineage.changed_stages(files, now), needs)
    assert {r["stage"]: r["depth"] for r in found.collect()} == {"b": 0, "c": 0, "d": 1, "e": 2}


def test_provenance_names_the_first_broken_link(spark):
    links = spark.createDataFrame(
        [("out", "mid", "1"), ("mid", "raw", "2"), ("out", "side", "3"), ("side", "raw", "2"), ("side", "gone", "4"),
         ("x", "y", "5"), ("y", "x", "6"), ("z", "x", "6"), ("self", "self", "7"), ("mid", "raw", "2"), (None, "raw", "2"), ("late", "raw", None)],
        "child string, parent string, sha256 string")
    now = spark.createDataFrame([("mid", "1"), ("raw", "9"), ("side", "3"), ("x", "6"), ("y", "5"), ("self", "7")], "path string, sha256 string")
    found = {(r["artifact"], r["ancestor"]): (r["depth"], r["path"], r["first_broken"], r["status"]) for r in lineage.provenance(links, now).collect()}
    assert found["out", "mid"] == (1, ["out", "mid"], None, "whole")
    # Two chains of one length: the least path decides.
    assert found["out", "raw"] == (2, ["out", "mid", "raw"], "mid <- raw", "broken")
    assert found["out", "gone"] == (2, ["out", "side", "gone"], "side <- gone", "broken")
    assert found["x", "x"] == (2, ["x", "y", "x"], None, "cycle") and found["self", "self"][3] == "cycle"
    assert found["z", "y"] == (2, ["z", "x", "y"], None, "whole") and found["late", "raw"][3] == "broken"
    assert len(found) == 15
    with pytest.raises(CheckFailed):
        lineage.check_provenance(links, now)
    good = links.filter("child = 'out' AND parent = 'mid'")
    assert lineage.check_provenance(good, now).count() == 1
    assert lineage.provenance(links.limit(0), now).count() == 0


@pytest.mark.parametrize("variance_top", [None, 4])
def test_nested_study(spark, variance_top):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(96):
        y = (i // 4) % 2
        rows.append((f"e{i:02d}", LABELS[y], f"g{i % 4}", [float(v) for v in rng.normal(size=6) + y * np.arange(6) * 0.4],
                     [float(v) for v in rng.normal(size=3) + y]))
    df = spark.createDataFrame(rows, "entity_id string, label string, grp string, vec array<double>, emb array<double>").cache()
    found = study.nested_study(df, seeds=(0, 1, 2), n_atoms=3, alpha=0.2, epochs=2, lambdas=(1e-2,), batches=2,
                               variance_top=variance_top)
    assert found["inner"].count() == 4 * 3 * 5 * 2 and found["outer"].count() == 4 * 5 * 2
    assert found["matches"].count() == 4 * 3 * 3 and found["diagnostics"].count() == (4 * 3 + 4) * 3
    audit = study.audit_study(found, classes_of(df)).first()
    assert audit["status"] == "PASS" and audit["n_groups"] == 4 and audit["max_coding_kkt_residual"] < 1e-6
    tables = study.summarize_study(found)
    assert tables["summary"].count() == 6 and tables["paired"].count() == 4 and tables["stability_by_group"].count() == 4
    text = reports.f1_by_group(tables["group_means"], tables["seed_variation"], ["expression", "dictionary", "embedding"])
    assert text.count() == 4
    broken = dict(found, outer=found["outer"].withColumn("macro_f1", F.col("macro_f1") + 1e-9))
    with pytest.raises(CheckFailed):
        study.audit_study(broken, classes_of(df))


def test_selected_activity(spark):
    activity = spark.createDataFrame(
        [(1, "train", "x", 0.5), (1, "validation", "x", 0.25), (2, "train", "x", 9.0)],
        "atom int, split string, label string, standardized_mean double")
    top = spark.createDataFrame([(1, "positive", 1, "g1"), (1, "positive", 2, "g2"), (1, "negative", 1, "g3")],
                                "atom int, sign string, rank int, feature string")
    row = reports.selected_activity(activity, top, [(1, "x")]).first()
    assert (row["features"], row["train"], row["validation"]) == ("g1, g2", "0.500", "0.250")


def counted(spark):
    """Eight entities of each of two classes in each of four groups, and their counts."""
    rng = np.random.default_rng(6)
    entities, counts, dense = [], [], {}
    for i in range(64):
        y, g = (i // 4) % 2, i % 4
        rate = np.where(np.arange(14) // 5 == y, 3.0, 0.7)
        rate[13] = 5.0 if g == 0 else 0.0            # a feature that only one group has
        row = rng.poisson(rate)
        row[12] = 1
        entities.append((f"e{i:02d}", LABELS[y], f"g{g}", [float(rng.normal() + y)] * 2))
        dense[f"e{i:02d}"] = row
        counts += [(f"e{i:02d}", f"f{j:02d}", int(c)) for j, c in enumerate(row) if c]
    e = spark.createDataFrame(entities, "entity_id string, label string, grp string, emb array<double>")
    return e, spark.createDataFrame(counts, "entity_id string, feature_id string, cnt long").repartition(3), entities, dense


@pytest.mark.parametrize("policy", ["variance", "panel"])
def test_folds_from_counts_see_only_their_training_groups(spark, policy):
    e, c, entities, dense = counted(spark)
    panel = spark.createDataFrame([("f13", 0), ("f03", 1), ("nowhere", 2), ("f12", 3)], "feature_id string, out_pos int") if policy == "panel" else None
    inputs = study.from_counts(c, e, policy, 5, panel)
    assert [(f.outer, f.inner) for f in inputs.folds] == [(o, i) for o in ("g0", "g1", "g2", "g3") for i in [*[g for g in ("g0", "g1", "g2", "g3") if g != o], None]]
    stored = {r["entity_id"]: dense_vector(r["vec"]) for r in inputs.rows.collect()}
    assert set(stored) == set(dense)
    logs = {k: np.log1p(v * 1e4 / v.sum()) for k, v in dense.items()}
    for f in inputs.folds:
        train = np.array([logs[i] for i, _, g, _ in entities if g not in f.excluded])
        assert f.n_train == len(train)
        if policy == "panel":
            names = [13, 3, None, 12]
        else:
            v = train.var(axis=0)
            names = sorted(sorted((j for j in range(14) if v[j] > 1e-12), key=lambda j: (-v[j], j))[:5])
        for k, j in enumerate(names):
            x = train[:, j] if j is not None else np.zeros(len(train))
            assert f.mean[k] == pytest.approx(x.mean(), abs=1e-12)
            assert f.scale[k] == pytest.approx(x.std() if x.std() > 1e-9 else 1.0, abs=1e-7)
            got = np.array([stored[i][f.columns[k]] for i, *_ in entities])
            np.testing.assert_allclose(got, [logs[i][j] if j is not None else 0.0 for i, *_ in entities], atol=1e-12)
        if "g0" in f.excluded and policy == "variance":
            assert 13 not in names                     # its variance lies outside what the fold may see


@pytest.mark.parametrize("policy", ["variance", "panel"])
def test_study_from_counts(spark, policy):
    e, c, _, _ = counted(spark)
    panel = spark.createDataFrame([(f"f{j:02d}", j) for j in range(12)], "feature_id string, out_pos int") if policy == "panel" else None
    found = study.nested_study(study.from_counts(c, e, policy, 8, panel), n_atoms=3, alpha=0.5, epochs=2, lambdas=(1e-2, 1e-1), batches=2)
    audit = study.audit_study(found, ["a", "b"]).first()
    assert audit["status"] == "PASS" and audit["inner_fits"] == 12 * 5 * 2 * 2 and audit["verified_outer_fits"] == 4 * 5 * 2
    best = {r["method"]: r["macro_f1_mean"] for r in study.summarize_study(found)["summary"].filter("scaling = 'standard'").collect()}
    assert best["expression"] > 0.8
    # The same folds from dense vectors give the same probes.
    inputs = study.from_counts(c, e, policy, 8, panel)
    dense = inputs.rows.toPandas()
    dense["vec"] = [dense_vector(v) for v in dense["vec"]]
    again = study.Inputs(spark.createDataFrame(dense[["entity_id", "label", "grp", "emb", "vec"]]), inputs.folds)
    twice = study.nested_study(again, n_atoms=3, alpha=0.5, epochs=2, lambdas=(1e-2, 1e-1), batches=2)
    keys = ["grp", "method", "seed", "scaling"]
    one, two = ({tuple(r[k] for k in keys): (r["lambda"], r["macro_f1"], r["log_loss"]) for r in t["outer"].collect()} for t in (found, twice))
    assert set(one) == set(two)
    for k, v in one.items():
        assert two[k] == pytest.approx(v, abs=1e-6)


def test_study_settings_are_checked(spark):
    e, c, _, _ = counted(spark)
    with pytest.raises(ValueError):
        study.from_counts(c, e, "panel")
    with pytest.raises(ValueError):
        study.from_counts(c, e.filter("grp <> 'g0'"))
    inputs = study.from_counts(c, e, n_features=3)
    with pytest.raises(ValueError):
        study.nested_study(inputs, seeds=(0, 1))
    with pytest.raises(CheckFailed):
        study.nested_study(study.Inputs(inputs.rows.filter("NOT (grp = 'g1' AND label = 'a')"), inputs.folds), n_atoms=2, epochs=1)


def test_seed_pairs_are_matched_from_one_scan(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{i % 2}", [float(v) for v in rng.normal(size=9)]) for i in range(50)]
    rows = [(k, z[:8] + [0.0]) for k, z in rows]                   # a code that is always zero
    df = spark.createDataFrame(rows, "key string, z array<double>").repartition(4)
    dicts = {(f"k{k}", s): rng.normal(size=(3, 25)) for k in range(2) for s in (4, 5, 6)}
    found = atoms.match_seeds(df, dicts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    table = {}
    for r in found.collect():
        table.setdefault((r["grp"], r["seed_a"], r["seed_b"]), []).append(r)
    assert set(table) == {(f"k{k}", a, b) for k in range(2) for a, b in ((4, 5), (4, 6), (5, 6))}
    for (key, a, b), got in table.items():
        da, db = dicts[key, a], dicts[key, b]
        z = np.array([z for k, z in rows if k == key])
        za, zb = z[:, 3 * (a - 4):3 * (a - 3)], z[:, 3 * (b - 4):3 * (b - 3)]
        cos = da @ db.T / np.linalg.norm(da, axis=1)[:, None] / np.linalg.norm(db, axis=1)
        best = max(permutations(range(3)), key=lambda p: sum(abs(cos[i, p[i]]) for i in range(3)))
        for r in got:
            i, j = r["atom_a"] - 1, r["atom_b"] - 1
            assert best[i] == j and r["abs_cosine"] == pytest.approx(abs(cos[i, j])) and r["sign"] == np.sign(cos[i, j])
            tops = [set(np.argsort(np.abs(w), kind="stable")[-20:]) for w in (da[i], db[j])]
            assert r["top_feature_jaccard"] == pytest.approx(len(tops[0] & tops[1]) / len(tops[0] | tops[1]))
            if za[:, i].std() < 1e-12 or zb[:, j].std() < 1e-12:
                assert r["code_correlation"] is None
            else:
                assert r["code_correlation"] == pytest.approx(r["sign"] * np.corrcoef(za[:, i], zb[:, j])[0, 1], abs=1e-9)


def same_study(one, two):
    keys = ["grp", "method", "seed", "scaling"]
    a, b = ({tuple(r[k] for k in keys): (r["lambda"], r["macro_f1"], r["log_loss"]) for r in t["outer"].collect()} for t in (one, two))
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(v, abs=1e-9) for k, v in a.items())
    assert one["predictions"].count() == two["predictions"].count() and one["matches"].count() == two["matches"].count()


def test_stopped_study_goes_on_and_changed_files_are_refused(spark, folder, monkeypatch):
    e, c, _, _ = counted(spark)
    settings = dict(n_atoms=2, alpha=0.5, epochs=1, lambdas=(1e-1,), batches=2, path=f"{folder}/study")
    inputs = study.from_counts(c, e, n_features=6)

    def stop(*_):
        raise RuntimeError("stopped")

    real = study.predict_folds
    monkeypatch.setattr(study, "predict_folds", stop)
    with pytest.raises(RuntimeError):
        study.nested_study(inputs, **settings)
    with pytest.raises(CheckFailed, match="missing"):
        study.load_study(spark, settings["path"])
    # What was finished is not done again.
    monkeypatch.setattr(study, "predict_folds", real)
    for name in ("fit_together", "score_together"):
        monkeypatch.setattr(study, name, stop)
    monkeypatch.setattr(study.dictionary, "fit_dictionaries", stop)
    found = study.nested_study(inputs, **settings)
    same_study(found, study.load_study(spark, settings["path"]))
    assert study.audit_study(study.load_study(spark, settings["path"]), ["a", "b"]).first()["status"] == "PASS"
    monkeypatch.undo()
    same_study(found, study.nested_study(inputs, **{**settings, "path": None}))
    with pytest.raises(CheckFailed, match="other inputs"):
        study.nested_study(inputs, **{**settings, "alpha": 0.6})
    row = spark.read.parquet(f"{settings['path']}/log").filter("stage = 'predictions'").first()
    spark.read.parquet(row["path"]).limit(1).write.mode("append").parquet(row["path"])
    with pytest.raises(CheckFailed, match="predictions"):
        study.load_study(spark, settings["path"])
    leaky = dict(found, models=found["models"].withColumn("trained_on", F.array(F.lit("g0"), F.lit("g1"), F.lit("g2"))))
    with pytest.raises(CheckFailed, match="held against"):
        study.audit_study(leaky, ["a", "b"])
