"""Stored probes: train, evaluate, freeze; and the coarse-to-fine search for C."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.functions.arrow import to_matrix
from probeloom.functions.scalars import COARSE_C, fine_grid
from probeloom.operators import comparison, metrics, probe
from probeloom.operators.checks import CheckFailed
from probeloom.operators.joint_probe import View, Wanted, fit_together, score_together
from probeloom.operators.probe import Probe
from probeloom.session import bounded_rows, settle
from probeloom.sources.digests import checksum
from probeloom.sources.writers import read_report, refuse_existing, write_report, write_table


def train_probe(rows: DataFrame, path: str, method: str, C: float = 1.0, candidate: str | None = None,
                max_iter: int = probe.MAX_ITERATIONS) -> dict:
    """Fit on the training rows of ``rows`` (label, split, vec) and store the coefficients."""
    spark = rows.sparkSession
    refuse_existing(spark, path)
    train = rows.filter("split = 'train'")
    classes = probe.classes_of(train)
    prepared = probe.persisted(probe.training_rows(train, classes))
    try:
        n = prepared.count()
        model = probe.fit_probe(prepared, classes, n, C=C, max_iter=max_iter, strict=True)
    finally:
        prepared.unpersist()
    stored = write_table(probe.coefficient_table(spark, model), f"{path}/coefficients")
    return write_report(spark, dict(
        status="trained", method=method, candidate=candidate, C=C, n_train=n, max_iter=max_iter,
        iterations=model.iterations, n_features=int(model.coef.shape[1]), model_checksum=checksum(stored),
    ), f"{path}/training")


def load_model(spark: SparkSession, path: str) -> tuple[dict, Probe]:
    report = read_report(spark, f"{path}/training")
    table = spark.read.parquet(f"{path}/coefficients")
    if report["status"] != "trained" or checksum(table) != report["model_checksum"]:
        raise CheckFailed(f"{path}: not a trained model, or its coefficients have changed")
    rows = sorted(bounded_rows(table, 10_000, "classes"), key=lambda r: r["class_pos"])
    return report, Probe(
        [r["label"] for r in rows], np.array([r["weights"] for r in rows]),
        np.array([r["intercept"] for r in rows]), report["C"], report["iterations"], True,
    )


def _evaluate(rows: DataFrame, model_path: str, path: str, split: str) -> dict:
    spark = rows.sparkSession
    refuse_existing(spark, path)
    report, model = load_model(spark, model_path)
    scored = metrics.with_prediction(probe.score(rows.filter(F.col("split") == split), model), model.classes)
    predictions = write_table(scored.select("entity_id", "label", "prediction", "probs"), f"{path}/predictions")
    table = settle(metrics.confusion(predictions, model.classes))
    write_table(metrics.confusion_matrix(table, model.classes), f"{path}/confusion")
    write_table(metrics.report(table), f"{path}/per_class")
    found = metrics.scalar_metrics(table, classes=model.classes).first().asDict()
    return write_report(spark, dict(
        found, split=split, method=report["method"], candidate=report["candidate"], C=report["C"],
        model_checksum=report["model_checksum"],
    ), f"{path}/metrics")


def evaluate_validation(rows: DataFrame, model_path: str, path: str, freeze: bool = False) -> dict:
    """Score validation rows; with ``freeze``, also bind the model to these metrics."""
    found = _evaluate(rows, model_path, path, "validation")
    if freeze:
        write_report(rows.sparkSession, dict(
            status="frozen", model_checksum=found["model_checksum"], validation_metrics=f"{path}/metrics",
            validation_macro_f1=found["macro_f1"],
        ), f"{path}/selection")
    return found


def evaluate_test(rows: DataFrame, model_path: str, path: str, selection: str) -> dict:
    """Score test rows, only with a frozen selection of exactly this model."""
    spark = rows.sparkSession
    frozen = read_report(spark, selection)
    report, _ = load_model(spark, model_path)
    if frozen["status"] != "frozen" or frozen["model_checksum"] != report["model_checksum"]:
        raise CheckFailed(f"{selection}: frozen for another model than {model_path}")
    recorded = read_report(spark, frozen["validation_metrics"])
    if recorded["macro_f1"] != frozen["validation_macro_f1"] or recorded["model_checksum"] != report["model_checksum"]:
        raise CheckFailed("the frozen validation metrics have changed")
    return _evaluate(rows, model_path, path, "test")


# --- search -------------------------------------------------------------------

SEARCH_SCHEMA = (
    "feature_set string, search_stage string, C double, n_train long, n_validation long, n_features int, "
    "val_accuracy double, val_macro_f1 double, val_balanced_accuracy double, val_log_loss double, converged boolean, "
    "gradient double, iterations int"
)


# Fixed value: the largest gradient coordinate at which a fit of the search counts as converged.
SEARCH_TOLERANCE = 1e-4


def _part(part: int) -> View:
    """Rows of one representation among the stacked ones."""

    def rows(batch):
        keep = np.flatnonzero(batch.column("part").to_numpy(zero_copy_only=False) == part)
        return keep, to_matrix(batch.column("vec").take(pa.array(keep)))

    return View(rows)


def search_c(inputs: dict[str, DataFrame], coarse: Sequence[float] = COARSE_C, fine_points: int = 21) -> tuple[DataFrame, DataFrame]:
    """Coarse then fine search per representation; returns (all fits, best per representation).

    ``inputs``: name -> entity_id, label, split, vec, with the same training labels.
    The rows of all representations are stacked and kept in memory; the fits of a
    stage, all representations and penalties together, share every scan, and so does
    their scoring.
    """
    spark = next(iter(inputs.values())).sparkSession
    names = list(inputs)
    lists = {name: probe.classes_of(df.filter("split = 'train'")) for name, df in inputs.items()}
    classes = lists[names[0]]
    if any(c != classes for c in lists.values()):
        raise CheckFailed(f"training labels differ between representations: {lists}")
    number = (F.array_position(metrics.class_list(classes), F.col("label")) - 1).cast("int")
    stacked = reduce(DataFrame.unionByName, [
        df.filter("split IN ('train', 'validation')").select(
            F.lit(i).alias("part"), "split", number.alias("y"), F.col("vec").cast("array<double>").alias("vec"))
        for i, (_, df) in enumerate(inputs.items())
    ])
    stacked = probe.persisted(stacked)
    train, held = stacked.filter("split = 'train'").drop("split"), stacked.filter("split = 'validation'").drop("split")
    try:
        if not held.filter("y IS NULL OR y < 0").isEmpty():
            raise CheckFailed("validation labels that no training row has")
        about = {r["part"]: r for r in bounded_rows(
            train.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")), len(names), "representations")}
        views = [_part(i) for i in range(len(names))]

        def stage(kind: str, values: dict[int, Sequence[float]]) -> list[tuple]:
            wanted = [Wanted(i, 1.0 / (about[i]["n"] * c)) for i, cs in values.items() for c in cs]
            penalties = [c for cs in values.values() for c in cs]
            models = fit_together(train, views, wanted, classes, SEARCH_TOLERANCE)
            cells = score_together(held, views, [(w.view, m) for w, m in zip(wanted, models)])
            found = {r["model"]: r for r in metrics.scalar_metrics(cells, ["model"], classes).collect()}
            return [
                (names[w.view], kind, float(c), about[w.view]["n"], found[k]["n_rows"], about[w.view]["width"], found[k]["accuracy"],
                 found[k]["macro_f1"], found[k]["balanced_accuracy"], found[k]["log_loss"], m.converged, m.gradient, m.iterations)
                for k, (w, c, m) in enumerate(zip(wanted, penalties, models))
            ]

        first = stage("coarse", {i: list(coarse) for i in range(len(names))})
        won = settle(comparison.best_c(spark.createDataFrame(first, SEARCH_SCHEMA)))
        refined = {r["feature_set"]: r["g"] for r in won.select("feature_set", fine_grid(F.col("C"), coarse, fine_points).alias("g")).collect()}
        if set(refined) != set(names):
            raise CheckFailed(f"no fit converged: {sorted(set(names) - set(refined))}")
        values = {i: refined[name] for i, name in enumerate(names) if refined[name]}
        second = stage("fine", values) if values else []
    finally:
        stacked.unpersist()
    everything = spark.createDataFrame(first + second, SEARCH_SCHEMA)
    won = won.select("feature_set", F.col("C").alias("coarse_best_C"), F.col("val_macro_f1").alias("coarse_best_macro_f1"))
    return everything, comparison.best_c(everything).join(won, "feature_set").orderBy(F.col("val_macro_f1").desc())


def analyse_best(inputs: dict[str, DataFrame], best: DataFrame, tol: float = 1e-8) -> DataFrame:
    """Refit each winner, require the selected score again, and report per class."""
    out = None
    for r in best.collect():
        df = inputs[r["feature_set"]]
        classes = probe.classes_of(df.filter("split = 'train'"))
        train = probe.persisted(probe.training_rows(df.filter("split = 'train'"), classes))
        model = probe.fit_probe(train, classes, r["n_train"], C=r["C"], strict=True)
        train.unpersist()
        table = settle(probe.confusion_of(df.filter("split = 'validation'"), [model]))
        again = metrics.scalar_metrics(table.drop("model"), classes=classes).first()["macro_f1"]
        if abs(again - r["val_macro_f1"]) > tol:
            raise CheckFailed(f"{r['feature_set']}: score {r['val_macro_f1']} became {again}")
        one = metrics.report(table).select(F.lit(r["feature_set"]).alias("feature_set"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def select_models(inputs: dict[str, DataFrame], grid: DataFrame, coarse: Sequence[float] = COARSE_C,
                  fine_points: int = 21) -> dict[str, DataFrame]:
    """Search C for all representations, rank the dictionaries, recommend one of each kind.

    ``grid`` is the result of a dictionary grid; its candidates are names in ``inputs``.
    """
    everything, best = search_c(inputs, coarse, fine_points)
    best = settle(best)
    names = grid.select(F.col("candidate").alias("feature_set"))
    mine = best.join(names, "feature_set", "left_semi").withColumnRenamed("feature_set", "candidate")
    ranked = settle(comparison.rank_dictionaries(mine, grid))
    winner = ranked.filter("rank = 1").select(F.col("candidate").alias("feature_set"))
    fixed = best.join(names, "feature_set", "left_anti")
    return {
        "runs": everything, "best": best, "ranking": ranked,
        "recommended": fixed.unionByName(best.join(winner, "feature_set", "left_semi")),
    }
