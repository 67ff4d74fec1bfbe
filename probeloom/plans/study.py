"""Nested leave-one-group-out study of representations, and its audit.

Work is arranged so that entities are scanned as rarely as possible: group
statistics are taken once and combined per fold, all dictionaries of the study
are fitted together, and one scan stores the codes of every entity under all of
them. Each optimizer step is then one scan for all inner fits (every fold,
representation, scaling and penalty), and so is scoring them; the same for the outer
fits. Entities come as dense vectors or as sparse counts; counts are carried once,
over the features that any fold selects, and every fold reads its own from them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from probeloom.functions.arrow import small_batches, stored_vector, to_lists, to_matrix
from probeloom.functions.scalars import LAMBDAS, TARGET_SUM, VARIANCE_FLOOR
from probeloom.operators import atoms, checks, comparison, dictionary, features, groups, metrics, probe
from probeloom.operators.checks import CheckFailed, assert_empty
from probeloom.operators.coding import lasso_rows
from probeloom.operators.dictionary import Fitted, Setting
from probeloom.operators.joint_probe import GRADIENT_TOLERANCE, View, Wanted, fit_together, score_together
from probeloom.operators.probe import Probe
from probeloom.session import bounded_rows, materialize, settle
from probeloom.sources.digests import checksum
from probeloom.sources.writers import exists, write_table

MINIMUM_SEEDS = 3
SCALINGS = ("standard", "none")
KEYS = "outer_grp string, inner_grp string, method string, seed long, scaling string, `lambda` double"
FIT_SCHEMA = (
    KEYS + ", C double, n_train long, n_hold long, converged boolean, "
    "macro_f1 double, accuracy double, balanced_accuracy double, log_loss double"
)


@dataclass
class Fold:
    """Training groups are all but ``excluded``; ``hold`` is scored."""

    outer: str
    inner: str | None
    mean: np.ndarray
    scale: np.ndarray
    columns: np.ndarray | None
    n_train: int

    @property
    def excluded(self) -> tuple[str, ...]:
        return (self.outer,) if self.inner is None else (self.outer, self.inner)

    @property
    def hold(self) -> str:
        return self.outer if self.inner is None else self.inner

    @property
    def name(self) -> str:
        return f"{self.outer}/{self.inner or ''}"


@dataclass
class Representation:
    """Which of an entity's stored values are probe input in one fold."""

    fold: Fold
    method: str
    seed: int
    setting: Setting | None = None       # None: take the ready-made embedding
    atoms: np.ndarray | None = None      # None: the standardized expression itself

    place: int = 0                       # first of its codes among the stored ones

    def input(self, opened: Opened, keep: np.ndarray) -> np.ndarray:
        if self.setting is None:
            return opened.emb[keep]
        if self.atoms is None:
            return self.setting.rows(opened.vec[keep])
        return opened.codes[keep, self.place:self.place + len(self.atoms)]


def make_folds(rows: DataFrame, variance_top: int | None = None) -> list[Fold]:
    """All (outer, inner) and outer folds with their training statistics.

    One scan gives count, mean and variance per group; a fold adds up the groups
    it trains on. ``variance_top`` selects coordinates by training variance in
    each fold; by default every coordinate is used (panel policy).
    """
    stats = bounded_rows(features.vector_moments(rows, ["grp"]), groups.MAX_GROUPS, "groups")
    by_group = {r["grp"]: (r["n"], np.array(r["mean"]), np.array(r["variance"])) for r in stats}
    names = sorted(by_group)
    if len(names) < groups.MINIMUM_GROUPS:
        raise ValueError(f"Need at least {groups.MINIMUM_GROUPS} groups for nested evaluation")
    folds = []
    for outer, inner in groups.nested_folds(names):
        parts = [by_group[g] for g in names if g not in (outer, inner)]
        n = sum(p[0] for p in parts)
        mean = sum(p[0] * p[1] for p in parts) / n
        variance = np.maximum(sum(p[0] * (p[2] + p[1] ** 2) for p in parts) / n - mean ** 2, 0)
        columns = None
        if variance_top is not None:
            ranked = np.lexsort((np.arange(len(variance)), -np.round(variance, features.RANK_DECIMALS)))
            columns = np.sort([c for c in ranked if variance[c] > VARIANCE_FLOOR][:variance_top])
            mean, variance = mean[columns], variance[columns]
        scale = np.sqrt(variance)
        folds.append(Fold(outer, inner, mean, np.where(scale < 1e-12, 1.0, scale), columns, n))
    return folds


@dataclass
class Opened:
    """A batch of stored rows, its columns turned into arrays when first asked for."""

    batch: pa.RecordBatch

    @cached_property
    def grp(self) -> np.ndarray:
        return np.array(self.batch.column("grp").to_pylist(), dtype=object)

    @cached_property
    def vec(self) -> np.ndarray:
        return to_matrix(self.batch.column("vec"))

    @cached_property
    def emb(self) -> np.ndarray:
        return to_matrix(self.batch.column("emb"))

    @cached_property
    def codes(self) -> np.ndarray:
        return to_matrix(self.batch.column("codes"))


def _view(rep: Representation, hold: bool) -> View:
    """The held-out rows of a representation's fold, or those it trains on."""

    def rows(opened: Opened) -> tuple[np.ndarray, np.ndarray]:
        inside = opened.grp == rep.fold.hold if hold else ~np.isin(opened.grp, rep.fold.excluded)
        keep = np.flatnonzero(inside)
        return keep, rep.input(opened, keep)

    return View(rows)


def _task_rows(rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    emb = F.col("emb") if "emb" in rows.columns else F.array()
    number = (F.array_position(metrics.class_list(classes), F.col("label")) - 1).cast("int")
    return rows.select("entity_id", "label", F.col("grp").cast("string").alias("grp"), number.alias("y"),
                       stored_vector(rows).alias("vec"), emb.cast("array<double>").alias("emb"))


def place_codes(reps: Sequence[Representation]) -> None:
    """Number the codes of all dictionaries through."""
    at = 0
    for r in reps:
        if r.atoms is not None:
            r.place, at = at, at + len(r.atoms)


def with_codes(rows: DataFrame, reps: Sequence[Representation]) -> DataFrame:
    """Rows plus ``codes``: those of all dictionaries side by side, from one scan."""
    coded = [r for r in reps if r.atoms is not None]
    schema = StructType([*rows.schema.fields, StructField("codes", ArrayType(DoubleType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = to_matrix(batch.column("vec"))
            z = np.hstack([lasso_rows(r.setting.rows(x), r.atoms, r.setting.alpha) for r in coded])
            yield pa.RecordBatch.from_arrays([*batch.columns, to_lists(z)], names=[*batch.schema.names, "codes"])

    return rows.mapInArrow(encode, schema)


def predict_folds(rows: DataFrame, blocks: Sequence[tuple[Representation, Sequence[tuple[str, Probe]]]]) -> DataFrame:
    """Held-out predictions of every (representation, scaling), from one scan."""
    schema = (
        "entity_id string, label string, grp string, method string, seed long, scaling string, "
        "prediction string, probs array<double>"
    )
    views = [_view(rep, True) for rep, _ in blocks]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            opened = Opened(batch)
            for view, (rep, models) in zip(views, blocks):
                at, x = view.rows(opened)
                if not len(at):
                    continue
                mine, n = batch.take(pa.array(at)), len(at)
                for scaling, m in models:
                    p = probe.probabilities(m, x)
                    yield pa.RecordBatch.from_arrays(
                        [mine.column(0), mine.column(1), mine.column(2), pa.array([rep.method] * n),
                         pa.array(np.full(n, rep.seed, np.int64)), pa.array([scaling] * n),
                         pa.array([m.classes[c] for c in p.argmax(axis=1)]), to_lists(p)],
                        names=["entity_id", "label", "grp", "method", "seed", "scaling", "prediction", "probs"],
                    )

    return rows.mapInArrow(predict, schema)


Fits = list[tuple[Representation, list[tuple[str, float]], list[Probe]]]


def _fit_all(rows: DataFrame, todo: Sequence[tuple[Representation, Sequence[tuple[str, float]]]], classes: list[str],
             tolerance: float) -> Fits:
    """All (scaling, lambda) fits of all representations, every step one scan."""
    views = [_view(rep, False) for rep, _ in todo]
    wanted = [Wanted(v, lam, scaling) for v, (_, grid) in enumerate(todo) for scaling, lam in grid]
    models = iter(fit_together(rows, views, wanted, classes, tolerance, open_=Opened))
    return [(rep, list(grid), [next(models) for _ in grid]) for rep, grid in todo]


def _fit_rows(rows: DataFrame, fitted: Fits, classes: Sequence[str]) -> list[tuple]:
    """One FIT_SCHEMA row per model, scored on the groups held out."""
    views = [_view(rep, True) for rep, _, _ in fitted]
    table = score_together(rows, views, [(v, m) for v, (_, _, models) in enumerate(fitted) for m in models], open_=Opened)
    found = {r["model"]: r for r in metrics.scalar_metrics(table, ["model"], classes).collect()}
    flat = [(rep, scaling, lam, m) for rep, wanted, models in fitted for (scaling, lam), m in zip(wanted, models)]
    return [
        (rep.fold.outer, rep.fold.inner, rep.method, rep.seed, scaling, lam, m.C, rep.fold.n_train, found[i]["n_rows"],
         m.converged, *[found[i][k] for k in metrics.METRICS])
        for i, (rep, scaling, lam, m) in enumerate(flat)
    ]


def _representations(folds: Sequence[Fold], fits: dict[tuple[str, int], Fitted], seeds: Sequence[int],
                     alpha: float, with_embedding: bool) -> list[Representation]:
    out = []
    for f in folds:
        plain = Setting(f.name, 0, alpha, excluded=f.excluded, mean=f.mean, scale=f.scale, columns=f.columns)
        out.append(Representation(f, "expression", -1, plain))
        if with_embedding:
            out.append(Representation(f, "embedding", -1))
        for s in seeds:
            fit = fits[f.name, s]
            out.append(Representation(f, "dictionary", s, fit.setting, fit.atoms))
    return out


def _stability(rows: DataFrame, reps: Sequence[Representation]) -> DataFrame:
    """Matched atoms of every seed pair in every outer fold: one scan for all code products."""
    coded = [r for r in reps if r.atoms is not None and r.fold.inner is None]
    parts = F.array(*[
        F.struct(F.lit(f.outer).alias("key"), F.concat(*[
            F.slice("codes", r.place + 1, len(r.atoms)) for r in coded if r.fold is f
        ]).alias("z"))
        for f in {id(r.fold): r.fold for r in coded}.values()
    ])
    # An entity counts in the folds that train on it: all but that of its own group.
    opened = rows.select(F.inline(F.filter(parts, lambda p: p["key"] != F.col("grp"))))
    fits = {(r.fold.outer, r.seed): Fitted(r.setting, r.atoms) for r in coded}
    return atoms.match_seeds(opened, {key: fit.atoms for key, fit in fits.items()})


LOG_SCHEMA = "stage string, path string, checksum string, study string"


class StageLog:
    """Finished stages of a study below ``path``.

    A stage is a table in a folder of its own name and draw; it is finished once its row, with the
    digest of the table, stands in the log. What a stopped run left without a row is neither
    used nor in the way. Without a path every stage is a work table.
    """

    def __init__(self, spark: SparkSession, path: str | None, study: str = ""):
        self.spark, self.path, self.study = spark, path, study
        self.rows = {}
        if path and exists(spark, f"{path}/log"):
            found = bounded_rows(spark.read.schema(LOG_SCHEMA).parquet(f"{path}/log"), 1000, "stages")
            self.rows = {r["stage"]: r for r in found}
            if any(r["study"] != study for r in found):
                raise CheckFailed(f"{path} holds a study of other inputs or settings")

    def table(self, stage: str, make: Callable[[], DataFrame], partition_by: str | None = None) -> DataFrame:
        """The stored table of a finished stage, unchanged since, or what ``make`` gives, stored."""
        if not self.path:
            return materialize(make(), stage, partition_by)
        if stage in self.rows:
            return stored_stage(self.spark, self.rows[stage])
        folder = f"{self.path}/{stage}-{uuid.uuid4().hex}"
        stored = write_table(make(), folder, partition_by)
        row = (stage, folder, checksum(stored), self.study)
        self.spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return stored


def stored_stage(spark: SparkSession, row) -> DataFrame:
    stored = spark.read.parquet(row["path"])
    if checksum(stored) != row["checksum"]:
        raise CheckFailed(f"{row['path']}: not the table of the finished stage {row['stage']}")
    return stored


STAGES = ("rows", "dictionaries", "diagnostics", "codes", "inner", "models", "outer", "predictions", "matches")


def load_study(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a complete stored study; every file must be as its stage left it."""
    rows = {r["stage"]: r for r in bounded_rows(spark.read.schema(LOG_SCHEMA).parquet(f"{path}/log"), 1000, "stages")}
    missing = [s for s in STAGES if s not in rows]
    if missing:
        raise CheckFailed(f"{path}: the study has not finished; missing {missing}")
    return _result({s: stored_stage(spark, rows[s]) for s in STAGES})


def _result(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "inner": t["inner"],
        "chosen": comparison.best_lambda(t["inner"], ["outer_grp", "method", "scaling"]),
        "outer": t["outer"].drop("inner_grp").withColumnRenamed("outer_grp", "grp"),
        "models": t["models"],
        "predictions": t["predictions"],
        "diagnostics": t["diagnostics"],
        "matches": t["matches"],
        "stability": atoms.stability(t["matches"], ["grp", "seed_a", "seed_b"]),
        "cohort": t["codes"].select("entity_id", "label", "grp"),
    }


FITTED_SCHEMA = "fit int, atom int, weights array<double>, epochs_run int, steps int"
MODEL_SCHEMA = (
    "outer_grp string, method string, seed long, scaling string, `lambda` double, trained_on array<string>, C double, "
    "iterations int, converged boolean, gradient double, classes array<string>, weights array<array<double>>, intercept array<double>"
)


def _fitted_table(spark: SparkSession, fits: Sequence[Fitted]) -> DataFrame:
    return spark.createDataFrame(
        [(i, k, w.tolist(), f.epochs_run, f.steps) for i, f in enumerate(fits) for k, w in enumerate(f.atoms)], FITTED_SCHEMA)


def _read_fitted(table: DataFrame, settings: Sequence[Setting]) -> list[Fitted]:
    by_fit: dict[int, list] = {}
    for r in bounded_rows(table, sum(s.atoms for s in settings), "atoms"):
        by_fit.setdefault(r["fit"], []).append(r)
    own = [sorted(by_fit[i], key=lambda r: r["atom"]) for i in range(len(settings))]
    return [Fitted(s, np.array([r["weights"] for r in rows]), rows[0]["epochs_run"], rows[0]["steps"]) for s, rows in zip(settings, own)]


def _model_table(spark: SparkSession, outer: Fits, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([
        (rep.fold.outer, rep.method, rep.seed, scaling, lam, [g for g in names if g not in rep.fold.excluded], m.C, m.iterations, m.converged,
         m.gradient, m.classes, m.coef.tolist(), m.intercept.tolist())
        for rep, wanted, models in outer for (scaling, lam), m in zip(wanted, models)
    ], MODEL_SCHEMA)


def _read_models(table: DataFrame, reps: Sequence[Representation]) -> Fits:
    found = {(r["outer_grp"], r["method"], r["seed"], r["scaling"]): r for r in bounded_rows(table, len(reps) * len(SCALINGS), "models")}
    out = []
    for rep in reps:
        rows = [found[rep.fold.outer, rep.method, rep.seed, s] for s in SCALINGS]
        out.append((rep, [(r["scaling"], r["lambda"]) for r in rows], [
            Probe(list(r["classes"]), np.array(r["weights"]), np.array(r["intercept"]), r["C"], r["iterations"], r["converged"], r["gradient"])
            for r in rows
        ]))
    return out


@dataclass
class Inputs:
    """What a study starts from: rows (entity_id, label, grp, vec, emb perhaps) and its folds."""

    rows: DataFrame
    folds: list[Fold]


def from_vectors(rows: DataFrame, variance_top: int | None = None) -> Inputs:
    return Inputs(rows, make_folds(rows, variance_top))


def from_counts(counts: DataFrame, entities: DataFrame, policy: str = "variance", n_features: int = 2000,
                panel: DataFrame | None = None, target: float = TARGET_SUM) -> Inputs:
    """Folds fitted on counts (entity_id, feature_id, cnt, perhaps total), and entities as sparse log rates.

    ``entities``: entity_id, label, grp and perhaps emb. With policy ``variance`` every
    fold selects its ``n_features`` features of largest training variance; with ``panel``
    all folds use the ordered ``panel`` (feature_id, out_pos), constant and absent
    features included. Statistics of a fold never see the groups it leaves out: one
    scan sums per group and feature, exactly, and a fold takes off what it may not see.
    """
    if policy not in ("variance", "panel") or (policy == "panel") != (panel is not None):
        raise ValueError("policy 'variance', or 'panel' with a panel")
    sizes = groups.group_sizes(entities)
    if len(sizes) < groups.MINIMUM_GROUPS:
        raise ValueError(f"Need at least {groups.MINIMUM_GROUPS} groups for nested evaluation")
    nested = groups.nested_folds(sorted(sizes))
    left_out = sorted({tuple(sorted({o, i} - {None})) for o, i in nested})
    log_counts = features.normalize_log(counts, target).select("entity_id", "feature_id", "x")
    known = log_counts.join(entities.select("entity_id", "grp"), "entity_id")
    if panel is not None:
        panel = settle(panel.select("feature_id", "out_pos"))
        known = known.join(panel.select("feature_id"), "feature_id", "left_semi")
    stats = features.excluded_moments(known, sizes, left_out)
    if panel is None:
        chosen = features.select_per_fold(stats, n_features, "fold").select("fold", "feature_id", "out_pos", "mean", "variance")
        limit = n_features
    else:
        limit = panel.count()
        folds = F.explode(F.sequence(F.lit(0), F.lit(len(left_out) - 1))).alias("fold")
        chosen = panel.select(folds, "*").join(stats, ["fold", "feature_id"], "left").select(
            "fold", "feature_id", "out_pos", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("variance", F.lit(0.0)).alias("variance"))
    picked = bounded_rows(chosen, limit * len(left_out), "features of the folds")
    names = sorted({r["feature_id"] for r in picked})
    pos = {f: i for i, f in enumerate(names)}
    by_fold: dict[int, list] = {}
    for r in sorted(picked, key=lambda r: (r["fold"], r["out_pos"])):
        by_fold.setdefault(r["fold"], []).append(r)
    fitted = {}
    for i, left in enumerate(left_out):
        own = by_fold.get(i, [])
        if not own:
            raise CheckFailed(f"no variable feature outside {left}")
        scale = np.sqrt([r["variance"] for r in own])
        fitted[left] = (np.array([pos[r["feature_id"]] for r in own]), np.array([r["mean"] for r in own]), np.where(scale < VARIANCE_FLOOR, 1.0, scale))
    n_all = sum(sizes.values())
    folds = []
    for outer, inner in nested:
        left = tuple(sorted({outer, inner} - {None}))
        columns, mean, scale = fitted[left]
        folds.append(Fold(outer, inner, mean, scale, columns, n_all - sum(sizes[g] for g in left)))
    places = settle(entities.sparkSession.createDataFrame(list(pos.items()), "feature_id string, pos int"), max_rows=len(pos))
    return Inputs(features.sparse_vectors(log_counts, entities, places, len(pos)), folds)


def nested_study(inputs: Inputs | DataFrame, seeds: Sequence[int] = (0, 1, 2), n_atoms: int = 64, alpha: float = 2.0,
                 epochs: int = 10, lambdas: Sequence[float] = LAMBDAS, batches: int = 4,
                 variance_top: int | None = None, path: str | None = None, tolerance: float = GRADIENT_TOLERANCE) -> dict[str, DataFrame]:
    """Run the study on rows with entity_id, label, grp, vec and optionally emb, or on :func:`from_counts`.

    Inner folds choose a penalty per method and scaling; outer folds refit with
    it and are scored once. Returns inner and outer fits, chosen penalties, outer
    models and predictions, dictionary diagnostics, atom matches and stability. With
    ``path`` every stage is kept there with its digest: a run that was stopped goes on
    after its last finished stage, and :func:`load_study` gives the tables again.
    """
    if len(set(seeds)) != len(seeds) or len(seeds) < MINIMUM_SEEDS:
        raise ValueError(f"{MINIMUM_SEEDS} unique seeds at least")
    if min(n_atoms, epochs) < 1 or alpha <= 0:
        raise ValueError("dictionary settings must be positive")
    if not lambdas or len(set(lambdas)) != len(lambdas) or min(lambdas) <= 0:
        raise ValueError("penalties must be unique and positive")
    if isinstance(inputs, DataFrame):
        inputs = from_vectors(inputs, variance_top)
    spark, folds = inputs.rows.sparkSession, inputs.folds
    log = StageLog(spark, path, path and _study_key(inputs, seeds, n_atoms, alpha, epochs, lambdas, batches, tolerance))
    # Written once: every later scan reads this copy, whatever it took to make the rows.
    rows = log.table("rows", lambda: dictionary.batched(inputs.rows, batches), "batch")
    assert_empty(checks.coverage_gaps(rows, "grp", "label"), "labels missing from a group")
    classes = probe.classes_of(rows)
    settings = [
        Setting(f"{f.name}#{s}", n_atoms, alpha, s, epochs, f.excluded, f.mean, f.scale, f.columns)
        for f in folds for s in seeds
    ]
    fitted = _read_fitted(log.table("dictionaries", lambda: _fitted_table(
        spark, dictionary.fit_dictionaries(rows, settings, batches, stored=rows))), settings)
    turns = [(f, s) for f in folds for s in seeds]
    diagnostics = log.table("diagnostics", lambda: spark.createDataFrame([
        dict(c, outer_grp=f.outer, inner_grp=f.inner)
        for c, (f, _) in zip(dictionary.diagnostics(rows, fitted, [(f.hold,) for f, _ in turns]), turns)
    ], DIAGNOSTICS))
    reps = _representations(folds, {(f.name, s): fit for (f, s), fit in zip(turns, fitted)}, seeds, alpha, "emb" in rows.columns)
    place_codes(reps)
    stored = log.table("codes", lambda: with_codes(_task_rows(rows, classes), reps))
    inner_reps, outer_reps = ([r for r in reps if (r.fold.inner is None) == last] for last in (False, True))
    grid = [(s, lam) for s in SCALINGS for lam in lambdas]
    kept = probe.persisted(stored)
    try:
        inner = log.table("inner", lambda: spark.createDataFrame(
            _fit_rows(kept, _fit_all(kept, [(r, grid) for r in inner_reps], classes, tolerance), classes), FIT_SCHEMA))
        chosen = comparison.best_lambda(inner, ["outer_grp", "method", "scaling"])
        picks = {(r["outer_grp"], r["method"], r["scaling"]): r["lambda"] for r in chosen.collect()}
        missing = [(r.fold.outer, r.method, s) for r in outer_reps for s in SCALINGS if (r.fold.outer, r.method, s) not in picks]
        if missing:
            raise CheckFailed(f"no penalty converged in every inner fit of {missing[:5]}")
        models = log.table("models", lambda: _model_table(spark, _fit_all(
            kept, [(r, [(s, picks[r.fold.outer, r.method, s]) for s in SCALINGS]) for r in outer_reps], classes, tolerance), sorted({f.outer for f in folds})))
        outer = _read_models(models, outer_reps)
        if not all(m.converged for _, _, own in outer for m in own):
            raise CheckFailed("an outer probe did not converge")
        scores = log.table("outer", lambda: spark.createDataFrame(_fit_rows(kept, outer, classes), FIT_SCHEMA))
        predictions = log.table("predictions", lambda: predict_folds(
            kept, [(r, list(zip([s for s, _ in wanted], own))) for r, wanted, own in outer]))
        matches = log.table("matches", lambda: _stability(stored, reps))
    finally:
        kept.unpersist()
    return _result({"inner": inner, "models": models, "outer": scores, "predictions": predictions, "diagnostics": diagnostics,
                    "matches": matches, "codes": stored})


DIAGNOSTICS = (
    "name string, atoms int, alpha double, seed long, epochs_run int, steps int, reached_epoch_budget boolean, gram_min_eigenvalue double, "
    "projected_gradient_norm double, objective_per_row double, train_mse double, zero_reconstruction_mse double, relative_mse double, "
    "train_active_fraction double, train_max_kkt double, max_atom_norm double, hold_mse double, hold_active_fraction double, "
    "hold_max_kkt double, outer_grp string, inner_grp string"
)


def _study_key(inputs: Inputs, *settings) -> str:
    """Digest of everything that decides a study: its rows, folds and settings."""
    folds = [(f.outer, f.inner, f.n_train, f.mean.tolist(), f.scale.tolist(), None if f.columns is None else f.columns.tolist()) for f in inputs.folds]
    text = json.dumps([checksum(inputs.rows), folds, [list(s) if isinstance(s, (tuple, list)) else s for s in settings]])
    return hashlib.sha256(text.encode()).hexdigest()


def audit_study(study: dict[str, DataFrame], classes: Sequence[str]) -> DataFrame:
    """Check stored predictions against the cohort and the stored metrics; one summary row."""
    predictions, cohort = study["predictions"], study["cohort"]
    assert_empty(checks.probability_violations(predictions), "probability rows")
    runs = ["method", "seed", "scaling"]
    n_runs = predictions.select(*runs).distinct().count()
    seen = predictions.groupBy("entity_id", "label", "grp").agg(F.count(F.lit(1)).alias("n"))
    assert_empty(checks.cohort_differences(seen, cohort, ("entity_id", "label", "grp")), "prediction cohort")
    assert_empty(seen.filter(F.col("n") != n_runs), "entities not predicted once per run")
    keys = ["grp", *runs]
    again = metrics.scalar_metrics(metrics.confusion(predictions, classes, keys), keys, classes)
    assert_empty(checks.metric_differences(study["outer"], again, keys, metrics.METRICS), "recomputed metrics")
    n_groups = cohort.select("grp").distinct().count()
    leaks = study["models"].filter(F.array_contains("trained_on", F.col("outer_grp")) | (F.size("trained_on") != n_groups - 1))
    assert_empty(leaks, "models that saw the group they were held against, or not all others")
    d = study["diagnostics"]
    return d.agg(
        F.count(F.lit(1)).alias("dictionary_fits"),
        F.count_if("reached_epoch_budget").alias("reached_epoch_budget"),
        F.greatest(F.max("train_max_kkt"), F.max("hold_max_kkt")).alias("max_coding_kkt_residual"),
        F.min("gram_min_eigenvalue").alias("min_gram_eigenvalue"),
        F.min("projected_gradient_norm").alias("min_projected_gradient"),
        F.max("projected_gradient_norm").alias("max_projected_gradient"),
    ).select(
        F.lit("PASS").alias("status"), F.lit(study["outer"].count()).alias("verified_outer_fits"),
        F.lit(study["inner"].count()).alias("inner_fits"),
        F.lit(n_groups).alias("n_groups"), "*",
    )


def summarize_study(study: dict[str, DataFrame], base: str = "expression",
                    others: Sequence[str] = ("dictionary", "embedding")) -> dict[str, DataFrame]:
    outer = study["outer"]
    return {
        "group_means": comparison.group_means(outer),
        "summary": comparison.two_level_summary(outer),
        "seed_variation": comparison.seed_variation(outer),
        "paired": comparison.paired_differences(outer, base, others),
        "stability_by_group": study["stability"].groupBy("grp").agg(*[
            F.avg(c).alias(c) for c in ("mean_abs_cosine", "median_abs_cosine", "mean_top_feature_jaccard", "mean_code_correlation")
        ]),
    }
