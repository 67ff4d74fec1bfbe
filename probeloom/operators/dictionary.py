"""Dictionary fitting by online alternating minimization on Spark.

Each step encodes one batch of rows against the current atoms and returns two
sums of model size, Z'Z and Z'X. Spark adds the partial sums of all tasks; the
driver keeps running averages of them and updates the atoms (projected block
coordinate descent, atoms inside the unit ball). Batches are hash buckets of
the entity ID, stored as Parquet partitions, so a step reads only its bucket.
Several dictionaries over the same rows share every scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.functions import vectors as V
from probeloom.functions.arrow import dense_vector, small_batches, stored_vector, to_lists, to_matrix
from probeloom.functions.scalars import order_key
from probeloom.operators.checks import CheckFailed
from probeloom.operators.coding import kkt_rows, lasso_many, lasso_rows
from probeloom.session import bounded_rows, bounded_sums, materialize

MAX_ATOMS = 4096
ATOM_LIMIT = 1.00001
CHANGE_TOLERANCE = 1e-3
PATIENCE = 10
# Codes of a step are used once, for its sums; those of certificates are exact.
STEP_TOLERANCE = 1e-4


@dataclass
class Setting:
    """One dictionary to fit. ``excluded`` names groups held out of training;
    ``columns``, ``mean`` and ``scale`` select and standardize stored rows on the fly."""

    name: str
    atoms: int
    alpha: float
    seed: int = 42
    epochs: int = 10
    excluded: tuple[str, ...] = ()
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    columns: np.ndarray | None = None
    start: str = "rows"                  # or "svd": leading right singular vectors of the training rows

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x if self.columns is None else x[:, self.columns]
        return x if self.mean is None else (x - self.mean) / self.scale


@dataclass
class Fitted:
    setting: Setting
    atoms: np.ndarray
    epochs_run: int = 0
    steps: int = 0
    objective: list[float] = field(default_factory=list)


OVERSAMPLING, POWER_SCANS = 10, 4


def leading_directions(vectors: DataFrame, settings: Sequence[Setting], power: int = POWER_SCANS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Leading singular values and unit right singular vectors of the rows of each setting.

    Randomized range finder: a seeded block of ``atoms`` + OVERSAMPLING directions goes
    through X'X once per scan and is made orthogonal between scans; from the last block the
    small matrix Q'X'XQ gives the values. Tasks return a block of model size per setting, all
    settings share every scan, and X'X itself is never formed. The sign of a vector is
    that of its entry of largest size. ``power`` scans follow the first one.
    """
    rows = vectors.select(stored_vector(vectors).alias("vec"), F.col("grp").cast("string").alias("grp"))
    blocks: list[np.ndarray | None] = [None] * len(settings)

    def product(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in small_batches(batches):
            stored = to_matrix(batch.column("vec"))
            grp = np.array(batch.column("grp").to_pylist(), dtype=object)
            for i, s in enumerate(settings):
                x = s.rows(stored[~np.isin(grp, s.excluded)] if s.excluded else stored)
                if not len(x):
                    continue
                q = blocks[i] if blocks[i] is not None else np.random.default_rng(s.seed).normal(
                    size=(x.shape[1], min(s.atoms + OVERSAMPLING, x.shape[1])))
                part = (x @ q).T @ x
                totals[i] = part if i not in totals else totals[i] + part
        for i, part in totals.items():
            keys = np.arange(starts[i], starts[i] + len(part), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys), to_lists(part)], names=["key", "v"])

    starts = np.cumsum([0, *(s.atoms + OVERSAMPLING for s in settings)])
    out: list = [None] * len(settings)
    for _ in range(power + 1):
        summed = rows.mapInArrow(product, "key int, v array<double>").groupBy("key").agg(
            vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
        found = bounded_sums(summed, int(starts[-1]), "directions")
        for i, s in enumerate(settings):
            b = np.array([found[k] for k in range(int(starts[i]), int(starts[i + 1])) if k in found])
            if not len(b):
                raise ValueError(f"{s.name}: no rows outside the groups it may not see")
            if blocks[i] is not None:
                roots, turn = np.linalg.eigh(blocks[i].T @ b.T)
                order = np.argsort(-roots)[:s.atoms]
                v = (blocks[i] @ turn[:, order]).T
                v *= np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
                out[i] = np.sqrt(np.maximum(roots[order], 0)), v
            blocks[i] = np.linalg.qr(b.T)[0]
    return out


def first_atoms(vectors: DataFrame, settings: Sequence[Setting]) -> list[np.ndarray]:
    """Starting atoms of every setting by its kind of start; directions that rows lack are zero atoms."""
    out: dict[int, np.ndarray] = {}
    for kind, make in (("rows", initial_atoms), ("svd", lambda v, s: [d for _, d in leading_directions(v, s)])):
        own = [i for i, s in enumerate(settings) if s.start == kind]
        if own:
            out |= dict(zip(own, make(vectors, [settings[i] for i in own])))
    if len(out) != len(settings):
        raise ValueError("a dictionary starts from 'rows' or 'svd'")
    return [np.vstack([d, np.zeros((s.atoms - len(d), d.shape[1]))]) for s, d in zip(settings, (out[i] for i in range(len(settings))))]


def initial_atoms(vectors: DataFrame, settings: Sequence[Setting]) -> list[np.ndarray]:
    """Normalized non-zero training rows of each setting, drawn in its seeded hash order.

    A scan per seed takes the first few rows of the order; each setting drops
    the groups it may not see and rows that are zero once standardized. Settings
    still short of rows repeat the scan for four times as many.
    """
    out: dict[int, np.ndarray] = {}
    for seed in sorted({s.seed for s in settings}):
        open_ = [i for i, s in enumerate(settings) if s.seed == seed]
        keyed = vectors.select(
            order_key(seed, F.col("entity_id")).alias("k"), F.col("entity_id").cast("string").alias("entity_id"),
            F.col("grp").cast("string").alias("grp"), stored_vector(vectors).alias("vec"),
        )
        wanted = 4 * max(settings[i].atoms for i in open_)
        while open_:
            rows = bounded_rows(keyed.orderBy("k", "entity_id").limit(wanted), wanted, "initial atoms")
            rows.sort(key=lambda r: (r["k"], r["entity_id"]))
            for i in list(open_):
                s = settings[i]
                allowed = [dense_vector(r["vec"]) for r in rows if r["grp"] not in s.excluded]
                x = s.rows(np.array(allowed)) if allowed else np.zeros((0, 1))
                x = x[np.linalg.norm(x, axis=1) > 1e-12][:s.atoms]
                if len(x) == s.atoms:
                    out[i] = x / np.linalg.norm(x, axis=1, keepdims=True)
                    open_.remove(i)
            if open_ and len(rows) < wanted:
                raise ValueError(f"{len(rows)} rows in reach, too few of them usable as first atoms")
            wanted *= 4
    return [out[i] for i in range(len(settings))]


def _exact_codes(models: Sequence[tuple[Setting, np.ndarray]], inputs: Sequence[np.ndarray]) -> list[np.ndarray]:
    return [lasso_rows(x, d, setting.alpha) if len(x) else np.zeros((0, len(d))) for (setting, d), x in zip(models, inputs)]


def _quick_codes(models: Sequence[tuple[Setting, np.ndarray]], inputs: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Codes for one step: dictionaries of one size are swept together."""
    out: list[np.ndarray] = [None] * len(models)
    for k in {len(d) for _, d in models}:
        own = [i for i, (_, d) in enumerate(models) if len(d) == k]
        grams = np.array([models[i][1] @ models[i][1].T for i in own])
        owner = np.repeat(np.arange(len(own)), [len(inputs[i]) for i in own])
        b = np.vstack([inputs[i] @ models[i][1].T if len(inputs[i]) else np.zeros((0, k)) for i in own])
        z = lasso_many(b, grams, owner, np.array([models[i][0].alpha for i in own]), STEP_TOLERANCE)
        for i, part in zip(own, np.split(z, np.cumsum([len(inputs[i]) for i in own])[:-1])):
            out[i] = part
    return out


def _sums(models: Sequence[tuple[Setting, np.ndarray]], certify: bool):
    """Task function: partial Z'Z | Z'X | scalars per atom, atoms numbered through the models, and the largest residual."""
    starts = np.cumsum([0, *(len(d) for _, d in models)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        worst = [0.0] * len(models)
        for batch in small_batches(batches):
            stored = to_matrix(batch.column("vec"))
            grp = np.array(batch.column("grp").to_pylist(), dtype=object)
            inputs = []
            for setting, _ in models:
                keep = ~np.isin(grp, setting.excluded) if setting.excluded else slice(None)
                inputs.append(setting.rows(stored[keep]))
            codes = _exact_codes(models, inputs) if certify else _quick_codes(models, inputs)
            for i, ((setting, d), x, z) in enumerate(zip(models, inputs, codes)):
                if not len(x):
                    continue
                rest = x - z @ d
                scalars = np.zeros((len(d), 5))
                scalars[0] = [
                    len(x), 0.5 * (rest ** 2).sum() + setting.alpha * np.abs(z).sum(),
                    (rest ** 2).sum(), (x ** 2).sum(), (np.abs(z) > 1e-6).sum(),
                ]
                if certify:
                    worst[i] = max(worst[i], float(kkt_rows(x, z, d, setting.alpha).max()))
                part = np.hstack([z.T @ z, z.T @ x, scalars])
                totals[i] = part if i not in totals else totals[i] + part
        for i, part in totals.items():
            k = len(part)
            keys = np.arange(starts[i], starts[i] + k, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys), to_lists(part), pa.array(np.full(k, worst[i]))], names=["key", "v", "kkt"])

    return run


def sufficient_sums(rows: DataFrame, models: Sequence[tuple[Setting, np.ndarray]],
                    certify: bool = False) -> list[dict | None]:
    """Z'Z, Z'X and totals over ``rows`` (vec, grp), for every dictionary in one scan."""
    partial = rows.select(stored_vector(rows).alias("vec"), F.col("grp").cast("string").alias("grp"))
    partial = partial.mapInArrow(_sums(models, certify), "key int, v array<double>, kkt double")
    merged = partial.groupBy("key").agg(
        vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"), F.max("kkt").alias("kkt")
    ).select("key", F.concat("v", F.array("kkt")).alias("v"))
    starts = np.cumsum([0, *(len(d) for _, d in models)])
    found = bounded_sums(merged, int(starts[-1]), "dictionary sums")
    out: list[dict | None] = []
    for i, (_, d) in enumerate(models):
        if int(starts[i]) not in found:
            out.append(None)
            continue
        m = np.array([found[int(starts[i]) + j] for j in range(len(d))])
        k, p = len(m), m.shape[1] - len(m) - 6
        n, objective, rss, xss, active = m[0, k + p:-1]
        out.append(dict(zz=m[:, :k], zx=m[:, k:k + p], n=n, objective=objective, rss=rss, xss=xss, active=active, kkt=float(m[:, -1].max())))
    return out


def update_atoms(d: np.ndarray, zz: np.ndarray, zx: np.ndarray) -> np.ndarray:
    """One pass of block coordinate descent over the atoms; unused atoms stay."""
    d = d.copy()
    for k in range(len(d)):
        if zz[k, k] <= 1e-12:
            continue
        u = d[k] + (zx[k] - zz[k] @ d) / zz[k, k]
        d[k] = u / max(1.0, float(np.linalg.norm(u)))
    return d


def bucketed(vectors: DataFrame, batches: int, batch_seed: int = 42) -> DataFrame:
    """The rows stored by hash bucket of their ID, so that a step reads only its bucket.

    All columns are kept; readers of the copy open the ones they need.
    """
    return materialize(batched(vectors, batches, batch_seed), "batches", partition_by="batch")


def batched(vectors: DataFrame, batches: int, batch_seed: int = 42) -> DataFrame:
    return vectors.withColumn(
        "batch", F.pmod(F.xxhash64(F.lit(batch_seed), F.col("entity_id").cast("string")), F.lit(batches)).cast("int")
    )


def guarded(fits: list[Fitted]) -> list[Fitted]:
    """The fits, if every atom is finite and inside the unit ball."""
    for f in fits:
        if not np.isfinite(f.atoms).all() or np.linalg.norm(f.atoms, axis=1).max() > ATOM_LIMIT:
            raise CheckFailed(f"{f.setting.name}: an atom is not finite or longer than {ATOM_LIMIT}")
    return fits


def fit_dictionaries(vectors: DataFrame, settings: Sequence[Setting], batches: int = 4,
                     batch_seed: int = 42, stored: DataFrame | None = None) -> list[Fitted]:
    """Fit all settings together; each step is one job over one bucket."""
    stored = bucketed(vectors, batches, batch_seed) if stored is None else stored
    fits = [Fitted(s, d) for s, d in zip(settings, first_atoms(stored, settings))]
    memory = [(np.zeros((s.atoms, s.atoms)), 0.0) for s in settings]
    best = [np.inf] * len(settings)
    stale, smooth = [0] * len(settings), [None] * len(settings)
    live = set(range(len(settings)))
    for epoch in range(max(s.epochs for s in settings)):
        live = {i for i in live if settings[i].epochs > epoch}
        for i in live:
            fits[i].epochs_run = epoch + 1
        for b in range(batches):
            todo = sorted(live)
            if not todo:
                return guarded(fits)
            sums = sufficient_sums(stored.filter(F.col("batch") == b), [(settings[i], fits[i].atoms) for i in todo])
            for i, s in zip(todo, sums):
                if s is None:
                    continue
                fit = fits[i]
                fit.steps += 1
                decay = (1.0 - 1.0 / fit.steps) ** 2
                zz, zx = memory[i]
                zz, zx = decay * zz + s["zz"], decay * zx + s["zx"]
                memory[i] = zz, zx
                before = fit.atoms
                fit.atoms = update_atoms(before, zz, zx)
                cost = s["objective"] / s["n"]
                fit.objective.append(cost)
                moved = np.linalg.norm(fit.atoms - before) / max(np.linalg.norm(before), 1e-300)
                weight = 2.0 / (batches + 1)
                smooth[i] = cost if smooth[i] is None else (1 - weight) * smooth[i] + weight * cost
                stale[i] = 0 if smooth[i] < best[i] else stale[i] + 1
                best[i] = min(best[i], smooth[i])
                if moved < CHANGE_TOLERANCE or stale[i] >= PATIENCE:
                    live.discard(i)
    return guarded(fits)


def diagnostics(vectors: DataFrame, fits: Sequence[Fitted],
                held: Sequence[tuple[str, ...]] | None = None) -> list[dict]:
    """Certificates of each dictionary, one scan for all of them.

    ``held`` names the held-out groups of each fit; their coding residual and
    error are then reported too, from a second scan.
    """
    found = sufficient_sums(vectors, [(f.setting, f.atoms) for f in fits], certify=True)
    out = []
    for fit, s in zip(fits, found):
        d, n = fit.atoms, s["n"]
        if not n:
            raise ValueError(f"{fit.setting.name}: no rows outside the groups it may not see")
        # A stationary dictionary is where moving against the mean gradient of the
        # sums and going back into the unit ball changes nothing.
        moved = d - (s["zz"] @ d - s["zx"]) / n
        length = np.linalg.norm(moved, axis=1, keepdims=True)
        shift = d - np.where(length > 1, moved / np.where(length > 0, length, 1), moved)
        out.append(dict(
            name=fit.setting.name, atoms=len(d), alpha=float(fit.setting.alpha), seed=fit.setting.seed,
            epochs_run=fit.epochs_run, steps=fit.steps,
            reached_epoch_budget=fit.epochs_run >= fit.setting.epochs,
            gram_min_eigenvalue=float(np.linalg.svd(d, compute_uv=False).min() ** 2 if len(d) <= d.shape[1] else 0.0),
            projected_gradient_norm=float(np.sqrt((shift ** 2).sum())),
            objective_per_row=float(s["objective"] / n),
            train_mse=float(s["rss"] / (n * d.shape[1])),
            zero_reconstruction_mse=float(s["xss"] / (n * d.shape[1])),
            relative_mse=float(s["rss"] / s["xss"]) if s["xss"] else None,
            train_active_fraction=float(s["active"] / (n * len(d))),
            train_max_kkt=float(s["kkt"]),
            max_atom_norm=float(np.linalg.norm(d, axis=1).max()),
        ))
    if held is not None:
        groups = sorted({g for names in held for g in names} | {g for f in fits for g in f.setting.excluded})
        known = [r[0] for r in bounded_rows(vectors.select(F.col("grp").cast("string")).distinct(), MAX_ATOMS, "groups")]
        turned = [
            (replace(f.setting, excluded=tuple(g for g in {*known, *groups} if g not in names)), f.atoms)
            for f, names in zip(fits, held)
        ]
        for row, s in zip(out, sufficient_sums(vectors, turned, certify=True)):
            row["hold_mse"] = float(s["rss"] / (s["n"] * s["zx"].shape[1]))
            row["hold_active_fraction"] = float(s["active"] / (s["n"] * row["atoms"]))
            row["hold_max_kkt"] = float(s["kkt"])
    return out


def atoms_table(spark, fits: Sequence[Fitted]) -> DataFrame:
    """dict_id, atom (1-based), weights."""
    rows = [(f.setting.name, k + 1, [float(v) for v in w]) for f in fits for k, w in enumerate(f.atoms)]
    return spark.createDataFrame(rows, "dict_id string, atom int, weights array<double>")
