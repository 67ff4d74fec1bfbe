"""Sparse codes of vectors against a frozen dictionary.

A code minimizes 0.5 * |x - zD|^2 + alpha * |z|_1 for its row. The dictionary
(atoms x coordinates) is of model size and travels with the task closure; rows
are independent, so encoding never shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeloom.functions import vectors as V
from probeloom.functions.arrow import task_function, to_lists, to_matrix

MAX_SWEEPS = 3000
CHANGE_TOLERANCE = 1e-10
# Atoms that nearly repeat each other leave a direction along which codes creep on.
# After so many sweeps a row stops when it is optimal to this residual (relative to
# alpha where that is above 1), and after twice as many it is solved by active sets.
PATIENT_SWEEPS, RESIDUAL_TOLERANCE = 200, 1e-8


def active_set_row(gram: np.ndarray, b: np.ndarray, alpha: float, z: np.ndarray, tol: float) -> np.ndarray | None:
    """Code of one row from a start: signs are guessed, the smooth problem they leave is solved,
    and the step stops at the best point where a coordinate changes sign. None if it does not settle."""
    z, theta = z.copy(), np.sign(z)
    for _ in range(50 * len(b)):
        g = gram @ z - b
        on = theta != 0
        if not on.any() or np.abs(g + alpha * theta)[on].max() <= tol:
            off = np.where(on, -np.inf, np.abs(g) - alpha)
            j = int(off.argmax())
            if off[j] <= tol:
                return z
            theta[j] = -np.sign(g[j])
        at = np.flatnonzero(theta)
        inner = gram[np.ix_(at, at)]
        old = z[at]
        step = np.linalg.lstsq(inner, b[at] - alpha * theta[at], rcond=1e-12)[0] - old
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = np.where(step != 0, -old / step, -1.0)
        points = np.append(cross[(cross > 0) & (cross < 1)], 1.0)
        tried = old + points[:, None] * step
        tried[np.abs(tried) <= 1e-15 * np.abs(step)] = 0.0
        cost = 0.5 * np.einsum("ij,jk,ik->i", tried, inner, tried) - tried @ b[at] + alpha * np.abs(tried).sum(axis=1)
        z[at] = tried[cost.argmin()]
        theta = np.sign(z)
    return None


def lasso_rows(x: np.ndarray, d: np.ndarray, alpha: float, max_sweeps: int = MAX_SWEEPS,
               tol: float = CHANGE_TOLERANCE) -> np.ndarray:
    """Cyclic coordinate descent for all rows of a batch at once.

    Rows that stopped moving, or moved long and are optimal, leave the working set.
    """
    gram, target = d @ d.T, x @ d.T
    codes = np.zeros_like(target)
    live = np.arange(len(x))
    for sweep in range(1, max_sweeps + 1):
        if not len(live):
            break
        z, b = codes[live], target[live]
        start = z.copy()
        for k in range(len(d)):
            if gram[k, k] <= 0:
                continue
            u = b[:, k] - z @ gram[:, k] + z[:, k] * gram[k, k]
            z[:, k] = np.sign(u) * np.maximum(np.abs(u) - alpha, 0.0) / gram[k, k]
        codes[live] = z
        moved = np.abs(z - start).max(axis=1)
        going = moved > tol * np.maximum(1.0, np.abs(z).max(axis=1))
        if sweep >= PATIENT_SWEEPS and sweep % 20 == 0:
            g = z @ gram - b
            residual = np.where(z != 0, np.abs(g + alpha * np.sign(z)), np.maximum(np.abs(g) - alpha, 0))
            going &= residual.max(axis=1) > RESIDUAL_TOLERANCE * max(1.0, alpha)
        live = live[going]
        if sweep == 2 * PATIENT_SWEEPS and len(live):
            solved = [active_set_row(gram, target[i], alpha, codes[i], RESIDUAL_TOLERANCE * max(1.0, alpha)) for i in live]
            for i, z in zip(live, solved):
                codes[i] = codes[i] if z is None else z
            live = live[[z is None for z in solved]]
    if len(live):
        raise ArithmeticError(f"{len(live)} codes still move after {max_sweeps} sweeps")
    return codes


def lasso_many(b: np.ndarray, grams: np.ndarray, owner: np.ndarray, alpha: np.ndarray, tol: float) -> np.ndarray:
    """Codes of rows under several dictionaries of one size, all in the same sweeps.

    ``b``: products of each row with the atoms of its dictionary ``owner``; ``grams``
    and ``alpha`` by dictionary. Without :func:`lasso_rows`' guarantee: it ends after
    PATIENT_SWEEPS, which serves the steps of a fit, whose codes are used once.
    """
    codes = np.zeros_like(b)
    live = np.flatnonzero(np.abs(b).max(axis=1) > alpha[owner])
    for _ in range(PATIENT_SWEEPS):
        if not len(live):
            break
        z, t, own, a = codes[live], b[live], owner[live], alpha[owner[live]]
        start = z.copy()
        for k in range(b.shape[1]):
            size = grams[own, k, k]
            u = t[:, k] - np.einsum("ij,ij->i", z, grams[:, k][own]) + z[:, k] * size
            z[:, k] = np.where(size > 0, np.sign(u) * np.maximum(np.abs(u) - a, 0.0) / np.where(size > 0, size, 1.0), z[:, k])
        codes[live] = z
        live = live[np.abs(z - start).max(axis=1) > tol * np.maximum(1.0, np.abs(z).max(axis=1))]
    return codes


def encoder(d: np.ndarray, alpha: float):
    """Column function vec -> code, run on Arrow batches."""

    @task_function("array<double>")
    def encode(vec: pa.Array) -> pa.Array:
        if not len(vec):
            return pa.array([], pa.list_(pa.float64()))
        return to_lists(lasso_rows(to_matrix(vec), d, alpha))

    return encode


def encode(vectors: DataFrame, d: np.ndarray, alpha: float, vec: str = "vec", out: str = "z") -> DataFrame:
    return vectors.withColumn(out, encoder(d, alpha)(F.col(vec).cast("array<double>")))


def native_code(vec: Column, d: np.ndarray, alpha: float, steps: int) -> Column:
    """The same code from a fixed number of proximal steps, as one JVM expression.

    For small dictionaries: both matrices become literals of the plan. Works on
    streaming DataFrames because it is stateless. Combine it with
    :func:`native_kkt`; the optimizer does not pull a task function out of a
    projection when its argument is this nested aggregate.
    """
    gram = d @ d.T
    bound = float(np.abs(gram).sum(axis=1).max())
    g = V.literal_matrix(gram)
    target = V.mat_vec(V.literal_matrix(d), vec)

    def step(state: Column, _i: Column) -> Column:
        moved = F.zip_with(
            F.zip_with(state["z"], F.zip_with(V.mat_vec(g, state["z"]), state["b"], lambda p, q: p - q),
                       lambda z, grad: z - grad / bound),
            state["b"],
            lambda u, _b: V.soft_threshold(u, alpha / bound),
        )
        return F.struct(moved.alias("z"), state["b"].alias("b"))

    first = F.struct(F.array_repeat(F.lit(0.0), len(d)).alias("z"), target.alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)["z"]


def kkt(d: np.ndarray, alpha: float):
    """Column function (vec, code) -> optimality residual per coordinate.

    A code is optimal where the correlation of the residual with each atom lies
    in alpha times the subgradient of |z|: one point beside zero, [-1, 1] at it.
    The residual is the distance from that interval.
    """

    @task_function("array<double>")
    def residual(vec: pa.Array, code: pa.Array) -> pa.Array:
        if not len(vec):
            return pa.array([], pa.list_(pa.float64()))
        return to_lists(kkt_rows(to_matrix(vec), to_matrix(code), d, alpha))

    return residual


def kkt_rows(x: np.ndarray, z: np.ndarray, d: np.ndarray, alpha: float) -> np.ndarray:
    correlation = (x - z @ d) @ d.T
    low, high = np.where(z > 0, alpha, -alpha), np.where(z < 0, -alpha, alpha)
    return np.maximum(np.maximum(low - correlation, correlation - high), 0.0)


def native_kkt(vec: Column, code: Column, d: np.ndarray, alpha: float) -> Column:
    """The residuals of :func:`kkt` as one JVM expression, for small dictionaries."""
    correlation = F.zip_with(
        V.mat_vec(V.literal_matrix(d), vec), V.mat_vec(V.literal_matrix(d @ d.T), code), lambda q, p: q - p
    )
    low = lambda z: F.when(z > 0, alpha).otherwise(-alpha)
    high = lambda z: F.when(z < 0, -alpha).otherwise(alpha)
    return F.zip_with(correlation, code, lambda c, z: F.greatest(low(z) - c, c - high(z), F.lit(0.0)))


def reconstruction(d: np.ndarray):
    """Column function (vec, code) -> [residual sum of squares, vector sum of squares]."""

    @task_function("array<double>")
    def errors(vec: pa.Array, code: pa.Array) -> pa.Array:
        if not len(vec):
            return pa.array([], pa.list_(pa.float64()))
        x, z = to_matrix(vec), to_matrix(code)
        return to_lists(np.column_stack([((x - z @ d) ** 2).sum(axis=1), (x ** 2).sum(axis=1)]))

    return errors


def reconstruction_metrics(codes: DataFrame, d: np.ndarray, keys=("split",), vec: str = "vec", z: str = "z") -> DataFrame:
    """Per key: mse, zero_reconstruction_mse, relative_mse, activity shares."""
    error = reconstruction(d)(F.col(vec).cast("array<double>"), F.col(z))
    return summed_errors(codes.select(*keys, F.col(z).alias("z"), error.alias("error")), d.shape[1], d.shape[0], keys)


def summed_errors(codes: DataFrame, p: int, k: int, keys=("split",)) -> DataFrame:
    """The metrics from codes that carry their ``error`` (residual and vector sums of squares)."""
    rows = codes.select(
        *keys, F.col("error").alias("e"), F.size(F.filter("z", lambda v: F.abs(v) > 1e-6)).alias("n_active")
    )
    out = rows.groupBy(*keys).agg(
        (F.avg(F.col("e")[0]) / p).alias("mse"),
        (F.avg(F.col("e")[1]) / p).alias("zero_reconstruction_mse"),
        (F.avg("n_active") / k).alias("active_fraction"),
        F.avg("n_active").alias("mean_active_atoms"),
    )
    return out.withColumn("relative_mse", F.try_divide("mse", "zero_reconstruction_mse"))
