"""Multinomial logistic probe: MLlib fits, shared-scan scoring.

Objective per fit: mean cross-entropy + lambda/2 * |W|^2 with a free intercept
and C = 1/(n * lambda).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.functions import vectors as V
from probeloom.functions.arrow import task_function, to_lists, to_matrix
from probeloom.operators.checks import MAX_CLASSES, CheckFailed
from probeloom.operators.metrics import PROBABILITY_FLOOR, class_list
from probeloom.session import bounded_rows

MAX_ITERATIONS = 5000
TOLERANCE = 1e-7


@dataclass
class Probe:
    classes: list[str]
    coef: np.ndarray        # classes x coordinates
    intercept: np.ndarray
    C: float
    iterations: int
    converged: bool
    gradient: float | None = None    # largest coordinate of the penalized gradient, where it was taken


def classes_of(rows: DataFrame, label: str = "label") -> list[str]:
    return sorted(r[0] for r in bounded_rows(rows.select(label).distinct(), MAX_CLASSES, "classes"))


def training_rows(rows: DataFrame, classes: Sequence[str], vec: str = "vec") -> DataFrame:
    """MLlib input, with the tasks of ``rows``. Class numbers follow the sorted class list.

    Every optimizer step is one job over these rows, so persist them.
    """
    return rows.select(
        array_to_vector(F.col(vec).cast("array<double>")).alias("features"),
        (F.array_position(class_list(classes), F.col("label")) - 1).cast("double").alias("label"),
    )


def fit_probe(train: DataFrame, classes: Sequence[str], n: int, C: float | None = None,
              lam: float | None = None, scaling: str = "none", max_iter: int = MAX_ITERATIONS,
              tol: float = TOLERANCE, strict: bool = False) -> Probe:
    """Fit on :func:`training_rows` output (persist it when fitting repeatedly).

    ``scaling='standard'`` penalizes population-standardized coordinates. MLlib
    standardizes by the sample SD inside its own pass, so the penalty carries
    the factor (n-1)/n and the stored rows serve both scalings.
    """
    lam = 1.0 / (n * C) if lam is None else lam
    standard = scaling == "standard"
    model = LogisticRegression(
        family="auto", elasticNetParam=0.0, standardization=standard, maxIter=max_iter, tol=tol,
        regParam=lam * (n - 1) / n if standard else lam,
    ).fit(train)
    iterations = model.summary.totalIterations
    coef, intercept = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    if len(classes) == 2:
        coef = np.vstack([np.zeros_like(coef), coef])
        intercept = np.array([0.0, intercept[0]])
    probe = Probe(list(classes), coef, intercept, 1.0 / (n * lam), iterations, iterations < max_iter)
    if strict and not probe.converged:
        raise CheckFailed("logistic probe did not converge")
    return probe


def probabilities(model: Probe, x: np.ndarray) -> np.ndarray:
    s = x @ model.coef.T + model.intercept
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def score(rows: DataFrame, model: Probe, vec: str = "vec") -> DataFrame:
    """Add ``probs`` in class order. Stateless, hence also usable on streams."""

    @task_function("array<double>")
    def probs(v: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.list_(pa.float64()))
        return to_lists(probabilities(model, to_matrix(v)))

    return rows.withColumn("probs", probs(F.col(vec).cast("array<double>")))


def native_score(rows: DataFrame, model: Probe, vec: str = "vec") -> DataFrame:
    """Same as :func:`score` as one JVM expression, for small coefficient blocks."""
    x = F.col(vec).cast("array<double>")
    raw = F.zip_with(V.mat_vec(V.literal_matrix(model.coef), x), V.literal(model.intercept), lambda s, b: s + b)
    return rows.withColumn("probs", V.softmax(raw))


CELL_SCHEMA = "model int, label string, prediction string, n long, loss double"


def add_cells(cells: dict, key: int, model: Probe, x: np.ndarray, y: np.ndarray) -> None:
    """Add one batch to the confusion counts and summed losses of a model."""
    if not len(y):
        return
    p = probabilities(model, x)
    names = np.array(model.classes, dtype=object)
    truth = np.searchsorted(names, y)
    loss = -np.log(np.clip(p[np.arange(len(y)), truth], PROBABILITY_FLOOR, 1 - PROBABILITY_FLOOR))
    code = truth * len(names) + p.argmax(axis=1)
    n = np.bincount(code, minlength=len(names) ** 2)
    lost = np.bincount(code, weights=loss, minlength=len(names) ** 2)
    for c in np.flatnonzero(n):
        cell = cells.setdefault((key, names[c // len(names)], names[c % len(names)]), [0, 0.0])
        cell[0] += int(n[c])
        cell[1] += float(lost[c])


def cell_batch(cells: dict) -> pa.RecordBatch:
    keys = list(cells)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()),
         pa.array([k[2] for k in keys], pa.string()), pa.array([cells[k][0] for k in keys], pa.int64()),
         pa.array([cells[k][1] for k in keys], pa.float64())],
        names=["model", "label", "prediction", "n", "loss"],
    )


def confusion_of(rows: DataFrame, models: Sequence[Probe], vec: str = "vec",
                 groups: Sequence[str] | None = None) -> DataFrame:
    """model, label, prediction, n, loss for many probes from one scan of ``rows``.

    With ``groups``, probe i counts only the rows whose grp is ``groups[i]``.
    Tasks emit one count per occurring cell, never a row per entity.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, list[float]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = to_matrix(batch.column(0))
            y, grp = (np.array(batch.column(i).to_pylist(), dtype=object) for i in (1, 2))
            for i, m in enumerate(models):
                keep = slice(None) if groups is None else grp == groups[i]
                add_cells(cells, i, m, x[keep], y[keep])
        yield cell_batch(cells)

    grp = F.col("grp").cast("string") if groups is not None else F.lit("")
    return (
        rows.select(F.col(vec).cast("array<double>").alias("vec"), "label", grp.alias("grp"))
        .mapInArrow(count, CELL_SCHEMA)
        .groupBy("model", "label", "prediction").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    )


def together(spark, jobs: Sequence[Callable[[], object]], parallelism: int) -> list:
    """Run independent fits as concurrent Spark jobs, results in order.

    Each job is wrapped on its own: a wrapper carries one set of job properties,
    which concurrent jobs must not share.
    """
    if parallelism <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    wrapped = [inheritable_thread_target(spark)(job) for job in jobs]
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        return pool.map(lambda job: job(), wrapped, chunksize=1)


def persisted(df: DataFrame) -> DataFrame:
    """Keep rows for repeated passes; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def coefficient_table(spark, model: Probe) -> DataFrame:
    rows = [(i, c, [float(v) for v in w], float(b))
            for i, (c, w, b) in enumerate(zip(model.classes, model.coef, model.intercept))]
    return spark.createDataFrame(rows, "class_pos int, label string, weights array<double>, intercept double")
