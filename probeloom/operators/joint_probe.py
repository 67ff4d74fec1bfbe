"""Many logistic probes fitted together: every optimizer step is one scan for all of them.

A fit minimizes mean cross-entropy + lambda/2 |W|^2 with a free intercept over the
rows of a view. A view says which stored rows it sees and how they become input, so
fits on different folds, representations, scalings and penalties share the scan. In
a task all fits of a view stand side by side in two matrix products; what leaves
the task is a gradient row per fit and class, and Spark adds these up.

Steps are quasi-Newton with limited memory. The first guess of the inverse Hessian
is (h Cov + lambda)^-1 per class, with h = mean p(1-p) from the scan before and the
covariance of the view from one scan at the start (its diagonal for wide inputs).
Each fit has a line search of its own: a fit whose trial point is too high halves its
step in the next scan while the others go on. Fits leave when their gradient is small.
A narrow fit that is still open after some steps also asks for its Hessian and goes
on by Newton steps; so many take turns that a scan never returns more than a bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.functions.arrow import small_batches, to_lists, to_matrix
from probeloom.functions.scalars import VARIANCE_FLOOR
from probeloom.operators.checks import CheckFailed
from probeloom.operators.probe import CELL_SCHEMA, Probe, add_cells, cell_batch, probabilities
from probeloom.session import bounded_sums

GRADIENT_TOLERANCE = 1e-5
MAX_STEPS = 5000
MEMORY = 10
# Inputs up to this width get a full covariance as the first guess.
FULL_WIDTH = 512
ARMIJO = 1e-4
# Steps after which a fit of at most so many parameters asks for its Hessian, and the
# doubles of Hessians that one scan returns.
NEWTON_AFTER, NEWTON_WIDTH, HESSIAN_DOUBLES = 25, 400, 2_000_000
SUMS = "key int, v array<double>"


@dataclass
class View:
    """``rows(opened)``: the rows of a batch that the view sees (index or mask) and their input matrix.

    ``opened`` is what the caller's ``open_`` makes of a batch, once for all views.
    """

    rows: Callable[[Any], tuple[np.ndarray, np.ndarray]]


def whole(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All rows with the vectors of column ``vec``."""
    return np.arange(batch.num_rows), to_matrix(batch.column("vec"))


@dataclass
class Wanted:
    view: int
    lam: float
    scaling: str = "none"


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    variance: np.ndarray
    scale: np.ndarray            # population SD, 1 where constant
    covariance: np.ndarray | None
    known: dict = field(default_factory=dict)

    def spectrum(self, scaling: str) -> tuple[np.ndarray, np.ndarray | None]:
        """Eigenvalues and vectors of the covariance in fitted coordinates, or its diagonal and None."""
        if scaling not in self.known:
            sd = self.scale if scaling == "standard" else np.ones_like(self.scale)
            if self.covariance is None:
                self.known[scaling] = self.variance / sd ** 2, None
            else:
                roots, axes = np.linalg.eigh(self.covariance / np.outer(sd, sd))
                self.known[scaling] = np.maximum(roots, 0), axes
        return self.known[scaling]


@dataclass
class Fit:
    wanted: Wanted
    m: Moments
    classes: int
    x: np.ndarray = field(default=None)      # free classes x (width + 1), in fitted coordinates
    f: float = np.inf
    g: np.ndarray = field(default=None)
    h: np.ndarray = field(default=None)      # mean p(1-p) per free class
    trial: np.ndarray = field(default=None)
    direction: np.ndarray = field(default=None)
    step: float = 1.0
    pairs: list = field(default_factory=list)
    steps: int = 0
    stalled: bool = False

    def __post_init__(self):
        self.x = np.zeros((1 if self.classes == 2 else self.classes, len(self.m.mean) + 1))
        self.trial = self.x
        self.sd = self.m.scale if self.wanted.scaling == "standard" else np.ones_like(self.m.scale)

    def plain(self, x: np.ndarray) -> np.ndarray:
        """Weights and intercepts for input as stored; fitted coordinates are centred and scaled."""
        w = x[:, :-1] / self.sd
        return np.hstack([w, x[:, -1:] - w @ self.m.mean[:, None]])

    def learn(self, sums: np.ndarray, hessian: np.ndarray | None = None) -> None:
        """Take the sums of the trial point: gradient, intercept gradient, loss and p(1-p) per free class."""
        g, g0, loss, h = sums[:, :-3], sums[:, -3:-2], sums[0, -2], sums[:, -1]
        n, lam, w = self.m.n, self.wanted.lam, self.trial[:, :-1]
        f = loss / n + 0.5 * lam * float((w ** 2).sum())
        g = np.hstack([(g / n - g0 / n * self.m.mean) / self.sd + lam * w, g0 / n])
        if self.g is None:
            self.f, self.g, self.h = f, g, h / n
        else:
            slope = float((self.g * self.direction).sum())
            if not f <= self.f + ARMIJO * self.step * slope + 1e-15 * abs(self.f):
                # The least of the parabola through both values and the slope, within a tenth and a half.
                best = -0.5 * slope * self.step / max((f - self.f) / self.step - slope, 1e-300) if np.isfinite(f) else 0.0
                self.step = float(np.clip(best, 0.1 * self.step, 0.5 * self.step))
                self.stalled = self.step < 1e-12
                self.trial = self.x + self.step * self.direction
                return
            s, y = self.trial - self.x, g - self.g
            if float((s * y).sum()) > 1e-12 * float(np.linalg.norm(s) * np.linalg.norm(y)):
                self.pairs = [*self.pairs[1 - MEMORY:], (s, y)]
            self.x, self.f, self.g, self.h = self.trial, f, g, h / n
        self.steps += 1
        self.direction = -self.inverse(self.g) if hessian is None else -self.newton(hessian)
        if float((self.direction * self.g).sum()) >= 0:
            self.pairs, self.direction = [], -self.guess(self.g)
        self.step = 1.0
        self.trial = self.x + self.direction

    def guess(self, r: np.ndarray) -> np.ndarray:
        h = np.maximum(self.h, 1e-8)[:, None]
        roots, axes = self.m.spectrum(self.wanted.scaling)
        w = r[:, :-1] if axes is None else r[:, :-1] @ axes
        w = w / (h * roots + self.wanted.lam)
        return np.hstack([w if axes is None else w @ axes.T, r[:, -1:] / h])

    def inverse(self, r: np.ndarray) -> np.ndarray:
        """Two-loop recursion."""
        q, weights = r.copy(), []
        for s, y in reversed(self.pairs):
            a = float((s * q).sum()) / float((s * y).sum())
            weights.append(a)
            q = q - a * y
        d = self.guess(q)
        if self.pairs:
            s, y = self.pairs[-1]
            d *= float((s * y).sum()) / max(float((y * self.guess(y)).sum()), 1e-300)
        for (s, y), a in zip(self.pairs, reversed(weights)):
            d = d + s * (a - float((y * d).sum()) / float((s * y).sum()))
        return d

    @property
    def narrow(self) -> bool:
        return self.steps >= NEWTON_AFTER and self.x.size <= NEWTON_WIDTH

    def newton(self, hessian: np.ndarray) -> np.ndarray:
        """Penalized Newton step; a trace of ridge fixes the shift that all classes may share."""
        h = hessian / self.m.n
        penalty = np.tile(np.append(np.full(self.x.shape[1] - 1, self.wanted.lam), 0.0), len(self.x))
        h[np.diag_indices_from(h)] += penalty + 1e-12 * np.trace(h)
        return np.linalg.solve(h, self.g.ravel()).reshape(self.x.shape)

    @property
    def gradient(self) -> float:
        return float(np.abs(self.g).max())

    def probe(self, classes: Sequence[str], tolerance: float) -> Probe:
        plain = self.plain(self.x)
        if self.classes == 2:
            plain = np.vstack([np.zeros_like(plain), plain])
        return Probe(list(classes), plain[:, :-1], plain[:, -1], 1.0 / (self.m.n * self.wanted.lam), self.steps,
                     self.gradient <= tolerance, self.gradient)


def summed(rows: DataFrame, run, keys: int) -> dict[int, np.ndarray]:
    """Sums of the arrays that the tasks return, by key; of model size."""
    out = rows.mapInArrow(run, SUMS).groupBy("key").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    return bounded_sums(out, keys, "sums of fits")


def view_moments(rows: DataFrame, views: Sequence[View], open_: Callable = lambda batch: batch) -> list[Moments]:
    """Rows, mean, SD and covariance of every view from one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in small_batches(batches):
            opened = open_(batch)
            for i, view in enumerate(views):
                _, x = view.rows(opened)
                if not len(x):
                    continue
                n, p = x.shape
                part = [[n, n * p], x.sum(axis=0), (x ** 2).sum(axis=0), (x.T @ x).ravel() if p <= FULL_WIDTH else []]
                part = np.concatenate(part)
                totals[i] = part if i not in totals else totals[i] + part
        for i, part in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), to_lists(part[None])], names=["key", "v"])

    found = summed(rows, run, len(views))
    out = []
    for i in range(len(views)):
        if i not in found:
            raise CheckFailed(f"view {i} has no training rows")
        v = found[i]
        n, p = int(v[0]), int(round(v[1] / v[0]))
        mean = v[2:2 + p] / n
        variance = np.maximum(v[2 + p:2 + 2 * p] / n - mean ** 2, 0)
        scale, full = np.sqrt(variance), v[2 + 2 * p:]
        out.append(Moments(n, mean, variance, np.where(scale < VARIANCE_FLOOR, 1.0, scale),
                           full.reshape(p, p) / n - np.outer(mean, mean) if len(full) else None))
    return out


def curvature(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hessian of the summed cross-entropy: p are the free classes' probabilities, x the fitted coordinates."""
    x = np.hstack([x, np.ones((len(x), 1))])
    free, q = p.shape[1], x.shape[1]
    out = np.empty((free, q, free, q))
    for c in range(free):
        for e in range(c, free):
            block = x.T @ (x * ((p[:, c] * ((c == e) - p[:, e]))[:, None]))
            out[c, :, e, :], out[e, :, c, :] = block, block
    return out.reshape(free * q, free * q)


def evaluate(rows: DataFrame, views: Sequence[View], fits: Sequence[Fit], todo: Sequence[int], classes: int, open_: Callable) -> None:
    """One scan: every fit in ``todo`` learns loss and gradient of its trial point, and the Hessian if it asks."""
    free = 1 if classes == 2 else classes
    by_view: dict[int, list[int]] = {}
    for i in todo:
        by_view.setdefault(fits[i].wanted.view, []).append(i)
    weights = {v: np.vstack([fits[i].plain(fits[i].trial) for i in own]) for v, own in by_view.items()}
    asked, room = {}, HESSIAN_DOUBLES
    for i in sorted(todo, key=lambda i: fits[i].steps):
        if fits[i].narrow and fits[i].x.size ** 2 <= room:
            room -= fits[i].x.size ** 2
            asked[i] = fits[i].m.mean, fits[i].sd
    # Keys below are gradient rows; each asking fit has its Hessian's rows after them.
    begin, at = {}, len(fits) * free
    for i in asked:
        begin[i], at = at, at + fits[i].x.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        bent: dict[int, np.ndarray] = {}
        for batch in small_batches(batches):
            y_all, opened = batch.column("y").to_numpy(zero_copy_only=False), open_(batch)
            for v, w in weights.items():
                keep, x = views[v].rows(opened)
                if not len(x):
                    continue
                y, n, k = y_all[keep], len(x), len(w) // free
                s = (x @ w[:, :-1].T + w[:, -1]).reshape(n, k, free)
                if classes == 2:
                    s = np.concatenate([np.zeros((n, k, 1)), s], axis=2)
                s -= s.max(axis=2, keepdims=True)
                own = s[np.arange(n), :, y]
                np.exp(s, out=s)
                size = s.sum(axis=2)
                loss = (np.log(size) - own).sum(axis=0)
                s /= size[:, :, None]
                spread = (s * (1 - s)).sum(axis=0)
                for j, i in enumerate(by_view[v]):
                    if i in asked:
                        part = curvature(s[:, j, classes - free:], (x - asked[i][0]) / asked[i][1])
                        bent[i] = part if i not in bent else bent[i] + part
                s[np.arange(n), :, y] -= 1
                r = s[:, :, classes - free:].reshape(n, k * free)
                part = np.hstack([r.T @ x, r.sum(axis=0)[:, None], np.repeat(loss, free)[:, None],
                                  spread[:, classes - free:].reshape(-1, 1)])
                totals[v] = part if v not in totals else totals[v] + part
        for v, part in totals.items():
            keys = np.array([i * free + c for i in by_view[v] for c in range(free)], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys), to_lists(part)], names=["key", "v"])
        for i, part in bent.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(begin[i], begin[i] + len(part), dtype=np.int32)), to_lists(part)], names=["key", "v"])

    found = summed(rows, run, at)
    for i in todo:
        hessian = np.array([found[begin[i] + k] for k in range(fits[i].x.size)]) if i in asked else None
        fits[i].learn(np.array([found[i * free + c] for c in range(free)]), hessian)


def fit_together(rows: DataFrame, views: Sequence[View], wanted: Sequence[Wanted], classes: Sequence[str],
                 tolerance: float = GRADIENT_TOLERANCE, max_steps: int = MAX_STEPS, strict: bool = False,
                 open_: Callable = lambda batch: batch) -> list[Probe]:
    """A probe for each of ``wanted``, in order. ``rows`` needs ``y`` (class number) and what the views read.

    Persist or store ``rows``: each step scans them once. ``converged`` means that
    no coordinate of the penalized gradient exceeds ``tolerance``; the largest is kept.
    """
    if len(classes) < 2:
        raise CheckFailed("a probe needs two classes")
    moments = view_moments(rows, views, open_)
    fits = [Fit(w, moments[w.view], len(classes)) for w in wanted]
    todo = list(range(len(fits)))
    for _ in range(max_steps):
        if not todo:
            break
        evaluate(rows, views, fits, todo, len(classes), open_)
        todo = [i for i in todo if fits[i].gradient > tolerance and not fits[i].stalled]
    probes = [f.probe(classes, tolerance) for f in fits]
    if strict and not all(p.converged for p in probes):
        raise CheckFailed("logistic probe did not converge")
    return probes


def score_together(rows: DataFrame, views: Sequence[View], models: Sequence[tuple[int, Probe]],
                   open_: Callable = lambda batch: batch) -> DataFrame:
    """model, label, prediction, n, loss of each (view, probe) on the rows of its view, from one scan.

    Needs ``y`` in the order of the probes' classes. Each view is opened once for all its probes.
    """
    by_view: dict[int, list[int]] = {}
    for i, (v, _) in enumerate(models):
        by_view.setdefault(v, []).append(i)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict = {}
        for batch in small_batches(batches):
            y, opened = batch.column("y").to_numpy(zero_copy_only=False), open_(batch)
            for v, own in by_view.items():
                keep, x = views[v].rows(opened)
                for i in own:
                    m = models[i][1]
                    add_cells(cells, i, m, x, np.array(m.classes, dtype=object)[y[keep]])
        yield cell_batch(cells)

    return rows.mapInArrow(count, CELL_SCHEMA).groupBy("model", "label", "prediction").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))


def mean_probabilities(rows: DataFrame, views: Sequence[View], models: Sequence[tuple[int, Probe]],
                       open_: Callable = lambda batch: batch) -> list[np.ndarray]:
    """Mean predicted probability of every class over the rows of each probe's view, from one scan.

    With a free intercept these are the class shares of the training rows, exactly at the optimum.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in small_batches(batches):
            opened = open_(batch)
            for i, (v, m) in enumerate(models):
                _, x = views[v].rows(opened)
                if len(x):
                    part = np.append(probabilities(m, x).sum(axis=0), len(x))
                    totals[i] = part if i not in totals else totals[i] + part
        for i, part in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), to_lists(part[None])], names=["key", "v"])

    found = summed(rows, run, len(models))
    return [found[i][:-1] / found[i][-1] for i in range(len(models))]
