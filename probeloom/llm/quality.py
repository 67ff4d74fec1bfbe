"""Quality scores by positive-unlabelled learning.

Trusted positives are training rows marked good; every other mark is unused.
The unlabelled set is the text of all training rows. With class prior p and
logistic loss l the risk is  p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]);
Newton steps minimise it and are halved when the second part would turn
negative. The prior is the smallest ratio of unlabelled to positive mass over the
score levels of a first fit. Sums over all rows are taken in Spark; the driver
sees model-sized sums only.
"""

from __future__ import annotations

import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeloom.llm.common import table
from probeloom.session import bounded_rows, materialize

FOLDS, HELD_OUT = 5, 0
ACCEPT = 0.3
STEPS = 12
RIDGE = 1e-3
# Score levels over which the class prior is estimated, and the least share of
# the positives that a level must hold.
LEVELS, LEAST_MASS = 200, 0.02

# Byte classes: 1 upper case, 2 lower case or part of another letter, 3 digit, 4 punctuation, 0 white space.
CLASS = np.full(256, 2, np.uint8)
CLASS[:33] = 0
CLASS[[ord(c) for c in string.ascii_uppercase]] = 1
CLASS[[ord(c) for c in string.digits]] = 3
CLASS[[ord(c) for c in string.punctuation]] = 4

FEATURES = ("bias", "upper", "punctuation", "doubled_marks", "bare_marks", "repeated_word",
            "few_words", "top_word", "repeated_pair", "digits", "long_words", "short_words", "brief")
WIDTH = len(FEATURES)


def features(text: str | None) -> list[float]:
    """Shares of the text, each scaled to 0..1. Null and empty texts have only bias and brevity."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (WIDTH - 2) + [1.0]
    a = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = CLASS[a]
    _, upper, lower, digit, marks = (int(x) for x in np.bincount(kinds, minlength=5))
    solid = upper + lower + digit + marks
    doubled = int(np.count_nonzero((a[1:] == a[:-1]) & (kinds[1:] == 4)))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    bare = sum(c for w, c in counts.items() if len(w) < 4 and not any(map(str.isalnum, w)))
    again = sum(map(str.__eq__, words, words[1:]))
    size = (upper + lower + digit) / n
    few = 1 - np.log(len(counts)) / np.log(n) if n > 1 else 0.0
    values = (
        upper / max(1, upper + lower) / 0.3, marks / solid / 0.15, doubled / solid / 0.03, bare / n / 0.15,
        again / n / 0.2, few / 0.25, (max(counts.values()) / n - 0.1) / 0.4, (1 - pairs / max(1, n - 1)) / 0.4,
        digit / solid / 0.2, (size - 8) / 12, (3 - size) / 3, (10 - n) / 10,
    )
    return [1.0, *(float(min(1.0, max(0.0, v))) for v in values)]


@F.arrow_udf(T.ArrayType(T.FloatType()))
def feature_column(texts: pa.Array) -> pa.Array:
    if not len(texts):
        return pa.array([], pa.list_(pa.float32()))
    rows = np.array([features(t.as_py()) for t in texts], np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * WIDTH), pa.array(rows.ravel()))


def fold(id_col, folds: int):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def described(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, trusted, f: stored. A null id is in training and never trusted."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("_good"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), feature_column("text").alias("f"))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return materialize(rows.join(marks.select(F.col("doc_id").cast("long").alias("doc_id"), "_good"), "doc_id", "left").select(
        "doc_id", held.alias("held_out"), (~held & F.coalesce("_good", F.lit(False))).alias("trusted"), "f"
    ), "quality-features")


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), WIDTH)


def summed(rows: DataFrame, sums) -> np.ndarray:
    """Adds up, over all rows, the vector that ``sums(x, trusted)`` gives for each batch."""

    def run(batches):
        total = 0
        for batch in batches:
            total = total + sums(matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.asarray(total, float))
            ], ["i", "v"])

    parts = rows.select("f", "trusted").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    found = bounded_rows(parts, 100_000, "sums of the quality model")
    return np.array([r["v"] for r in sorted(found, key=lambda r: r["i"])])


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def losses(w: np.ndarray):
    """Per batch: counts, loss, gradient and curvature of l(-g) on all rows; sums of l(g), l(-g), x and both on positives."""

    def run(x, trusted):
        g = x @ w
        s, p = sigmoid(g), x[trusted]
        minus, plus = np.logaddexp(0, g), np.logaddexp(0, -g[trusted])
        sp = s[trusted]
        curve = (x * (s * (1 - s))[:, None]).T @ x
        return np.concatenate([[len(x), len(p), minus.sum(), plus.sum(), minus[trusted].sum()],
                               x.T @ s, p.T @ sp, p.sum(axis=0), curve.ravel()])

    return run


def fit(rows: DataFrame, prior: float) -> np.ndarray:
    """Weights that minimise the non-negative risk; ``rows`` has f and trusted."""

    def risk(w):
        v = summed(rows, losses(w))
        n, k = v[0], max(1.0, v[1])
        negative = v[2] / n - prior * v[4] / k
        value = prior * v[3] / k + max(0.0, negative) + RIDGE / 2 * w @ w
        by_all, by_known, known = np.split(v[5:5 + 3 * WIDTH], 3)
        # l(g) - l(-g) = -g, so the positives enter the unbiased risk by their mean alone.
        slope = by_all / n - prior * known / k + RIDGE * w
        curve = v[5 + 3 * WIDTH:].reshape(WIDTH, WIDTH) / n + RIDGE * np.eye(WIDTH)
        return value, negative, slope, curve

    w = np.zeros(WIDTH)
    value, negative, slope, curve = risk(w)
    for _ in range(STEPS):
        step, size = np.linalg.solve(curve, slope), 1.0
        while True:
            trial = w - size * step
            found = risk(trial)
            if (found[1] >= 0 and found[0] <= value) or size < 0.1:
                break
            size /= 2
        if found[1] < 0 or found[0] > value:
            break
        done = value - found[0] < 1e-5
        w, (value, negative, slope, curve) = trial, found
        if done:
            break
    return w


def class_prior(rows: DataFrame, w: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least P_U(A) / P_P(A) over A = {score >= level}."""

    def levels(x, trusted):
        at = np.minimum((sigmoid(x @ w) * LEVELS).astype(int), LEVELS - 1)
        return np.concatenate([np.bincount(at, minlength=LEVELS), np.bincount(at[trusted], minlength=LEVELS)])

    every, known = np.split(summed(rows, levels), 2)
    upper, good = (np.cumsum(h[::-1]) / max(1, h.sum()) for h in (every, known))
    ratio = (upper / np.maximum(good, 1e-12))[good >= LEAST_MASS]
    return float(np.clip(ratio.min(initial=1.0), 0.05, 0.99))


def train(described_rows: DataFrame) -> np.ndarray:
    """Weights from all training rows. Without any trusted row every score is one half."""
    rows = described_rows.filter(~F.col("held_out")).select("f", "trusted")
    if not rows.filter("trusted").limit(1).count():
        return np.zeros(WIDTH)
    first = fit(rows, 0.5)
    return fit(rows, class_prior(rows, first))


def score_column(f, w: np.ndarray):
    total = F.aggregate(
        F.zip_with(f, F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b
    )
    return 1 / (1 + F.exp(-total))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Empty and null texts are scored like any other. Rows with a null id are scored
    and not held out; repeated rows are scored each; an empty table gives no rows.
    """
    rows = described(docs, labels)
    score = score_column(F.col("f"), train(rows))
    return rows.select("doc_id", "held_out", score.alias("score"), (score >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects, all columns unchanged."""
    w = train(described(docs, labels))
    scored = docs.withColumn("_score", score_column(feature_column("text"), w))
    return scored.filter(F.col("_score") >= ACCEPT).drop("_score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    )
