"""Array-valued column functions. All run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F



def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def literal_matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[literal(row) for row in rows])


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(vec: Column) -> Column:
    return F.sqrt(total(F.transform(vec, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalize(vec: Column) -> Column:
    """Unit-length copy; a zero vector gives NULL entries."""
    return F.zip_with(
        vec, F.array_repeat(norm(vec), F.size(vec)), lambda x, n: F.try_divide(x, n)
    )


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def mat_vec(matrix: Column, vec: Column) -> Column:
    return F.transform(matrix, lambda row: dot(row, vec))


def softmax(scores: Column) -> Column:
    """Probabilities from class scores, shifted by the maximum first."""
    top = F.array_max(scores)
    weights = F.transform(F.zip_with(scores, F.array_repeat(top, F.size(scores)), lambda s, m: s - m), F.exp)
    mass = total(weights)
    return F.zip_with(weights, F.array_repeat(mass, F.size(weights)), lambda w, m: w / m)


def logistic_pair(score: Column) -> Column:
    """Two-class probabilities from one score."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-score))
    return F.array(F.lit(1.0) - p, p)


def first_argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def gather(vec: Column, positions: Column) -> Column:
    """Entries at zero-based positions."""
    return F.transform(positions, lambda i: F.element_at(vec, (i + 1).cast("int")))


def all_finite(vec: Column) -> Column:
    return F.forall(
        vec,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )


def soft_threshold(u: Column, a: Column | float) -> Column:
    bound = a if isinstance(a, Column) else F.lit(float(a))
    return F.signum(u) * F.greatest(F.abs(u) - bound, F.lit(0.0))
