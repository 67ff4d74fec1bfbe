"""Arrow list columns to and from NumPy matrices, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Rows of a sparse vector column: its width, the places of its stored values, and these.
SPARSE = "struct<size: int, pos: array<int>, val: array<double>>"
# Rows that a task holds as a dense matrix at a time.
DENSE_ROWS = 1024


def stored_vector(df: DataFrame, name: str = "vec") -> Column:
    """The vector column of ``df`` as tasks read it: sparse as it is, or an array of doubles."""
    return F.col(name) if isinstance(df.schema[name].dataType, StructType) else F.col(name).cast("array<double>")


def dense_vector(value) -> list[float]:
    """A collected vector, sparse or not, as a list."""
    if not hasattr(value, "pos"):
        return value
    out = [0.0] * value["size"]
    for i, v in zip(value["pos"], value["val"]):
        out[i] = v
    return out


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = DENSE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows; empty ones are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def to_matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a float64 matrix; sparse rows are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if pa.types.is_struct(column.type):
        size, pos, val = column.flatten()
        x = np.zeros((n, size[0].as_py() if n else 0))
        rows = np.repeat(np.arange(n), np.diff(pos.offsets.to_numpy()))
        x[rows, pos.flatten().to_numpy(zero_copy_only=False)] = val.flatten().to_numpy(zero_copy_only=False)
        return x
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(n, -1) if n else values.reshape(0, 0)


def to_lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def task_function(return_type: str):
    """Arrow-batched column function that the optimizer evaluates once per row.

    The optimizer copies deterministic expressions into the filters it infers
    (explode adds one on the array size) and would run the task twice.
    """

    def wrap(f):
        return F.arrow_udf(f, return_type).asNondeterministic()

    return wrap
