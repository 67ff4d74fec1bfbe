"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns a unit vector by three rounds of random signs and a fast
Hadamard transform and names the signed axis nearest to it. A row is stored
under its axis in every table; a query probes the axes nearest to it. Rows found
are ranked by their exact distance on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probeloom.llm.common import table
from probeloom.session import materialize

TABLES, PROBES, ROUNDS, SEED = 8, 20, 3, 17
# Rows of a bucket that are compared in one group; larger buckets are split.
GROUP_ROWS = 4000
K = 10

STORED = "dim int, place int, bucket int, id long, vec binary"
FOUND = "query_id long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, tables: int) -> list[np.ndarray]:
    """Unit rows, padded to a power of two, under the pseudo-rotation of each table."""
    n, dim = x.shape
    width = 1 << max(1, dim - 1).bit_length()
    unit = np.zeros((n, width))
    top = np.abs(x).max(axis=1, keepdims=True)
    scaled = x / top
    unit[:, :dim] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    signs = np.random.default_rng([SEED, dim]).choice([-1.0, 1.0], (tables, ROUNDS, width))
    out = []
    for rounds in signs:
        y = unit
        for s in rounds:
            y = hadamard(y * s)
        out.append(y)
    return out


def axes(y: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` signed axes nearest to each row, nearest first: 2a for +a, 2a + 1 for -a."""
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :count]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (doubles): rows with an id and a finite vector other than zero."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(False))
                       & F.exists("vec", lambda x: x != 0))


def hashed(rows: DataFrame, tables: int, probes: int | None) -> DataFrame:
    """A row per table and axis: the nearest ``probes`` axes, or every axis when None."""

    def run(batches):
        for batch in batches:
            lists, ids = batch.column(1), batch.column(0).to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = values[starts[at][:, None] + np.arange(dim)]
                raw = [r.tobytes() for r in x]
                for place, y in enumerate(rotated(x, tables)):
                    codes = axes(y, 2 * y.shape[1] if probes is None else probes)
                    many = codes.shape[1]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(codes.size, dim, np.int32)), pa.array(np.full(codes.size, place, np.int32)),
                        pa.array(codes.ravel().astype(np.int32)), pa.array(np.repeat(ids[at], many)),
                        pa.array([r for r in raw for _ in range(many)], pa.binary()),
                    ], ["dim", "place", "bucket", "id", "vec"])

    return rows.select("id", "vec").mapInArrow(run, STORED)


def nearest(query: np.ndarray, x: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the ``k`` rows nearest to ``query``, ties to smaller ids."""
    with np.errstate(over="ignore"):
        distance = np.sqrt(((x - query) ** 2).sum(axis=1))
    keep = np.flatnonzero(ids != own)
    order = keep[np.lexsort((ids[keep], distance[keep]))]
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[order], distance[order]


def probe(stored: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest rows of each query in each group that it probes."""
    keys = ["dim", "place", "bucket"]
    # One row per table and axis: its size depends on the tables and the width alone.
    sizes = stored.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("parts"))
    sizes = F.broadcast(materialize(sizes, "bucket-sizes"))
    rows = stored.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    asked = queries.join(sizes, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def run(left, right):
        out = []
        if left.num_rows and right.num_rows:
            x = np.frombuffer(b"".join(left["vec"].to_pylist())).reshape(left.num_rows, -1)
            ids = left["id"].to_numpy()
            for own, raw in zip(right["id"].to_pylist(), right["vec"].to_pylist()):
                found, distance = nearest(np.frombuffer(raw), x, ids, own, k)
                out.append((np.full(len(found), own), found, distance))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.array([], t) for t in ("i8", "i8", "f8")]
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    by = [*keys, "part"]
    return rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each query.

    Null, zero and non-finite vectors and null ids take no part. Vectors meet
    those of their own length. A row with the query's id is no candidate; an id that
    repeats counts once, at its least distance, and asks once, with its least vector.
    A query that finds fewer than ``k`` rows is compared with all of them.
    """
    rows = usable(vectors, id_col, vec_col)
    asked = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec"))
    stored = hashed(rows, TABLES, 1)
    first = materialize(ranked(probe(stored, hashed(asked, TABLES, PROBES), k), k), "neighbours")
    enough = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = materialize(asked.join(enough, "id", "left_anti"), "short-queries")
    rest = ranked(probe(hashed(rows, 1, 1), hashed(short, 1, None), k), k)
    return first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
