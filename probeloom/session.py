"""Session helpers: shared work folder, materialized tables, size-checked small sides."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table that may be held as a local relation and broadcast. The tables
# that pass through here have one row per class, group, fold, atom or selected
# feature; anything larger takes the shuffle path.
SMALL_ROWS = 20_000
SMALL_BYTES = 64 * 1024 * 1024


def work_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("Set spark.checkpoint.dir to a folder shared by the cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/probeloom-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage and freezes values that depend on task layout. The copy
    outlives lost executors, and readers of it prune columns and partitions.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    # zstd streams free their memory when closed; snappy's direct buffers wait for a collection.
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    schema = df.schema
    if partition_by:
        return spark.read.parquet(path).select(*df.columns)
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Share the rows of a table with few scan tasks among all cores.

    For row-wise work that costs far more than moving the row (tokenizing,
    coding). A table large enough to fill the cluster with scan tasks comes back
    unchanged, so no shuffle is added where it would hurt.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def settle(df: DataFrame, max_rows: int = SMALL_ROWS, name: str = "small") -> DataFrame:
    """Evaluate a supposedly small table once and return a reusable form.

    Up to ``max_rows`` rows and SMALL_BYTES become a local relation marked for
    broadcast. A larger table is materialized without a hint, so joins against
    it shuffle.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows and head.nbytes <= SMALL_BYTES:
        local = df.sparkSession.createDataFrame(head, schema=df.schema)
        return F.broadcast(local)
    return materialize(df, name)


def bounded_sums(df: DataFrame, max_rows: int, what: str) -> dict[int, np.ndarray]:
    """Arrays by key of a table (key, v) whose size is limited by the model, fetched as Arrow."""
    found = df.select("key", "v").limit(max_rows + 1).toArrow()
    if found.num_rows > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    if not found.num_rows:
        return {}
    v = found["v"].combine_chunks()
    flat, ends = v.flatten().to_numpy(), v.offsets.to_numpy()
    return {k: flat[a - ends[0]:b - ends[0]] for k, a, b in zip(found["key"].to_pylist(), ends, ends[1:])}


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a table whose size is limited by the model, not by the data."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows
