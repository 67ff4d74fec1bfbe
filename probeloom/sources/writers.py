"""Write-once sinks with read-back verification."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.operators.checks import CheckFailed
from probeloom.sources.digests import fingerprint


def write_table(df: DataFrame, path: str, partition_by: str | None = None, verify: bool = False) -> DataFrame:
    """Parquet; an existing destination is refused. Returns the stored table."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    # Only partition columns come back with another type, guessed from their folders.
    kinds = dict(stored.dtypes)
    stored = stored.select(*[
        F.col(f.name) if kinds[f.name] == f.dataType.simpleString() else F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields
    ])
    if verify:
        verify_stored(df, stored)
    return stored


def verify_stored(df: DataFrame, stored: DataFrame) -> None:
    """Row count and order-free content fingerprint must survive the round trip."""
    before, after = fingerprint(df).first(), fingerprint(stored).first()
    if before != after:
        raise CheckFailed(f"stored table differs: {before} became {after}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def write_report(spark: SparkSession, values: dict, path: str) -> dict:
    """A JSON report of driver-side settings next to the data; write-once."""
    text = json.dumps(values, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return values


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything can be read at ``path``, on whatever file system it names."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return True
    except AnalysisException:
        return False


def refuse_existing(spark: SparkSession, path: str) -> None:
    if exists(spark, path):
        raise FileExistsError(f"{path} exists; choose a new output")


def append_fold(df: DataFrame, path: str, partition_by: str = "outer_grp") -> None:
    """Add the rows of one fold as new partitions; a fold that is there already is refused."""
    spark = df.sparkSession
    if exists(spark, path):
        there = spark.read.parquet(path).select(F.col(partition_by).cast("string")).distinct()
        again = df.select(F.col(partition_by).cast("string")).distinct().join(there, partition_by).limit(1).collect()
        if again:
            raise FileExistsError(f"{path}: fold {again[0][0]} has been written")
    df.write.mode("append").partitionBy(partition_by).parquet(path)
