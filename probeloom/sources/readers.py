"""File readers with explicit schemas, and the coordinate-matrix text format."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeloom.operators.checks import CheckFailed
from probeloom.operators.ranking import rank_rows
from probeloom.session import materialize


def read_text_table(spark: SparkSession, path, columns: Sequence[str], sep: str = ",", with_place: bool = False) -> DataFrame:
    """All-string CSV or TSV. Empty text stays empty text and is not NULL.

    Columns are matched to the header by name; a missing one is an error. With
    ``with_place`` rows also tell their file, split and order inside it.
    """
    header = spark.read.option("sep", sep).csv(path, header=True)
    missing = [c for c in columns if c not in header.columns]
    if missing:
        raise CheckFailed(f"{path}: missing columns {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header.columns])
    rows = spark.read.schema(schema).option("sep", sep).option("emptyValue", "").option("quote", '"').csv(path, header=True)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
             F.monotonically_increasing_id().alias("_row")] if with_place else []
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns], *place)


def read_exclusions(spark: SparkSession, path, column: str = "cell_id") -> DataFrame:
    return read_text_table(spark, path, [column]).withColumnRenamed(column, "entity_id")


def read_panel(spark: SparkSession, path) -> DataFrame:
    """panel_pos, panel_id, feature_name in file order (TSV feature_id, feature_name)."""
    rows = read_text_table(spark, path, ["feature_id", "feature_name"], sep="\t")
    placed = rows.withColumn("_line", F.monotonically_increasing_id())
    return rank_rows(placed, ["_line"], "panel_pos").select(
        "panel_pos", F.col("feature_id").alias("panel_id"), "feature_name"
    )


def read_reports(spark: SparkSession, paths, schema: str) -> DataFrame:
    """Many JSON reports as one table, with the folder each came from."""
    return spark.read.schema(schema).option("multiLine", True).json(paths).withColumn(
        "evaluation_dir", F.regexp_replace(F.input_file_name(), "/[^/]*$", "")
    )


def grid(spark: SparkSession, atoms: Sequence[int], alpha: Sequence[float], seeds: Sequence[int], epochs: int) -> DataFrame:
    """Parameter grid atoms x alpha x seeds, nested in that order."""
    for name, values in (("atoms", atoms), ("alpha", alpha), ("seeds", seeds)):
        if not values or len(set(values)) != len(values):
            raise ValueError(f"{name}: empty, or a value is listed twice")
    if min(atoms) < 1 or epochs < 1 or min(alpha) <= 0 or min(seeds) < 0:
        raise ValueError("atoms and epochs start at 1, seeds at 0, and alpha is above 0")
    one = spark.range(1).select(
        F.explode(F.array(*[F.lit(int(k)) for k in atoms])).alias("atoms")
    ).select("atoms", F.explode(F.array(*[F.lit(float(a)) for a in alpha])).alias("alpha"))
    return one.select(
        "atoms", "alpha", F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds])).alias("seed"),
        F.lit(int(epochs)).alias("epochs"),
    )


# --- coordinate text ----------------------------------------------------------

def stored_coordinates(spark: SparkSession, path: str, verify: bool = True) -> tuple[DataFrame, tuple[int, int, int]]:
    """Entries as :func:`read_coordinates` gives them, and the features, entities and entries of the size line.

    The text is scanned once: its numbers are stored, and the size line, the checks and every later
    use read the stored columns.
    """
    lines = spark.read.text(path).select(
        F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
    ).filter("line <> '' AND NOT startswith(line, '%')")
    # Single spaces, as most exports have, need no pattern.
    other = reduce(or_, [F.contains("line", F.lit(c)) for c in ("  ", "\t", "\x0b", "\f", "\r")])
    parts = F.when(other, F.split("line", r"\s+")).otherwise(F.split("line", " "))
    stored = materialize(lines.select(
        # Rows beyond the first block of a file cannot be the size line and need no place.
        *[F.when(F.col("block") == 0, F.col(c)).alias(c) for c in ("file", "row")],
        parts[0].cast("long").alias("a"), parts[1].cast("long").alias("b"), parts[2].cast("double").alias("c")), "coordinates")
    name = stored.agg(F.min("file")).first()[0]
    if name is None:
        raise CheckFailed(f"{path}: no size line")
    place = stored.filter(F.col("file") == name).agg(F.min("row")).first()[0]
    n_features, n_entities, n_entries = size = tuple(int(v) for v in stored.filter(F.col("row") == place).select("a", "b", "c").first())
    first = F.col("row").eqNullSafe(place)
    entries = stored.filter(~first).select(
        (F.col("a") - 1).alias("feature_pos"), (F.col("b") - 1).alias("entity_pos"), F.col("c").alias("cnt"))
    if verify:
        seen = entries.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(
                ~F.col("feature_pos").between(0, n_features - 1) | ~F.col("entity_pos").between(0, n_entities - 1)
            ).alias("outside"),
        ).first()
        if seen["n"] != n_entries or seen["outside"]:
            raise CheckFailed(f"{path}: {seen['n']} entries ({seen['outside']} outside), size line says {n_entries}")
    return entries, size


def coordinate_size(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Features, entities and entries as the size line gives them."""
    return stored_coordinates(spark, path, verify=False)[1]


def read_coordinates(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """Zero-based (feature_pos, entity_pos, cnt) from 1-based feature x entity text.

    Lines starting with % are comments; the first other line holds the numbers
    of features, entities and entries. The file is split and parsed in
    parallel; the size line is looked for in the first block of the first file.
    """
    return stored_coordinates(spark, path, verify)[0]


def write_coordinates(entries: DataFrame, path: str, n_features: int, n_entities: int) -> None:
    """Write (feature_pos, entity_pos, cnt) as coordinate text.

    Entry lines are written in parallel and counted on the way; the size line
    follows in a file of its own that sorts before them.
    """
    seen = Observation()
    line = F.concat_ws(
        " ", (F.col("feature_pos") + 1).cast("string"), (F.col("entity_pos") + 1).cast("string"),
        F.col("cnt").cast("long").cast("string"),
    )
    lines = entries.select(line.alias("value")).observe(seen, F.count(F.lit(1)).alias("n"))
    lines.write.text(f"{path}/part=1")
    head = "%%MatrixMarket matrix coordinate integer general\n" + f"{n_features} {n_entities} {seen.get['n']}"
    entries.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/part=0")
