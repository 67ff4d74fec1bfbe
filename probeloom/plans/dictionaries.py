"""Stored dictionary runs and grids."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.operators import checks, coding, dictionary
from probeloom.operators.checks import CheckFailed, assert_empty
from probeloom.operators.dictionary import Fitted, Setting
from probeloom.sources.digests import checksum
from probeloom.session import bounded_rows
from probeloom.sources.writers import exists, write_report, write_table

ATOL = 1e-4
MAX_RUNS = 10_000


def candidate_name(s: Setting) -> str:
    return f"k{s.atoms}_a{float(s.alpha)!r}_s{s.seed}_e{s.epochs}"


def candidates(grid: DataFrame) -> list[Setting]:
    """Settings of a parameter grid in grid order."""
    rows = grid.collect()
    found = [Setting("", r["atoms"], r["alpha"], r["seed"], r["epochs"]) for r in rows]
    for s in found:
        s.name = candidate_name(s)
    return found


# What identifies a run: two runs that agree in these columns are the same run.
RUN_KEYS = ("atoms", "alpha", "seed", "epochs", "batches", "manifest_checksum", "vectors_checksum")
KEY_SCHEMA = "atoms int, alpha double, seed long, epochs int, batches int, manifest_checksum string, vectors_checksum string"
FIGURES = tuple(f"{split}_{m}" for split in ("train", "validation") for m in ("relative_mse", "active_fraction", "mean_active_atoms"))
RUN_SCHEMA = (f"{KEY_SCHEMA}, path string, epochs_run int, reached_epoch_budget boolean, atoms_checksum string, "
              "codes_checksum string, " + ", ".join(f"{f} double" for f in FIGURES))


def store_run(vectors: DataFrame, fit: Fitted, path: str) -> dict:
    """Write atoms and codes of one fit to a new folder and return what the run table keeps of it.

    ``vectors``: entity_id, label, grp, split, vec for train and validation. A
    sample of the codes must come out again when it is encoded anew.
    """
    spark, s, d = vectors.sparkSession, fit.setting, fit.atoms
    atoms = write_table(dictionary.atoms_table(spark, [fit]), f"{path}/atoms")
    assert_empty(checks.atom_violations(atoms), f"{path}: atoms")
    coded = coding.encode(vectors, d, s.alpha)
    # Codes and reconstruction errors come from the same rows: nothing is joined back.
    error = coding.reconstruction(d)(F.col("vec").cast("array<double>"), F.col("z"))
    stored = write_table(coded.select("entity_id", "label", "grp", "z", error.alias("error"), "split"), f"{path}/codes", partition_by="split")
    assert_empty(checks.vector_violations(stored, len(d), "z"), f"{path}: codes")
    sample = stored.orderBy("entity_id").limit(8).select("entity_id", "z")
    again = coding.encode(vectors.join(F.broadcast(sample.select("entity_id")), "entity_id"), d, s.alpha, out="z2")
    worst = again.join(F.broadcast(sample), "entity_id").agg(
        F.max(F.array_max(F.zip_with("z", "z2", lambda a, b: F.abs(a - b))))
    ).first()[0]
    if worst is None or worst > ATOL:
        raise CheckFailed(f"{path}: encoding again moves the stored codes by {worst}")
    by_split = {r["split"]: r for r in coding.summed_errors(stored, d.shape[1], len(d)).collect()}
    return dict(
        path=path, epochs_run=fit.epochs_run, reached_epoch_budget=fit.epochs_run >= s.epochs,
        atoms_checksum=checksum(atoms), codes_checksum=checksum(stored),
        **{f: float(by_split[f.split("_", 1)[0]][f.split("_", 1)[1]]) for f in FIGURES},
    )


def finished_runs(spark: SparkSession, root: str) -> DataFrame:
    """The run table below ``root``. A run is finished once it has a row here, whatever else lies in its folder."""
    if not exists(spark, f"{root}/runs"):
        return spark.createDataFrame([], RUN_SCHEMA)
    return spark.read.schema(RUN_SCHEMA).parquet(f"{root}/runs")


def refuse_changed(spark: SparkSession, runs: DataFrame) -> None:
    """Reused runs must still hold what they held when they were written."""
    for r in bounded_rows(runs, MAX_RUNS, "dictionary runs"):
        now = [checksum(spark.read.parquet(f"{r['path']}/{part}")) for part in ("atoms", "codes")]
        if now != [r["atoms_checksum"], r["codes_checksum"]]:
            raise CheckFailed(f"{r['path']}: its files are not those of the finished run")


def run_grid(vectors: DataFrame, settings: Sequence[Setting], root: str, manifest_checksum: str,
             batches: int = 4) -> DataFrame:
    """One row per candidate: its settings and the figures of its run.

    Wanted settings that the run table lacks are fitted together, each batch of
    rows being read once for all of them. Runs left unfinished by a crash have no
    row, so they are neither reused nor in the way.
    """
    spark = vectors.sparkSession
    source = checksum(vectors.select("entity_id", "split", "vec"))
    wanted = spark.createDataFrame(
        [(n, i, s.atoms, float(s.alpha), s.seed, s.epochs, batches, manifest_checksum, source)
         for i, (n, s) in enumerate((candidate_name(s), s) for s in settings)],
        f"candidate string, place int, {KEY_SCHEMA}",
    )
    runs = finished_runs(spark, root)
    if runs.filter(F.col("manifest_checksum") != manifest_checksum).limit(1).count():
        raise CheckFailed(f"{root}: the grid belongs to another split")
    refuse_changed(spark, runs.join(F.broadcast(wanted.select(*RUN_KEYS)), list(RUN_KEYS), "left_semi"))
    todo = wanted.join(runs.select(*RUN_KEYS), list(RUN_KEYS), "left_anti").orderBy("place").collect()
    if todo:
        fits = dictionary.fit_dictionaries(vectors.filter("split = 'train'"), [settings[r["place"]] for r in todo], batches)
        for r, fit in zip(todo, fits):
            path = f"{root}/{r['candidate']}"
            if exists(spark, path):  # left by a run that did not finish, or one of other batches or vectors
                path = f"{path}-{uuid.uuid4().hex}"
            row = {**{k: r[k] for k in RUN_KEYS}, **store_run(vectors, fit, path)}
            write_report(spark, row, f"{path}/report")
            spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(f"{root}/runs")
    found = wanted.join(finished_runs(spark, root), list(RUN_KEYS))
    return found.orderBy("place").select(
        "candidate", "atoms", "alpha", "seed", "epochs", "epochs_run", "reached_epoch_budget", *FIGURES, "path"
    )
