"""Saved splits, verified cohorts, prepared features and representation bundles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.functions.scalars import SPLITS, TARGET_SUM
from probeloom.operators import checks, features, panels
from probeloom.operators.checks import CheckFailed, assert_empty
from probeloom.operators.split import Split
from probeloom.session import bounded_rows
from probeloom.sources.digests import checksum
from probeloom.sources.writers import read_report, refuse_existing, write_report, write_table

KEYS = ("entity_id", "label", "grp")


def _counts_by(df: DataFrame, column: str) -> dict[str, int]:
    rows = bounded_rows(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), checks.MAX_CLASSES, column)
    return {r[0]: r[1] for r in rows}


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise CheckFailed(message)


# --- split bundle -------------------------------------------------------------

def save_split(result: Split, entities: DataFrame, path: str, confirmed: bool = False) -> dict:
    """Write manifest, exclusions, counts and settings to a new folder."""
    spark = entities.sparkSession
    refuse_existing(spark, path)
    manifest = write_table(result.manifest, f"{path}/manifest", verify=True)
    excluded = write_table(result.excluded, f"{path}/exclusions")
    write_table(result.split_counts, f"{path}/split_counts")
    write_table(result.label_counts, f"{path}/label_counts")
    by_split = _counts_by(manifest, "split")
    return write_report(spark, dict(
        status="final" if confirmed else "draft", confirmed=confirmed, seed=result.seed,
        retained_rows=sum(by_split.values()), excluded_rows=excluded.count(), split_counts=by_split,
        entities_checksum=checksum(entities.select(*KEYS)), manifest_checksum=checksum(manifest),
    ), f"{path}/settings")


@dataclass(frozen=True)
class Cohort:
    counts: DataFrame      # counts of manifest entities
    manifest: DataFrame
    excluded: DataFrame
    settings: dict


def load_cohort(spark: SparkSession, bundle: str, entities: DataFrame, counts: DataFrame) -> Cohort:
    """Verify a saved split against the raw tables, then restrict the counts to it."""
    settings = read_report(spark, f"{bundle}/settings")
    _require(settings["status"] == "final" and settings["confirmed"], "a finalized, confirmed split is required")
    manifest, excluded = spark.read.parquet(f"{bundle}/manifest"), spark.read.parquet(f"{bundle}/exclusions")
    _require(checksum(entities.select(*KEYS)) == settings["entities_checksum"], "raw entities differ from the split's input")
    _require(checksum(manifest) == settings["manifest_checksum"], "the manifest has changed")
    assert_empty(checks.entity_violations(manifest), "manifest")
    assert_empty(checks.duplicate_ids(excluded), "exclusions")
    assert_empty(checks.domain_violations(manifest, "split", SPLITS), "split names")
    assert_empty(checks.coverage_gaps(manifest, "label", "split"), "labels missing from a split")
    assert_empty(checks.partition_violations(
        entities.select("entity_id"), manifest.select("entity_id"), excluded.select("entity_id")
    ), "manifest and exclusions must partition the entities")
    recorded = spark.createDataFrame(list(settings["split_counts"].items()), "split string, n_rows long")
    actual = manifest.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    assert_empty(checks.count_differences(actual, recorded, "split"), "split sizes differ from settings")
    _require(excluded.count() == settings["excluded_rows"], "exclusion count differs from settings")
    assert_empty(checks.attribute_mismatch(manifest, entities, ["label", "grp"]), "metadata differs from the manifest")
    assert_empty(checks.count_violations(counts), "counts must be finite, whole and not negative")
    assert_empty(checks.empty_entities(manifest, counts), "entities without counts")
    kept = counts.join(manifest.select("entity_id"), "entity_id", "left_semi")
    return Cohort(kept, manifest, excluded, settings)


# --- prepared features --------------------------------------------------------

def prepare(cohort: Cohort, path: str, n_features: int = 2000, target: float = TARGET_SUM,
            panel: DataFrame | None = None) -> dict:
    """Fit on training rows, transform every split, write vectors by split."""
    spark = cohort.manifest.sparkSession
    refuse_existing(spark, path)
    log_counts = features.normalize_log(cohort.counts, target)
    train_ids = cohort.manifest.filter("split = 'train'").select("entity_id")
    log_train = log_counts.join(train_ids, "entity_id", "left_semi")
    n_train = cohort.settings["split_counts"]["train"]
    if panel is None:
        fitted = features.fit_features(log_train, n_train, n_features)
    else:
        fitted = features.fit_panel(log_train, n_train, panel)
    fitted = write_table(fitted, f"{path}/fitted")
    n_selected = fitted.count()
    _require(n_selected > 0, "no variable training features")
    vectors = features.transform_vectors(log_counts, cohort.manifest, F.broadcast(fitted), n_selected)
    stored = write_table(vectors, f"{path}/vectors", partition_by="split")
    assert_empty(checks.vector_violations(stored, n_selected), "transformed vectors")
    return write_report(spark, dict(
        manifest_checksum=cohort.settings["manifest_checksum"], n_features_requested=n_features,
        n_features_selected=n_selected, target_sum=target, fitted_checksum=checksum(fitted),
        vectors_checksum={s: checksum(stored.filter(F.col("split") == s)) for s in SPLITS},
    ), f"{path}/report")


# --- verified representations -------------------------------------------------

def checked_vectors(vectors: DataFrame, manifest: DataFrame, name: str, dim: int | None = None) -> DataFrame:
    """Vectors whose IDs are exactly the manifest's, with finite values of one length.

    Label, group and split come from the manifest.
    """
    assert_empty(checks.membership_diff(manifest.select("entity_id"), vectors.select("entity_id")), f"{name}: entities")
    assert_empty(checks.duplicate_ids(vectors), f"{name}: repeated entities")
    assert_empty(checks.vector_violations(vectors, dim), f"{name}: vectors")
    for c in ("label", "grp"):
        if c in vectors.columns:
            assert_empty(checks.attribute_mismatch(manifest, vectors, [c]), f"{name}: {c}")
    return panels.align_vectors(manifest, vectors, strict=False)


def load_inputs(spark: SparkSession, bundle: str, features_path: str, dictionaries: dict[str, str] | None = None,
                embeddings: DataFrame | None = None) -> dict[str, DataFrame]:
    """Representations of the training and validation rows, verified and aligned.

    Only those two split partitions are opened; test rows stay unread.
    """
    settings, prep = read_report(spark, f"{bundle}/settings"), read_report(spark, f"{features_path}/report")
    _require(settings["status"] == "final", "a finalized split is required")
    _require(prep["manifest_checksum"] == settings["manifest_checksum"], "features were prepared for another split")
    manifest = spark.read.parquet(f"{bundle}/manifest")
    _require(checksum(manifest) == settings["manifest_checksum"], "the manifest has changed")
    known = manifest.filter("split IN ('train', 'validation')")
    expression = spark.read.parquet(f"{features_path}/vectors").filter("split IN ('train', 'validation')")
    for s in ("train", "validation"):
        stored = expression.filter(F.col("split") == s).select(*KEYS, "split", "vec")
        _require(checksum(stored) == prep["vectors_checksum"][s], f"{s} features have changed")
    assert_empty(checks.coverage_gaps(known, "label", "split"), "labels of train and validation differ")
    out = {"expression": checked_vectors(expression.drop("split"), known, "expression", prep["n_features_selected"])}
    source = checksum(out["expression"].select("entity_id", "split", "vec")) if dictionaries else None
    for name, folder in (dictionaries or {}).items():
        report = read_report(spark, f"{folder}/report")
        _require(report["manifest_checksum"] == settings["manifest_checksum"], f"{name}: fitted for another split")
        _require(report["vectors_checksum"] == source, f"{name}: fitted on other vectors")
        stored = spark.read.parquet(f"{folder}/codes")
        _require(checksum(stored) == report["codes_checksum"], f"{name}: codes have changed")
        _require(stored.filter("NOT split <=> 'train' AND NOT split <=> 'validation'").isEmpty(), f"{name}: codes of other splits")
        codes = stored.select("entity_id", F.col("z").alias("vec"))
        out[name] = checked_vectors(codes, known, name, report["atoms"])
    if embeddings is not None:
        excluded = spark.read.parquet(f"{bundle}/exclusions").select("entity_id")
        everyone = manifest.select("entity_id").unionByName(excluded)
        assert_empty(checks.membership_diff(everyone, embeddings), "embeddings must cover manifest and exclusions")
        mine = embeddings.join(known.select("entity_id"), "entity_id", "left_semi").select("entity_id", "vec")
        out["embedding"] = checked_vectors(mine, known, "embedding")
    return out


def check_handoff(provenance: DataFrame, digests: DataFrame) -> DataFrame:
    """Broken links of a digest chain.

    ``provenance``: child, parent, sha256 (the digest of the parent that the
    child recorded). ``digests``: path, sha256 of the files as they are now.
    """
    current = digests.select(F.col("path").alias("parent"), F.col("sha256").alias("actual"))
    return provenance.join(current, "parent", "left").filter("NOT (sha256 <=> actual)")
