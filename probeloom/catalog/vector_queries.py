"""Queries over the vector profile: probes, codes, atoms, group study."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.functions import scalars as S
from probeloom.functions import vectors as V
from probeloom.operators import (
    atoms, checks, coding, comparison, features, groups, metrics, panels, probe, split,
)
from probeloom.operators import dictionary as dictionary_fit
from probeloom.operators.ranking import exact_quantile
from probeloom.plans import reports
from probeloom.session import bounded_rows, materialize, settle, spread
from probeloom.sources import tables as T

CLASSES = [str(i) for i in range(10)]
MAX_BLOCKS = 100_000

# Dictionaries used by the exact queries: normalized means of label classes over all
# rows of some groups. name: (atoms = label modulus, alpha, groups)
DICTIONARIES = {
    "k10_a0.1_low": (10, 0.1, ("0", "1")),
    "k10_a0.1_high": (10, 0.1, ("2", "3")),
    "k5_a0.1_all": (5, 0.1, ("0", "1", "2", "3")),
    "k5_a0.3_all": (5, 0.3, ("0", "1", "2", "3")),
}
FIRST, NEXT = "k10_a0.1_low", "k10_a0.1_high"


def r(name: str, decimals: int = 6):
    return F.round(F.col(name), decimals).alias(name)


def round_doubles(df: DataFrame, decimals: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[
        F.round(c, decimals).alias(c) if kinds[c] == "double"
        else F.col(c).cast("long").alias(c) if kinds[c] == "int" else F.col(c)
        for c in df.columns
    ])


def vector_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, label, grp, vec, split; the vectors are not shuffled."""
    vectors = T.vector_entities(spark, sf_dir)
    s = split.stratified_split(vectors.select("entity_id", "label", "grp"), validate=False)
    return s.assign(vectors)


def mean_atoms(rows: DataFrame, k: int) -> np.ndarray:
    """Unit vectors along the means of the ``k`` label classes."""
    key = (F.col("label").cast("int") % k).alias("atom")
    means = rows.groupBy(key).agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("m"))
    x = np.array([row["m"] for row in sorted(bounded_rows(means, k, "atoms"), key=lambda row: row["atom"])])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def dictionary(spark: SparkSession, sf_dir: str, name: str) -> tuple[np.ndarray, float]:
    k, alpha, grps = DICTIONARIES[name]
    return mean_atoms(T.vector_entities(spark, sf_dir).filter(F.col("grp").isin(*grps)), k), alpha


def atoms_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    d, _ = dictionary(spark, sf_dir, name)
    return spark.createDataFrame(
        [(i + 1, [float(v) for v in row]) for i, row in enumerate(d)], "atom int, weights array<double>"
    )


def coded(spark: SparkSession, sf_dir: str, name: str = FIRST) -> DataFrame:
    d, alpha = dictionary(spark, sf_dir, name)
    return coding.encode(vector_split(spark, sf_dir), d, alpha)


# --- class-mean scores --------------------------------------------------------
# A closed-form stand-in for fitted probes, so that metrics and selection rules
# can be checked exactly in SQL: score = log prior - C * squared distance to the
# class mean of the (standardized) training rows.

def class_sums(rows: DataFrame, keys=("grp",)) -> list:
    """Per key and label: row count, sums and sums of squares. Model-size rows."""
    x = array_to_vector(F.col("vec").cast("array<double>"))
    table = rows.groupBy(*keys, "label").agg(
        Summarizer.metrics("count", "sum", "normL2").summary(x).alias("m")
    ).select(*keys, "label", "m.*")
    return bounded_rows(table, MAX_BLOCKS, "class sums")


def mean_probe(sums: list, classes: list[str], C: float = 0.5, scaling: str = "none") -> probe.Probe:
    n = {c: 0 for c in classes}
    total = {c: 0.0 for c in classes}
    squares = 0.0
    for row in sums:
        n[row["label"]] += row["count"]
        total[row["label"]] = total[row["label"]] + row["sum"].toArray()
        squares = squares + row["normL2"].toArray() ** 2
    rows = sum(n.values())
    center = sum(total.values()) / rows
    scale = np.sqrt(np.maximum(squares / rows - center ** 2, 0))
    scale = np.where(scale < 1e-12, 1.0, scale)
    if scaling == "none":
        center, scale = np.zeros_like(center), np.ones_like(scale)
    m = np.array([(total[c] / n[c] - center) / scale for c in classes])
    prior = np.log(np.array([n[c] / rows for c in classes]))
    coef = 2 * C * m / scale
    intercept = prior - C * (m ** 2).sum(axis=1) - coef @ center
    return probe.Probe(classes, coef, intercept, C, 0, True)


def predictions(spark: SparkSession, sf_dir: str, scaling: str = "none") -> DataFrame:
    """Rows outside training, scored by training class means."""
    rows = vector_split(spark, sf_dir)
    sums = class_sums(rows.filter("split = 'train'"), keys=())
    scored = probe.native_score(rows.filter("split <> 'train'"), mean_probe(sums, CLASSES, scaling=scaling))
    return metrics.with_prediction(scored, CLASSES)


def centroid_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select(
        "entity_id", "label", "split", "prediction", F.round(F.array_max("probs"), 6).alias("p_top")
    )


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(metrics.confusion(predictions(spark, sf_dir), CLASSES), CLASSES)


def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.per_class(metrics.confusion(predictions(spark, sf_dir), CLASSES))
    return round_doubles(table.drop("loss"))


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(metrics.report(metrics.confusion(predictions(spark, sf_dir), CLASSES)))


def absent_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report over the fixed class list when one class has no true rows but is still predicted."""
    rows = predictions(spark, sf_dir).filter("label <> '3'")
    return round_doubles(metrics.report(metrics.confusion(rows, CLASSES), labels=CLASSES))


def scalar_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.scored_metrics(predictions(spark, sf_dir), CLASSES, ["split"])
    return round_doubles(rows)


def attribute_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest labels against predicted labels."""
    p = predictions(spark, sf_dir)
    return checks.attribute_mismatch(
        p.select("entity_id", "label"), p.select("entity_id", F.col("prediction").alias("label")), ["label"]
    )


def probability_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability mass, shared cohort and recomputed metrics of two evaluations."""
    a, b = predictions(spark, sf_dir), predictions(spark, sf_dir, "standard")
    m_a = settle(metrics.scored_metrics(a, CLASSES, ["split"]))
    m_b = settle(metrics.scored_metrics(b, CLASSES, ["split"]))
    kinds = [
        ("bad_mass", checks.probability_violations(a)),
        ("cohort", checks.cohort_differences(a, b)),
        ("recomputed", checks.metric_differences(
            m_a, metrics.scored_metrics(a, CLASSES, ["split"]), ["split"], metrics.METRICS)),
        ("scaling_changes", checks.metric_differences(m_a, m_b, ["split"], metrics.METRICS, 1e-9)),
    ]
    out = None
    for name, df in kinds:
        row = df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


# --- vectors and folds --------------------------------------------------------

def vector_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.vector_entities(spark, sf_dir)
    return rows.groupBy(F.size("vec").cast("long").alias("dim")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~V.all_finite(F.col("vec"))).alias("n_not_finite"),
        F.round(F.min(V.norm(F.col("vec"))), 6).alias("min_norm"),
        F.round(F.max(V.norm(F.col("vec"))), 6).alias("max_norm"),
    )


def aligned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training reference list with its vectors, opened to one row per coordinate."""
    vectors = T.vector_entities(spark, sf_dir)
    s = split.stratified_split(vectors.select("entity_id", "label", "grp"), validate=False)
    reference = s.manifest.filter("split = 'train'")
    return panels.align_vectors(reference, vectors).select(
        "entity_id", "label", "grp", F.posexplode("vec").alias("dim", "value")
    ).select("entity_id", "label", "grp", F.col("dim").cast("long").alias("dim"), r("value"))


def scaled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_split(spark, sf_dir)
    stats = features.vector_moments(rows.filter("split = 'train'"))
    return features.standardize(rows, stats).select(
        "entity_id", "split", F.posexplode("vec").alias("dim", "value")
    ).select("entity_id", "split", F.col("dim").cast("long").alias("dim"), r("value"))


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardized vectors brought back to unit length."""
    rows = vector_split(spark, sf_dir)
    scaled = features.standardize(rows, features.vector_moments(rows.filter("split = 'train'")))
    return scaled.select("entity_id", F.posexplode(V.l2_normalize(F.col("vec"))).alias("dim", "value")).select(
        "entity_id", F.col("dim").cast("long").alias("dim"), r("value")
    )


def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = T.vector_entities(spark, sf_dir).select("entity_id", "label", "grp")
    return groups.group_folds(entities)


def fold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold sizes, and the leaks that appear when folds are cut by label instead."""
    folds = group_folds(spark, sf_dir)
    clean = folds.groupBy("outer_grp").agg(
        F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "hold").alias("n_hold")
    )
    careless = folds.withColumn("role", F.when(F.col("label") < "3", "hold").otherwise("train"))
    leaks = checks.fold_leaks(careless).groupBy("outer_grp").agg(F.count(F.lit(1)).alias("n_leaks_by_label"))
    none = checks.fold_leaks(folds).groupBy("outer_grp").agg(F.count(F.lit(1)).alias("n_leaks"))
    return clean.join(leaks, "outer_grp").join(none, "outer_grp", "left").select(
        "outer_grp", "n_train", "n_hold", F.coalesce("n_leaks", F.lit(0)).alias("n_leaks"), "n_leaks_by_label"
    )


# --- group study with class means ---------------------------------------------

def representations(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, DataFrame]]:
    """(method, seed, rows) with rows: entity_id, label, grp, vec."""
    base = T.vector_entities(spark, sf_dir)
    out = [("embedding", -1, base)]
    for seed, name in enumerate((FIRST, NEXT)):
        d, alpha = dictionary(spark, sf_dir, name)
        out.append(("codes", seed, coding.encode(base, d, alpha, out="z").select(
            "entity_id", "label", "grp", F.col("z").alias("vec"))))
    return out


def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, seed, scaling, grp and metrics: each group scored by the others.

    Class sums per group are additive, so one scan trains every fold and one
    more scores all folds and scalings.
    """
    out = None
    for method, seed, rows in representations(spark, sf_dir):
        sums = class_sums(rows)
        names = sorted({row["grp"] for row in sums})
        keys = [(s, g) for s in ("none", "standard") for g in names]
        models = [mean_probe([x for x in sums if x["grp"] != g], CLASSES, scaling=s) for s, g in keys]
        table = probe.confusion_of(rows, models, groups=[g for _, g in keys])
        named = F.array(*[F.struct(F.lit(s).alias("scaling"), F.lit(g).alias("grp")) for s, g in keys])
        scored = metrics.scalar_metrics(table, ["model"]).select(
            F.lit(method).alias("method"), F.lit(seed).cast("long").alias("seed"),
            named[F.col("model")].alias("k"), *["n_rows", *metrics.METRICS],
        ).select("method", "seed", "k.*", "n_rows", *metrics.METRICS)
        out = scored if out is None else out.unionByName(scored)
    return out


def metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(group_metrics(spark, sf_dir))


def two_level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(comparison.two_level_summary(group_metrics(spark, sf_dir)))


def seed_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(comparison.seed_variation(group_metrics(spark, sf_dir)))


def paired_group_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(comparison.paired_differences(group_metrics(spark, sf_dir), "embedding", ["codes"]))


def report_f1_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardized F1 by group and method with the seed SD, as printed text."""
    rows = group_metrics(spark, sf_dir).filter("scaling = 'standard'")
    cells = comparison.seed_variation(rows).groupBy("grp").pivot("method", ["embedding", "codes"]).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std")
    )
    return cells.select(
        "grp", S.fixed_text(F.col("embedding_mean"), 6).alias("embedding"),
        S.fixed_text(F.col("codes_mean"), 6).alias("codes"), S.fixed_text(F.col("codes_std"), 6).alias("seed_sd"),
    )


def report_f1_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class F1 of both scalings with the support, as printed text."""
    return reports.f1_by_class({
        name: metrics.report(metrics.confusion(predictions(spark, sf_dir, scaling), CLASSES))
        for name, scaling in (("plain", "none"), ("standardized", "standard"))
    })


def report_atom_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading positive coordinates of every atom with its standardized class means."""
    top = atoms.top_signed(atoms_of(spark, sf_dir, FIRST), 3).withColumn("feature", F.concat(F.lit("dim"), F.col("pos")))
    activity = atoms.code_activity(coded(spark, sf_dir))
    return round_doubles(reports.selected_activity(
        activity, top, [(a, c) for a in range(1, 11) for c in CLASSES]
    ))


# --- selection ----------------------------------------------------------------

def search_rows(spark: SparkSession, sf_dir: str, names=(FIRST, NEXT)) -> DataFrame:
    """feature_set, C and validation metrics of class-mean scores over the coarse grid."""
    rows = vector_split(spark, sf_dir)
    sets = [("embedding", rows)]
    for name in names:
        d, alpha = dictionary(spark, sf_dir, name)
        sets.append((name, coding.encode(rows, d, alpha, out="z").withColumn("vec", F.col("z"))))
    out = None
    for name, df in sets:
        sums = class_sums(df.filter("split = 'train'"), keys=())
        models = [mean_probe(sums, CLASSES, C=c) for c in S.COARSE_C]
        table = probe.confusion_of(df.filter("split = 'validation'"), models)
        scored = metrics.scalar_metrics(table, ["model"]).select(
            F.lit(name).alias("feature_set"), V.literal(S.COARSE_C)[F.col("model")].alias("C"),
            F.round("macro_f1", 9).alias("val_macro_f1"), F.round("log_loss", 9).alias("val_log_loss"),
            (F.col("log_loss") < 5).alias("converged"),
        )
        out = scored if out is None else out.unionByName(scored)
    return out


def best_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(comparison.best_c(search_rows(spark, sf_dir)))


def refined_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New C values around the winner of each feature set."""
    return comparison.best_c(search_rows(spark, sf_dir)).select(
        "feature_set", F.posexplode(S.fine_grid(F.col("C"))).alias("step", "C")
    ).select("feature_set", F.col("step").cast("long").alias("step"), F.round("C", 6).alias("C"))


def dictionary_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = list(DICTIONARIES)
    best = comparison.best_c(search_rows(spark, sf_dir, names)).filter(F.col("feature_set") != "embedding")
    best = best.withColumnRenamed("feature_set", "candidate")
    held = vector_split(spark, sf_dir).filter("split = 'validation'")
    out = None
    for name in names:
        d, alpha = dictionary(spark, sf_dir, name)
        row = coding.reconstruction_metrics(coding.encode(held, d, alpha), d).select(
            F.lit(name).alias("candidate"), F.lit(len(d)).alias("atoms"),
            F.col("mean_active_atoms").alias("validation_mean_active_atoms"),
            F.col("relative_mse").alias("validation_relative_mse"),
        )
        out = row if out is None else out.unionByName(row)
    return round_doubles(comparison.rank_dictionaries(best, out).select(
        "rank", "candidate", "C", "val_macro_f1", "atoms", "validation_mean_active_atoms", "validation_relative_mse"
    ))


def inner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """outer_grp, inner_grp, lambda and metrics: nested folds on the embeddings."""
    rows = T.vector_entities(spark, sf_dir)
    sums = class_sums(rows)
    names = sorted({x["grp"] for x in sums})
    keys = [(o, i, lam) for o, i in groups.nested_folds(names) if i is not None for lam in S.LAMBDAS]
    models = []
    for o, i, lam in keys:
        part = [x for x in sums if x["grp"] not in (o, i)]
        models.append(mean_probe(part, CLASSES, C=1.0 / (sum(x["count"] for x in part) * lam)))
    table = probe.confusion_of(rows, models, groups=[i for _, i, _ in keys])
    named = F.array(*[
        F.struct(F.lit(o).alias("outer_grp"), F.lit(i).alias("inner_grp"), F.lit(lam).alias("lambda"))
        for o, i, lam in keys
    ])
    return metrics.scalar_metrics(table, ["model"]).select(
        named[F.col("model")].alias("k"), F.round("macro_f1", 9).alias("macro_f1"),
        (F.col("log_loss") < 5).alias("converged"),
    ).select("k.*", "macro_f1", "converged")


def best_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(comparison.best_lambda(inner_rows(spark, sf_dir), ["outer_grp"]))


def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (fold, dictionary candidate, penalty) with C = 1/(n * lambda)."""
    folds = group_folds(spark, sf_dir).groupBy("outer_grp").agg(F.count_if(F.col("role") == "train").alias("n_train"))
    steps = [("atoms", [32, 64], "int"), ("alpha", [0.5, 1.0, 2.0], "double"), ("seed", [0, 1, 2], "long"),
             ("lambda", list(S.LAMBDAS), "double")]
    out = folds
    for name, values, kind in steps:
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kind) for v in values])))
    return round_doubles(out.select(
        "outer_grp", S.candidate_key(F.col("atoms"), F.col("alpha"), F.col("seed"), F.lit(10)).alias("candidate"),
        "lambda", "n_train", S.inverse_strength(F.col("n_train"), F.col("lambda")).alias("C"),
    ))


# --- codes and atoms ----------------------------------------------------------

def _long(codes: DataFrame, column: str = "z", decimals: int = 6) -> DataFrame:
    return codes.select("entity_id", F.posexplode(column).alias("a", "value")).select(
        "entity_id", (F.col("a") + 1).cast("long").alias("atom"), F.round("value", decimals).alias("value")
    )


def sparse_codes_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, alpha = dictionary(spark, sf_dir, FIRST)
    rows = spread(T.vector_entities(spark, sf_dir))
    return _long(rows.withColumn("z", coding.native_code(F.col("vec"), d, alpha, 300)))


def sparse_codes_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, alpha = dictionary(spark, sf_dir, FIRST)
    return _long(coding.encode(T.vector_entities(spark, sf_dir), d, alpha))


def _code_residuals(spark: SparkSession, sf_dir: str):
    """Optimality residuals of the converged codes and, for comparison, of the code zero."""
    d, alpha = dictionary(spark, sf_dir, FIRST)
    rows = spread(T.vector_entities(spark, sf_dir))
    found = coding.encode(rows, d, alpha).withColumn("code", F.lit("converged"))
    zero = rows.withColumn("z", F.array_repeat(F.lit(0.0), len(d))).withColumn("code", F.lit("zero"))
    both = found.unionByName(zero).withColumn("entity_id", F.concat_ws(":", "code", F.col("entity_id").cast("string")))
    return both.withColumn("kkt", coding.kkt(d, alpha)(F.col("vec").cast("array<double>"), F.col("z"))), alpha


def kkt_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_code_residuals(spark, sf_dir)[0], "kkt")


def kkt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, alpha = _code_residuals(spark, sf_dir)
    values = materialize(rows.select(F.explode("kkt").alias("v")), "residuals")
    p95 = exact_quantile(values, "v", 0.95)
    return values.agg(
        F.round(F.max("v"), 6).alias("max_residual"), F.round(F.lit(p95), 6).alias("p95"),
        F.round(F.max("v") / max(1.0, alpha), 6).alias("relative_max"),
    )


def code_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(atoms.code_activity(coded(spark, sf_dir)))


def code_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(atoms.code_usage(coded(spark, sf_dir)))


def reconstruction_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, _ = dictionary(spark, sf_dir, FIRST)
    return round_doubles(coding.reconstruction_metrics(coded(spark, sf_dir), d))


def atom_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class means of the embeddings checked as atoms against a norm bound."""
    x = array_to_vector("vec")
    means = T.vector_entities(spark, sf_dir).groupBy("label").agg(Summarizer.mean(x).alias("m"))
    table = means.select(F.col("label").alias("atom"), vector_to_array("m").alias("weights"))
    return round_doubles(checks.atom_violations(table, 0.14))


def top_features_per_atom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(atoms.top_signed(atoms_of(spark, sf_dir, FIRST), 10))


def top_absolute_per_atom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(atoms.top_absolute(atoms_of(spark, sf_dir, FIRST)))


def atom_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(atoms.self_similarity(atoms_of(spark, sf_dir, FIRST)))


def atom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(atoms.order_by_contrast(atoms.code_activity(coded(spark, sf_dir))))


def atom_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(atoms.atom_diagnostics(
        atoms_of(spark, sf_dir, FIRST), atoms.code_activity(coded(spark, sf_dir))
    ))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = T.vector_entities(spark, sf_dir)
    (da, alpha), (db, _) = (dictionary(spark, sf_dir, n) for n in (FIRST, NEXT))
    codes = coding.encode(coding.encode(base, da, alpha, out="za"), db, alpha, out="zb")
    return atoms.atom_pairs(atoms_of(spark, sf_dir, FIRST), atoms_of(spark, sf_dir, NEXT), codes)


def atom_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(_pairs(spark, sf_dir))


def atom_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(atoms.match_atoms(_pairs(spark, sf_dir)))


SEEDS = (0, 1, 2)
SEED_ALPHA = 0.1


def seed_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability of class-mean dictionaries under every held-out group and pair of seeds.

    A seed leaves out every third row. Sums per (group, third, label) give all
    dictionaries; the codes of all of them and their products come from one scan.
    """
    rows = T.vector_entities(spark, sf_dir)
    third = F.col("entity_id").cast("long") % len(SEEDS)
    sums = class_sums(rows.withColumn("third", third), keys=("grp", "third"))
    names = sorted({row["grp"] for row in sums})
    dicts = {}
    for fold in names:
        for seed in SEEDS:
            own = [row for row in sums if row["grp"] != fold and row["third"] != seed]
            total = {c: sum(row["sum"].toArray() for row in own if row["label"] == c) for c in CLASSES}
            x = np.array([total[c] for c in CLASSES])
            dicts[fold, seed] = x / np.linalg.norm(x, axis=1, keepdims=True)
    coded_rows = rows.select("grp", *[coding.encoder(d, SEED_ALPHA)(F.col("vec")).alias(f"z_{f}_{s}") for (f, s), d in dicts.items()])
    parts = F.array(*[F.struct(F.lit(f).alias("key"), F.concat(*[F.col(f"z_{f}_{s}") for s in SEEDS]).alias("z")) for f in names])
    train = coded_rows.select(F.inline(F.filter(parts, lambda part: part["key"] != F.col("grp"))))
    return round_doubles(atoms.stability(atoms.match_seeds(train, dicts), ["grp", "seed_a", "seed_b"]))


N_DIRECTIONS = 3


def singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading singular values of the embeddings by the range finder, with their share of all squares.

    The block is as wide as the vectors, so that it holds every direction and the values are exact
    however close to each other they are; a narrower one needs more scans the closer they come.
    """
    rows = T.vector_entities(spark, sf_dir)
    total, width = rows.agg(F.sum(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)), F.max(F.size("vec"))).first()
    (values, _), = dictionary_fit.leading_directions(rows, [dictionary_fit.Setting("all", width, 1.0, 0)], power=1)
    found = [(i + 1, float(v), float(v) ** 2 / total) for i, v in enumerate(values[:N_DIRECTIONS])]
    return round_doubles(spark.createDataFrame(found, "rank long, singular_value double, share double"), 5)


QUERIES = {
    "singular_values": singular_values,
    "seed_stability": seed_stability,
    "vector_quality": vector_quality,
    "aligned_vectors": aligned_vectors,
    "scaled_vectors": scaled_vectors,
    "unit_vectors": unit_vectors,
    "group_folds": group_folds,
    "fold_audit": fold_audit,
    "centroid_predictions": centroid_predictions,
    "confusion_matrix": confusion_matrix,
    "per_class_metrics": per_class_metrics,
    "classification_report": classification_report,
    "absent_class_report": absent_class_report,
    "scalar_metrics": scalar_metrics,
    "attribute_mismatch": attribute_mismatch,
    "probability_audit": probability_audit,
    "metrics_by_group": metrics_by_group,
    "two_level_summary": two_level_summary,
    "seed_variation": seed_variation,
    "paired_group_differences": paired_group_differences,
    "report_f1_by_group": report_f1_by_group,
    "report_f1_by_class": report_f1_by_class,
    "report_atom_activity": report_atom_activity,
    "best_by_method": best_by_method,
    "refined_grid": refined_grid,
    "dictionary_ranking": dictionary_ranking,
    "best_lambda": best_lambda,
    "parameter_grid": parameter_grid,
    "sparse_codes_native": sparse_codes_native,
    "sparse_codes_batch": sparse_codes_batch,
    "kkt_residuals": kkt_residuals,
    "kkt_summary": kkt_summary,
    "code_activity": code_activity,
    "code_usage": code_usage,
    "reconstruction_error": reconstruction_error,
    "atom_norms": atom_norms,
    "top_features_per_atom": top_features_per_atom,
    "top_absolute_per_atom": top_absolute_per_atom,
    "atom_similarity": atom_similarity,
    "atom_order": atom_order,
    "atom_diagnostics": atom_diagnostics,
    "atom_pairs": atom_pairs,
    "atom_matching": atom_matching,
}
