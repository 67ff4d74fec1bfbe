"""Queries over the text and retail profiles: counts, splits, checks, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.functions.scalars import SPLITS, merged_object, round_floats, text_of
from probeloom.operators import checks, features, groups, panels, split
from probeloom.operators.ranking import rank_rows
from probeloom.plans import reports
from probeloom.session import new_folder
from probeloom.sources import convert, digests, readers, writers
from probeloom.sources import tables as T

N_FEATURES = 2000
# Fixed values of the region table.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def r6(name: str, decimals: int = 6):
    return F.round(F.col(name), decimals).alias(name)


# --- counts -------------------------------------------------------------------

def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.text_counts(spark, sf_dir).select("entity_id", "feature_id", "cnt")


def library_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("entity_id"))
    totals = T.retail_counts(spark, sf_dir).groupBy("entity_id").agg(
        F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("n_features")
    )
    return orders.join(totals, "entity_id", "left").select(
        "entity_id", F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("n_features", F.lit(0)).alias("n_features"),
    )


def log_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.normalize_log(T.text_counts(spark, sf_dir)).select("entity_id", "feature_id", r6("x"))


def log_normalized_retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = T.retail_counts(spark, sf_dir).select("entity_id", "feature_id", "cnt")
    return features.normalize_log(counts).select("entity_id", "feature_id", r6("x"))


def summed_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated (order, part) lines merged before normalization."""
    lines = T.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("entity_id"),
        F.col("l_partkey").cast("string").alias("feature_id"), F.col("l_quantity").cast("long").alias("cnt"),
    )
    return features.sum_duplicates(lines)


# --- split --------------------------------------------------------------------

def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exclusion list: documents labelled toxic."""
    return T.table(spark, sf_dir, "labels").filter("toxic = 1").select(
        F.col("doc_id").cast("string").alias("entity_id")
    )


def text_split(spark: SparkSession, sf_dir: str) -> split.Split:
    return split.stratified_split(
        T.text_entities(spark, sf_dir, "lang_source"), listed_documents(spark, sf_dir)
    )


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_split(spark, sf_dir).manifest


def stratified_split_retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(T.retail_entities(spark, sf_dir)).manifest


def split_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_split(spark, sf_dir).excluded


def split_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recounted from the manifest rather than taken from the apportionment."""
    counted = (
        stratified_split(spark, sf_dir).groupBy("label").pivot("split", list(SPLITS))
        .agg(F.count(F.lit(1))).na.fill(0)
    )
    return counted.withColumn("total", sum((F.col(s) for s in SPLITS), F.lit(0)).cast("long"))


def class_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = split.flag_listed(T.text_entities(spark, sf_dir, "lang_source"), listed_documents(spark, sf_dir))
    return split.stage_counts(flagged, 30)


def nested_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.nested_samples(T.text_entities(spark, sf_dir), [50, 100, 200])


def label_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label x group counts with totals on both margins.

    Orders are counted per customer before the joins, so a customer with very
    many orders arrives at the join as one row.
    """
    per_customer = T.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    customer = T.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        T.customer_regions(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("c_mktsegment").alias("label"), F.col("r_name").alias("grp"), "n")
    return reports.label_group_counts(rows, REGIONS, weight="n")


# --- checks -------------------------------------------------------------------

def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in which a language never occurs with a quality label."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labelled = T.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return checks.coverage_gaps(docs.join(labelled, "doc_id"), "source", "lang")


def partition_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDs left over when only the listed exclusions are counted as removed."""
    s = text_split(spark, sf_dir)
    return checks.partition_violations(
        T.text_entities(spark, sf_dir).select("entity_id"), s.manifest.select("entity_id"),
        listed_documents(spark, sf_dir),
    )


def membership_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.text_entities(spark, sf_dir)
    labelled = T.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("entity_id"))
    return checks.membership_diff(docs, labelled)


def overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of cohorts by ID: labelled documents, embeddings against documents."""
    docs = T.text_entities(spark, sf_dir)
    labelled = T.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("entity_id"))
    embedded = T.vector_entities(spark, sf_dir)
    one = checks.membership_summary(docs, labelled).select(F.lit("documents/labels").alias("pair"), "*")
    two = checks.membership_summary(docs, embedded).select(F.lit("documents/embeddings").alias("pair"), "*")
    return one.unionByName(two)


def overlap_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic against other labelled documents by id, source, language and group, in one pass."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("doc_id") % 4).alias("grp"))
    marked = docs.join(T.table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return checks.key_overlap(marked.filter("toxic = 1"), marked.filter("toxic = 0"), ["doc_id", "source", "lang", "grp"])


def report_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and labels of a document as one JSON object each, merged; the labels' text passes through bytes."""
    docs = T.table(spark, sf_dir, "documents").select(
        "doc_id", F.to_json(F.struct("lang", F.col("n_chars").alias("n"), F.lit("draft").alias("status"))).alias("a"))
    labels = T.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("l_id"), F.to_json(F.struct(F.struct("quality", "toxic").alias("marks"), F.lit("final").alias("status"))).alias("b"))
    both = docs.join(labels, F.col("doc_id") == F.col("l_id"), "left")
    return both.select("doc_id", merged_object(F.col("a"), text_of(F.encode("b", "UTF-8"))).alias("report"), F.col("b").isNotNull().alias("labelled"))


def entity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated IDs when conversation turns are read as entities."""
    turns = T.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("entity_id"), F.col("role").alias("label"), F.col("text").alias("grp")
    )
    return checks.entity_violations(turns)


def exclusion_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark item numbers used as an exclusion list for labelled documents."""
    labelled = T.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("entity_id"))
    items = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("entity_id"))
    return checks.exclusion_violations(labelled, items)


def id_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per column of lineitem: values that are not valid counts."""
    lines = T.table(spark, sf_dir, "lineitem")
    names = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    one = lines.agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.count_if(~F.coalesce(checks.is_valid_count(F.col(c)), F.lit(False))).alias(c) for c in names
    ])
    return one.select("n_rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_invalid")) for c in names
    ])))


def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.domain_violations(T.table(spark, sf_dir, "documents"), "lang", ["de", "en", "fr", "it"])


def recorded_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split sizes per label against sizes taken from the grand total."""
    s = split.stratified_split(T.text_entities(spark, sf_dir), validate=False)
    actual = s.manifest.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    n = T.text_entities(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    recorded = n.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("split"), split.apportion(F.col("n"))[i].alias("n_rows"))
        for i, name in enumerate(SPLITS)
    ])))
    return checks.count_differences(actual, recorded, "split")


def order_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions at which part names in key order and in price order disagree."""
    part = T.table(spark, sf_dir, "part")
    by_key = rank_rows(part.select("p_partkey", "p_name"), ["p_partkey"], "pos")
    by_price = rank_rows(
        part.select("p_retailprice", "p_partkey", "p_name"), [F.col("p_retailprice").desc(), "p_partkey"], "pos"
    )
    return checks.order_differences(by_key, by_price, "pos", "p_name")


def empty_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.empty_entities(
        T.retail_entities(spark, sf_dir), T.retail_counts(spark, sf_dir)
    ).select("entity_id", "label", "grp")


def table_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = digests.fingerprint(
        T.table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "text"), keys=["source"]
    )
    return docs.withColumnRenamed("source", "part")


def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.file_digests(spark, sf_dir, "*.parquet").select(
        F.regexp_extract("path", "[^/]+$", 0).alias("file"), "n_bytes", "sha256"
    )


def tree_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle root of every table file, read by splits."""
    return digests.tree_digests(spark, sf_dir, "*.parquet").select(
        F.regexp_extract("stream", "[^/]+$", 0).alias("file"), "n_bytes", "root"
    )


# --- features -----------------------------------------------------------------

def fitted_on_train(spark: SparkSession, sf_dir: str, n_features: int):
    """Split, then fit on training documents.

    The split needs only narrow columns and leaves a few key bounds per label,
    so training documents are recognized and counted row by row. The only
    shuffle of the fit is the partially aggregated one by token.
    """
    s = split.stratified_split(T.text_entities(spark, sf_dir), validate=False)
    train = s.assign(T.text_documents(spark, sf_dir)).filter("split = 'train'")
    log_train = features.normalize_log(T.count_tokens(train))
    return s, features.fit_features(log_train, s.train_rows, n_features)


def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, fitted = fitted_on_train(spark, sf_dir, N_FEATURES)
    return fitted.select(
        "feature_id", F.col("out_pos").cast("long").alias("out_pos"),
        r6("mean", 9), r6("scale", 9), r6("variance", 9),
    )


def transformed_vectors(spark: SparkSession, sf_dir: str, n_features: int = N_FEATURES) -> DataFrame:
    s, fitted = fitted_on_train(spark, sf_dir, n_features)
    fitted = features.settle_fitted(fitted, n_features)
    log_counts = features.normalize_log(T.text_counts(spark, sf_dir))
    return features.transform_vectors(log_counts, s.manifest, fitted, n_features)


def transformed_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transformed_vectors(spark, sf_dir).select(
        "entity_id", "split", F.posexplode("vec").alias("out_pos", "value")
    ).select("entity_id", "split", F.col("out_pos").cast("long").alias("out_pos"),
             round_floats(F.col("value"), 4).alias("value"))


def fold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = groups.group_sizes(T.text_entities(spark, sf_dir))
    return features.fold_moments(features.normalize_log(T.text_counts(spark, sf_dir)), sizes)


def group_feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_stats(spark, sf_dir).select("outer_grp", "feature_id", r6("mean", 9), r6("variance", 9))


def fold_selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variance policy of the group study: each fold selects its own features."""
    return features.select_per_fold(fold_stats(spark, sf_dir), N_FEATURES).select(
        "outer_grp", "feature_id", F.col("out_pos").cast("long").alias("out_pos"), r6("mean", 9), r6("scale", 9)
    )


def vocabulary(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    words = F.explode(F.array_remove(F.split("text", " "), ""))
    return T.table(spark, sf_dir, name).select(words.alias("feature_id")).distinct()


def feature_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.feature_positions(vocabulary(spark, sf_dir))


def benchmark_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered panel made of the benchmark vocabulary."""
    ranked = panels.feature_positions(vocabulary(spark, sf_dir, "benchmark"))
    return ranked.select(
        F.col("feature_pos").alias("panel_pos"),
        F.md5("feature_id").alias("panel_id"), F.col("feature_id").alias("feature_name"),
    )


def mapped_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.map_panel(benchmark_panel(spark, sf_dir), feature_positions(spark, sf_dir), "benchmark")


def panel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.panel_coverage(mapped_panel(spark, sf_dir)).withColumn(
        "coverage_percent", F.round("coverage_percent", 6)
    )


def panel_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.restrict_panel(mapped_panel(spark, sf_dir))


def panel_empty_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a single token of the benchmark vocabulary; reported, not dropped."""
    words = vocabulary(spark, sf_dir, "benchmark")
    on_panel = T.text_counts(spark, sf_dir).join(words, "feature_id", "left_semi")
    return checks.empty_entities(T.text_entities(spark, sf_dir), on_panel)


def text_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV and read back as text; blanked segments stay empty text."""
    customers = T.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("row_name"), F.col("c_name").alias("person"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    path = new_folder(spark, "csv")
    writers.write_csv(customers, path)
    return readers.read_text_table(spark, path, ["row_name", "segment", "person"]).select(
        F.col("row_name").alias("entity_id"), F.col("segment").alias("label"), F.col("person").alias("grp")
    )


def coordinate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as coordinate text (part x order) and read back."""
    counts = T.table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(
        F.sum("l_quantity").alias("cnt")
    ).select(F.col("l_partkey").alias("feature_pos"), F.col("l_orderkey").alias("entity_pos"), "cnt")
    shape = T.table(spark, sf_dir, "lineitem").agg(F.max("l_partkey") + 1, F.max("l_orderkey") + 1).first()
    path = new_folder(spark, "coordinates")
    readers.write_coordinates(counts, path, shape[0], shape[1])
    return readers.read_coordinates(spark, path).select(
        "feature_pos", "entity_pos", F.col("cnt").cast("long").alias("cnt")
    )


def converted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered quantities exported as coordinates with two name files, and converted back to named counts."""
    lines = T.table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.sum("l_quantity").alias("cnt"))
    parts = rank_rows(T.table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], "feature_pos")
    orders = rank_rows(T.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderkey"], "entity_pos")
    entries = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    root = new_folder(spark, "export")
    readers.write_coordinates(entries.select("feature_pos", "entity_pos", "cnt"), f"{root}/matrix", parts.count(), orders.count())
    writers.write_csv(parts.orderBy("feature_pos").select(F.concat_ws(":", "p_name", "p_partkey").alias("feature_id")), f"{root}/features")
    writers.write_csv(orders.orderBy("entity_pos").select(
        F.concat(F.lit("o"), "o_orderkey").alias("entity_id"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("grp")), f"{root}/entities")
    convert.convert_counts(spark, f"{root}/matrix", f"{root}/features", f"{root}/entities", f"{root}/tables")
    counts, entities = (spark.read.parquet(f"{root}/tables/{name}") for name in ("counts", "entities"))
    return counts.join(entities.select("entity_id", "label", "grp"), "entity_id").select("entity_id", "label", "grp", "feature_id", "feature_pos", "cnt")


QUERIES = {
    "converted_counts": converted_counts,
    "token_counts": token_counts,
    "library_size": library_size,
    "log_normalized": log_normalized,
    "log_normalized_retail": log_normalized_retail,
    "summed_duplicates": summed_duplicates,
    "stratified_split": stratified_split,
    "stratified_split_retail": stratified_split_retail,
    "split_exclusions": split_exclusions,
    "split_contingency": split_contingency,
    "class_stage_counts": class_stage_counts,
    "nested_samples": nested_samples,
    "label_by_group": label_by_group,
    "coverage_gaps": coverage_gaps,
    "partition_violations": partition_violations,
    "membership_diff": membership_diff,
    "overlap_audit": overlap_audit,
    "overlap_keys": overlap_keys,
    "report_merge": report_merge,
    "entity_checks": entity_checks,
    "exclusion_checks": exclusion_checks,
    "id_quality": id_quality,
    "domain_violations": domain_violations,
    "recorded_totals": recorded_totals,
    "order_mismatch": order_mismatch,
    "empty_entities": empty_entities,
    "table_fingerprints": table_fingerprints,
    "file_digests": file_digests,
    "tree_digests": tree_digests,
    "selected_features": selected_features,
    "transformed_long": transformed_long,
    "group_feature_stats": group_feature_stats,
    "feature_positions": feature_positions,
    "panel_mapping": mapped_panel,
    "panel_coverage": panel_coverage,
    "panel_ordered": panel_ordered,
    "coordinate_matrix": coordinate_matrix,
    "fold_selected_features": fold_selected_features,
    "panel_empty_entities": panel_empty_entities,
    "text_table_round_trip": text_table_round_trip,
}
