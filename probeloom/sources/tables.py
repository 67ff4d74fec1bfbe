"""The driver's tables seen through the entity / count / vector model.

========  =============  ==============  ==========  ==========================
profile   entity_id      label           grp         counts or vectors
========  =============  ==============  ==========  ==========================
text      doc_id         lang            doc_id % 4  token counts
retail    o_orderkey     c_mktsegment    r_name      l_quantity per part
vector    vec_id         label           vec_id % 4  embedding
========  =============  ==============  ==========  ==========================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text_label(label: str) -> Column:
    if label == "lang_source":
        return F.concat_ws("_", "lang", "source")
    return F.col(label)


def text_entities(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    """entity_id, label, grp. Reads three narrow columns; the text is not touched."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("entity_id"),
        _text_label(label).alias("label"),
        (F.col("doc_id") % 4).cast("string").alias("grp"),
    )


def text_documents(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    """entity_id, label, grp, total, tokens: one row per document, tokens sorted.

    ``total`` is the library size. A document is one row, so it is known before
    the text is exploded and no later aggregate or join has to find it.
    """
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    docs = rows.select(
        F.col("doc_id").cast("string").alias("entity_id"),
        _text_label(label).alias("label"),
        (F.col("doc_id") % 4).cast("string").alias("grp"),
        F.sort_array(F.array_remove(F.split("text", " "), "")).alias("tokens"),
    )
    return docs.withColumn("total", F.size("tokens").cast("long"))


def count_tokens(docs: DataFrame) -> DataFrame:
    """entity_id, grp, total, feature_id, cnt: one row per entity and feature.

    All occurrences of an entity sit in one row, so they are counted there, as
    run lengths of the sorted tokens. Nothing is shuffled.
    """
    at = F.when(F.col("total") > 0, F.sequence(F.lit(0), F.col("total").cast("int") - 1))
    starts = F.filter(at, lambda i: ~F.get("tokens", i).eqNullSafe(F.get("tokens", i - 1)))
    runs = docs.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.col("total").cast("int")))
    pairs = F.zip_with("starts", ends, lambda a, b: F.struct(
        F.get("tokens", a).alias("feature_id"), (b - a).cast("long").alias("cnt")
    ))
    return runs.select("entity_id", "grp", "total", F.inline(pairs))


def text_counts(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    return count_tokens(text_documents(spark, sf_dir, label))


def retail_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(customer_regions(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").cast("string").alias("entity_id"),
            F.col("c_mktsegment").alias("label"),
            F.col("r_name").alias("grp"),
        )
    )


def customer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "r_name"
    )


def retail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, feature_id, cnt; repeated (order, part) lines are summed."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_partkey")
        .agg(F.sum("l_quantity").alias("qty"))
        .select(
            F.col("l_orderkey").cast("string").alias("entity_id"),
            F.col("l_partkey").cast("string").alias("feature_id"),
            F.col("l_partkey").alias("feature_pos"),
            F.col("qty").cast("long").alias("cnt"),
        )
    )


def vector_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, label, grp, vec (double array)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("entity_id"),
        F.col("label").cast("string").alias("label"),
        (F.col("vec_id") % 4).cast("string").alias("grp"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
