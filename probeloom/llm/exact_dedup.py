"""Exact document deduplication by content-defined chunk recipes (native).

A text is normalised (runs of ASCII white space become one space) and cut into
chunks at places that its own characters decide. Chunks are deduplicated to
identifiers: the SHA-256 of the chunk, verified by comparing the chunks that
share it. A document is then the ordered list of its identifiers, and only these
short lists are compared and moved between documents.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probeloom.llm.common import attach_group_facts, table
from probeloom.session import bounded_rows, materialize

WHITE = r"[\x20\x09-\x0D]+"

# A chunk has 512 to 8192 characters and ends where a vowel, one of six
# consonants, a space and a letter of the first half of the alphabet meet; text
# without such a place is cut at 8192.
CHUNK = r"(?s).{512,8192}?[aeiou][bdgkpr]\p{Punct}? (?=[a-mA-M])|.{1,8192}"

# Different chunks with one SHA-256. None are known; more than this is an error.
MAX_COLLISIONS = 1000


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, uid, text_sha256, chunks: one stored row per document."""
    text = normalised(F.col(text_col))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    return materialize(df.select(
        "doc_id", F.monotonically_increasing_id().alias("uid"), F.sha2(F.col("_t"), 256).alias("text_sha256"),
        F.regexp_extract_all(F.col("_t"), F.lit(CHUNK), F.lit(0)).alias("chunks"),
    ), "recipes")


def identifier(chunk):
    return F.unhex(F.sha2(chunk, 256))


def collisions(stored: DataFrame) -> list[bytes]:
    """Identifiers that different chunks share, found by comparing the chunks."""
    chunks = stored.select(F.explode("chunks").alias("chunk"))
    seen = chunks.select(identifier(F.col("chunk")).alias("id"), "chunk").groupBy("id").agg(
        F.min("chunk").alias("low"), F.max("chunk").alias("high")
    )
    return [bytes(r["id"]) for r in bounded_rows(seen.filter("low <> high").select("id"), MAX_COLLISIONS, "collisions")]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts equal empty ones. Of equal texts the smallest doc_id stays; null
    ids come last. Of rows that repeat both id and text one is kept. An empty
    table gives no rows; other columns of ``docs`` are ignored.
    """
    stored = recipes(docs, id_col, text_col)
    shared = collisions(stored)
    ident = identifier
    if shared:
        known = F.array(*[F.lit(x) for x in shared])
        # The chunk itself follows an identifier that does not stand for one chunk.
        ident = lambda c: F.when(
            F.array_contains(known, identifier(c)), F.concat(identifier(c), F.encode(c, "UTF-8"))
        ).otherwise(identifier(c))
    listed = stored.select("doc_id", "uid", "text_sha256", F.transform("chunks", ident).alias("recipe"))
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.col("uid").alias("uid")))
    groups = materialize(listed.groupBy("recipe").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    return attach_group_facts(listed, groups, "recipe", "group_size", total).select(
        "doc_id", F.col("first.id").alias("keep_id"), "group_size",
        (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without exact copies, all columns unchanged.

    Rows meet the decisions by one key, so their texts are moved once. Of rows that
    repeat both id and text, the one stays whose columns have the least hash.
    """
    key = lambda i, sha: F.sha2(F.concat_ws(":", i.cast("string"), sha), 256)
    kept = exact_dedup(docs).filter("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("_key"))
    marked = docs.withColumn("_key", key(F.col("doc_id"), F.sha2(normalised(F.col("text")), 256)))
    found = marked.join(kept, "_key", "left_semi")
    first = Window.partitionBy("_key").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return found.withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_key", "_place")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = {
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST)""",
}
