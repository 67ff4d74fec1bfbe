"""Near-duplicate classes by improved consistent weighted sampling.

A document is a set of five-word shingles weighed by tf-idf; document frequencies
come from the sketch in ``exchange``. Shingles that only one document holds cannot
add to a similarity, so a document whose other shingles weigh less than the
threshold has no partner and needs no signature (an exact bound). The rest get
consistent weighted samples, banded; documents that share a band are verified by
their weighted Jaccard similarity.

Documents with equal shingles are one class from the start. In each bucket all
members are first compared with the most central one. Only where a bucket still
joins different components are their members compared across components, so that
no link is missed and large groups give no all-pairs output; pairs that cannot be
similar enough, by what each shares with any document, are left out of the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.llm import exchange as X
from probeloom.llm.common import attach_group_facts, table
from probeloom.llm.components import components
from probeloom.session import materialize

SHINGLE, THRESHOLD = 5, 0.8
# A pair at the threshold shares a band with probability 1 - (1 - 0.8^5)^25 > 0.9999.
BANDS, ROWS = 25, 5
# Pairs of one document that one task verifies at a time.
PAIRS = 256
# Slack for sums taken in another order.
EPSILON = 1e-9

DOCS = ("rid long, id long, first long, second long, total double, common double, bands array<long>, "
        "shingles binary, weights binary")
CELLS = 1 << 16


def gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of CELLS equal shares."""
    x = np.concatenate([np.linspace(0, 0.02, 20_000, endpoint=False), np.linspace(0.02, 30, 400_000)])
    return np.interp((np.arange(CELLS) + 0.5) / CELLS, 1 - (1 + x) * np.exp(-x), x)


TABLES: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    if not TABLES:
        q = gamma_quantiles()
        TABLES.extend([q.astype(np.float32), np.log(q).astype(np.float32)])
    return TABLES


def shingles(words: X.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text numbers, ascending by text. A shorter text is one shingle of all its words."""
    at = words.windows(size)
    brief = np.flatnonzero((words.count > 0) & (words.count < size))
    starts = np.concatenate([at, words.first[brief]])
    ends = np.concatenate([at + size, words.first[brief] + words.count[brief]])
    owner = words.text[starts] if len(starts) else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    starts, ends, owner = starts[order], ends[order], owner[order]
    hashes = X.mix(X.range_hashes(words.hash, X.WORD_BASE, starts, ends) + (ends - starts).astype(np.uint64))
    return hashes, owner


def signatures(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band keys of documents given as runs of shingles: improved consistent weighted sampling."""
    gamma, log_gamma = tables()
    lengths = np.diff([*starts, len(hashes)])
    log_w = np.log(weights).astype(np.float32)
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        x = X.mix(hashes, 0x1000193 * (k + 1))
        r = gamma[(x & np.uint64(CELLS - 1)).astype(np.int64)]
        log_c = log_gamma[((x >> np.uint64(16)) & np.uint64(CELLS - 1)).astype(np.int64)]
        beta = ((x >> np.uint64(32)).astype(np.float32)) * np.float32(2.0 ** -32)
        t = np.floor(log_w / r + beta)
        log_a = log_c - r * (t - beta) - r
        least = np.repeat(np.minimum.reduceat(log_a, starts), lengths)
        hit = np.flatnonzero(log_a == least)
        # The first of equal values; shingles are in order of their hash.
        chosen = hit[np.searchsorted(hit, starts)]
        sample = X.mix(hashes[chosen] ^ X.mix(t[chosen].astype(np.int64).view(np.uint64), k + 1))
        keys[:, k // ROWS] = X.mix(keys[:, k // ROWS] * X.WORD_BASE + sample)
    return keys


def described(stored: DataFrame, replies: DataFrame, cells: int, total_docs: int, size: int) -> DataFrame:
    """A row per document; those that can have a partner carry bands and shingles."""

    def run(rows: pa.Table, got: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return none()
        rows = X.in_order(rows)
        words = X.Words(rows["text"].to_pylist())
        hashes, owner = shingles(words, size)
        pairs = np.zeros(len(hashes), [("owner", "<u4"), ("hash", "<u8")])
        pairs["owner"], pairs["hash"] = owner, hashes
        pairs, tf = np.unique(pairs, return_counts=True)
        own, h = pairs["owner"].astype(np.int64), pairs["hash"].astype(np.uint64)
        df = X.counts_of(X.cell_of(h, cells), *X.heavy(got, cells))
        w = tf * (np.log((total_docs + 1) / (df + 1.0)) + 1)
        n = rows.num_rows
        weight = np.bincount(own, w, minlength=n)
        shared = df > 1
        common = np.bincount(own[shared], w[shared], minlength=n)
        chosen = (weight > 0) & (common >= THRESHOLD * weight - EPSILON)
        base = rows["bundle"][0].as_py() << 32
        first, second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        bands: list = [None] * n
        sets: list = [None] * n
        values: list = [None] * n
        use = chosen[own]
        if use.any():
            o, hh, ww, tt, ss = own[use], h[use], w[use], tf[use].astype(np.uint64), shared[use]
            starts = np.flatnonzero(np.diff(o, prepend=-1))
            docs = o[starts]
            first[docs] = np.add.reduceat(X.mix(hh * X.WORD_BASE + tt, 11), starts)
            second[docs] = np.add.reduceat(X.mix(hh * X.SECOND_BASE + tt, 23), starts)
            keys = signatures(hh, ww, starts).view(np.int64)
            ends = [*starts[1:], len(o)]
            for d, a, b, key in zip(docs.tolist(), starts.tolist(), ends, keys.tolist()):
                keep = ss[a:b]
                bands[d], sets[d], values[d] = key, hh[a:b][keep].tobytes(), ww[a:b][keep].tobytes()
        return pa.table({
            "rid": pa.array(base + np.arange(n)), "id": rows["id"].combine_chunks(),
            "first": pa.array(first.view(np.int64)), "second": pa.array(second.view(np.int64)), "total": pa.array(weight),
            "common": pa.array(common),
            "bands": pa.array(bands, pa.list_(pa.int64())), "shingles": pa.array(sets, pa.binary()),
            "weights": pa.array(values, pa.binary()),
        })

    def none() -> pa.Table:
        kinds = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.list_(pa.int64()), pa.binary(), pa.binary()]
        names = ["rid", "id", "first", "second", "total", "common", "bands", "shingles", "weights"]
        return pa.table({c: pa.array([], k) for c, k in zip(names, kinds)})

    rows = stored.select("bundle", "id", "text").groupBy("bundle")
    return materialize(rows.cogroup(replies.groupBy("bundle")).applyInArrow(run, DOCS), "shingled")


def can_reach(total_a, common_a, total_b, common_b):
    """Whether two documents can be THRESHOLD similar: they share no more than the lesser of what each shares at all."""
    most = F.least(common_a, common_b)
    return most >= THRESHOLD * (total_a + total_b - most) - EPSILON


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose weighted Jaccard similarity is THRESHOLD or more.

    The pairs of a document are dealt out in parts, so one that has very many is
    no longer a task of its own.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"))
    parts = materialize(parts, "pair-parts")
    total = parts.agg(F.sum("n")).first()[0] or 0
    dealt = attach_group_facts(pairs.select("a", "b"), parts, "a", "n", total).select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    )
    right = dealt.join(sets.withColumnRenamed("rid", "b"), "b").select("a", "part", "b", "total", "shingles", "weights")
    left = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(
        sets.withColumnRenamed("rid", "a"), "a"
    ).select(*[F.col(c).alias(f"own_{c}") for c in ("a", "part", "total", "shingles", "weights")])

    def run(one: pa.Table, others: pa.Table) -> pa.Table:
        a, b = [], []
        if one.num_rows and others.num_rows:
            h = np.frombuffer(one["own_shingles"][0].as_py(), np.uint64)
            w = np.frombuffer(one["own_weights"][0].as_py())
            own, node = one["own_total"][0].as_py(), one["own_a"][0].as_py()
            for other, total, s, v in zip(*(others[c].to_pylist() for c in ("b", "total", "shingles", "weights"))):
                hs, ws = np.frombuffer(s, np.uint64), np.frombuffer(v)
                if min(own, total) < THRESHOLD * max(own, total) - EPSILON or not len(h):
                    continue
                at = np.minimum(np.searchsorted(h, hs), len(h) - 1)
                same = h[at] == hs
                common = np.minimum(w[at[same]], ws[same]).sum()
                if common >= THRESHOLD * (own + total - common) - EPSILON:
                    a.append(node)
                    b.append(other)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return materialize(left.groupBy("own_a", "own_part").cogroup(right.groupBy("a", "part")).applyInArrow(run, "a long, b long"), "links")


def links_of(docs: DataFrame) -> DataFrame:
    """Verified links (a, b) between documents with different shingles."""
    sets = docs.select("rid", "total", "shingles", "weights")
    spread = docs.select("rid", F.posexplode("bands").alias("band", "value"))
    spread = materialize(spread.select("rid", F.xxhash64("band", "value").alias("bucket")), "bands")
    buckets = materialize(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    total = spread.count()
    members = attach_group_facts(spread, buckets, "bucket", "n", total)
    central = members.groupBy("rid").agg(F.sum("n").alias("reach"))
    members = materialize(members.join(central, "rid"), "members")
    # The member with the most company over all its bands leads a bucket.
    leaders = members.groupBy("bucket").agg(F.max(F.struct("reach", -F.col("rid"))).alias("top"), F.count(F.lit(1)).alias("n"))
    leaders = leaders.select("bucket", (-F.col("top.col2")).alias("a"), "n")
    stars = attach_group_facts(members.select("bucket", F.col("rid").alias("b")), leaders, "bucket", "n", total)
    stars = materialize(stars.filter("a <> b").select("a", "b").distinct(), "star-pairs")
    links = verified(stars, sets)
    parts = components(links)
    placed = members.select("bucket", "rid").join(parts.withColumnRenamed("node", "rid"), "rid", "left").select(
        "bucket", "rid", F.coalesce("label", "rid").alias("label")
    )
    placed = materialize(placed, "placed")
    split = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    split = materialize(split.filter("low < high").select("bucket", "n"), "split-buckets")
    left = attach_group_facts(placed, split, "bucket", "n", total).drop("n")
    left = materialize(left.join(docs.select("rid", "total", "common"), "rid"), "split-members")
    other = left.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("rid", "label", "total", "common")])
    possible = can_reach(F.col("total"), F.col("common"), F.col("total_b"), F.col("common_b"))
    across = left.join(other, "bucket").filter((F.col("label") < F.col("label_b")) & possible).select(
        F.col("rid").alias("a"), F.col("rid_b").alias("b")
    ).distinct()
    tried = stars.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    across = across.join(tried, (F.least("a", "b") == F.col("low")) & (F.greatest("a", "b") == F.col("high")), "left_anti")
    return links.unionByName(verified(materialize(across, "cross-pairs"), sets))


def near_classes(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The stored bundles, and a row per document: rid, id, class_id, class_size, kept.

    A class is a connected component of documents of similarity THRESHOLD or more;
    its id is the smallest doc_id in it, and that row stays (nulls last, then any one
    of repeated rows). Texts without words are alone in their class; a text of fewer
    words than a shingle is one shingle. An empty table gives no rows.
    """
    stored, volume = X.bundled(docs, id_col, text_col)

    def keys(rows: pa.Table):
        return shingles(X.Words(rows["text"].to_pylist()), size)

    replies, cells = X.repeated_cells(stored, keys, max(1, volume // 6))
    replies = materialize(replies, "document-frequencies")
    rows = described(stored, replies, cells, stored.count(), size)
    some = rows.filter("bands IS NOT NULL")
    order = F.struct(F.isnull("id").alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    alike = materialize(some.groupBy("first", "second").agg(
        F.min(order)["rid"].alias("one"), F.count(F.lit(1)).alias("copies")
    ).withColumn("key", F.xxhash64("first", "second")), "alike")
    total = alike.agg(F.sum("copies")).first()[0] or 0
    of = attach_group_facts(
        some.select("rid", F.struct("first", "second").alias("digest")),
        alike.select(F.struct("first", "second").alias("digest"), "one", "copies"), "digest", "copies", total,
    ).select("rid", "one")
    single = some.join(alike.select(F.col("one").alias("rid")), "rid", "left_semi")
    parts = components(links_of(single))
    named = alike.select("one", "copies").join(parts.withColumnRenamed("node", "one"), "one", "left").select(
        "one", "copies", F.coalesce("label", "one").alias("label")
    )
    label = attach_group_facts(of, named, "one", "copies", total).select("rid", "label")
    every = materialize(rows.select("rid", "id").join(label, "rid", "left").select(
        "rid", "id", F.coalesce("label", "rid").alias("label")
    ), "labelled")
    classes = materialize(every.groupBy("label").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("class_size")), "classes")
    found = attach_group_facts(every, classes, "label", "class_size", every.count())
    return stored, found.select(
        "rid", "id", F.col("first.id").alias("class_id"), "class_size", (F.col("rid") == F.col("first.rid")).alias("kept")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, all columns unchanged."""
    from pyspark.sql.pandas.types import to_arrow_type

    stored, classes = near_classes(docs)
    gone = classes.filter(~F.col("kept")).select(
        F.shiftright("rid", 32).cast("int").alias("bundle"), F.col("rid").bitwiseAND(0xFFFFFFFF).alias("place")
    )
    rec = stored.schema["rec"].dataType
    names = [("rec", to_arrow_type(rec)), ("none", pa.bool_()), ("text", pa.string())]

    def run(rows: pa.Table, drop: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({n: pa.array([], t) for n, t in names})
        stay = np.ones(rows.num_rows, bool)
        stay[drop["place"].to_numpy()] = False
        return X.in_order(rows).select(["rec", "none", "text"]).filter(pa.array(stay))

    found = stored.groupBy("bundle").cogroup(gone.groupBy("bundle")).applyInArrow(
        run, f"rec {rec.simpleString()}, none boolean, text string"
    )
    text = F.when(~F.col("none"), F.col("text"))
    return found.select(*[text.alias("text") if c == "text" else F.col(f"rec.`{c}`").alias(c) for c in docs.columns])


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = near_classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")
