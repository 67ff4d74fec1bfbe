"""Substring, byte-string, exact and near deduplication against plain versions."""

import random
import re
from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from probeloom.llm import components, exact_dedup, exchange, near_dedup, substring_dedup, suffix_dedup
from probeloom.llm.common import attach_group_facts
from tests.llm import brute

import numpy as np


def test_repeated_windows_match_plain_version(docs, rows):
    for size in (50, 7):
        found = substring_dedup.remove_repeats(docs, size).select("rec.doc_id", "n_words", "n_removed", "kept").collect()
        assert Counter(map(tuple, found)) == Counter(brute.repeats(rows, size))


def test_words_built_to_share_a_polynomial_are_told_apart(spark):
    """The Thue-Morse word and its complement agree in every polynomial modulo 2^64 with an odd base."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{rest} {a}"), (2, f"{rest} {b}"), (3, f"{rest} {a}"), (4, f"{rest} a\0"), (5, f"{rest} a"), (6, f"{rest} {'c' * 7}"), (7, f"{rest} {'c' * 8}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.remove_repeats(df).select("rec.doc_id", "n_words", "n_removed", "kept").collect()
    assert Counter(map(tuple, found)) == Counter(brute.repeats(rows, 50))
    _, classes = near_dedup.near_classes(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string"))
    assert {r["id"]: r["class_id"] for r in classes.collect()} == {1: 1, 2: 2, 3: 1}


def test_word_codes_agree_exactly_for_equal_words():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 99, rng.integers(1, 12)).astype(np.uint8)) for _ in range(3000)] + [b"a", b"a\0", b"\0", b"\0\0"]
    data = b"\n".join(words) + b"\n"
    starts = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
    codes = exchange.word_codes(data, starts, starts + np.array([len(w) for w in words]))
    for column in codes.T:
        assert len(set(zip(column.tolist(), words))) == len(set(words)) == len(set(column.tolist()))


def test_registered_substring_query_equals_plain_version(spark, folder, rows):
    """The query itself, with its digest columns, over a stored table."""
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    found = substring_dedup.op1_substring_dedup(spark, folder).collect()
    plain = [(i, n, gone, sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute.repeats(rows, 50)]
    assert Counter(map(tuple, found)) == Counter(plain)


def test_cut_documents_keep_their_columns(docs):
    found = substring_dedup.without_repeats(docs)
    assert found.columns == docs.columns and found.count() == docs.count()
    assert found.filter("doc_id = 200 AND text IS NULL").count() == 1
    # Nothing removed: the text stays as it was, white space included.
    assert found.filter("doc_id = 204").first()["text"] == "one  two"


def test_byte_strings_match_plain_version(docs, rows):
    for size in (400, 60):
        found = suffix_dedup.remove_strings(docs, size).select("rec.doc_id", "n_bytes", "kept", "spans").collect()
        got = Counter((r[0], r[1], bytes(r[2]), tuple((s[0], s[1]) for s in r[3])) for r in found)
        plain = brute.strings([t for _, t in rows], size)
        assert got == Counter((i, n, k, tuple(s)) for (i, _), (n, k, s) in zip(rows, plain))


def test_registered_byte_query_on_planted_passages(spark, folder, monkeypatch):
    """The query itself over many bundles and shards; passages of over 50 words go if they hold 400 bytes, from every holder."""
    monkeypatch.setattr(suffix_dedup, "BUNDLE_BYTES", 8000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    rng = random.Random(11)
    rows, long, short = [], set(), set()
    for i in range(60):
        rows.append((i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(40, 200)))))
    for p in range(12):
        n, width = (rng.randrange(51, 66), 10) if p % 2 else (rng.randrange(70, 120), 10 ** 5)
        passage = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(width)}" for _ in range(n))
        held = range(5 * p, 5 * p + 3)
        (short if len(passage.encode()) < 390 else long).update(held)
        for i in held:
            cut = rows[i][1].index(" ") + 1
            rows[i] = (i, f"{rows[i][1][:cut]}{passage} {rows[i][1][cut:]}")
    assert long and short
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    found = suffix_dedup.op6_suffix_dedup(spark, folder).collect()
    plain = brute.strings([t for _, t in rows], 400)
    assert Counter(map(tuple, found)) == Counter(
        (i, n, sum(length for _, length in spans), len(spans), sha256(kept).hexdigest()) for (i, _), (n, kept, spans) in zip(rows, plain))
    assert {r["doc_id"] for r in found if r["n_removed"]} == long


def test_exact_groups(docs, rows):
    texts = [re.sub(brute.WHITE, " ", t or "") for _, t in rows]
    size = Counter(texts)
    keep = {}
    for (i, _), t in zip(rows, texts):
        keep[t] = min(keep.get(t, float("inf")), float("inf") if i is None else i)
    found = exact_dedup.exact_dedup(docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == Counter(
        (i, None if keep[t] == float("inf") else keep[t], size[t]) for (i, _), t in zip(rows, texts))
    assert sum(r["kept"] for r in found) == len(size)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(size)


def test_exact_plan_is_native(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_equal_identifiers_are_compared(docs, monkeypatch):
    """With identifiers that collide the chunks themselves decide."""
    real = exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept").collect()
    monkeypatch.setattr(exact_dedup, "identifier", lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 2)))
    weak = exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert Counter(map(tuple, real)) == Counter(map(tuple, weak))


def test_near_classes_match_plain_version(docs, rows):
    _, found = near_dedup.near_classes(docs)
    got = found.collect()
    label = brute.classes(rows)
    members = {}
    for (i, _), c in zip(rows, label):
        members.setdefault(c, []).append(i)
    want = Counter()
    for (i, _), c in zip(rows, label):
        ids = [x for x in members[c] if x is not None]
        want[i, min(ids) if ids else None, len(members[c])] += 1
    assert Counter((r["id"], r["class_id"], r["class_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(members)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(members)


def test_components_are_least_labels(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 6), (20, 21), (20, 22), (20, 23), (3, 1), (30, 30)]
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 10: 6, 20: 20, 21: 20, 22: 20, 23: 20}


def test_hot_groups_are_joined_apart(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    found = attach_group_facts(rows, groups, "k", "n", 3000)
    assert found.count() == 3000 and found.filter("n = 1000").count() == 1000


def test_gaps_and_counts_survive_packing():
    rng = np.random.default_rng(0)
    for top in (10, 10 ** 6, 2 ** 40):
        cells = np.unique(rng.integers(0, top, 500).astype(np.uint64))
        assert (exchange.unpack(exchange.pack(cells)) == cells).all()
        counts = rng.integers(1, 4, len(cells)).astype(np.uint32)
        assert (exchange.unpack_counts(exchange.pack_counts(counts), len(cells)) == counts).all()


def test_empty_tables(no_docs):
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    assert suffix_dedup.remove_strings(no_docs).count() == 0
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert near_dedup.near_classes(no_docs)[1].count() == 0
    for cut in (substring_dedup.without_repeats, exact_dedup.keep_first, near_dedup.keep_one):
        assert cut(no_docs).columns == no_docs.columns and cut(no_docs).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2 ** 63, 400).astype(np.uint64)
    w = rng.uniform(1, 12, 400)
    a, b = np.sort(h[:360]), np.sort(h[40:])
    weight = dict(zip(h.tolist(), w))
    common = sum(weight[x] for x in set(a.tolist()) & set(b.tolist()))
    similarity = common / w.sum()
    both = np.concatenate([a, b])
    keys = np.mean([(lambda k: (k[0] == k[1]).mean())(near_dedup.signatures(
        exchange.mix(both, s), np.array([weight[x] for x in both.tolist()]), np.array([0, 360]))) for s in range(40)])
    assert abs(keys - similarity ** near_dedup.ROWS) < 0.05
