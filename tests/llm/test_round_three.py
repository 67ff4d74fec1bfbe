"""Periodic runs, reply trees and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from probeloom.llm import chat_paths, exchange, periodic_runs, registry, resampling, substring_dedup
from tests.llm import brute


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs ---------------------------------------------------------------


def plain_runs(w, least):
    """All runs by definition: every period, stretches of words equal to those one period on, smallest period first."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_runs_sorted(w, least):
    return sorted(plain_runs(w, least), key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = set()
    for s, n, q in runs:
        gone.update(range(s + q, s + n))
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def runs_of(sequences, least):
    texts = [[str(x).encode() for x in s] for s in sequences]
    t, offsets = periodic_runs.numbered(texts)
    out = [[] for _ in texts]
    for s, e, q in periodic_runs.find_runs(t, offsets, least):
        k = int(np.searchsorted(offsets, s, side="right")) - 1
        out[k].append((s - int(offsets[k]), e - s, q))
    return out


def test_runs_of_random_words_match_the_definition():
    rng = random.Random(1)
    for least in (2, 5, 12):
        sequences = [[rng.randrange(k) for _ in range(rng.randrange(0, 80))] for k in (1, 2, 2, 3, 4) for _ in range(60)]
        fib = ["a", "ab"]
        while len(fib[-1]) < 200:
            fib.append(fib[-1] + fib[-2])
        sequences += [list(fib[-1]), list("ab" * 60 + "c" + "ab" * 7), list("aab" * 20 + "aabaab" * 3), ["x"] * 300, []]
        for s, got in zip(sequences, runs_of(sequences, least)):
            assert got == plain_runs_sorted(s, least), (s, least)


def test_suffix_array_is_sorted_with_its_common_prefixes():
    rng = random.Random(3)
    texts = [[str(rng.randrange(3)).encode() for _ in range(50)] for _ in range(5)]
    t, _ = periodic_runs.numbered(texts)
    sa, isa, lcp = periodic_runs.suffix_array(t)
    whole = t.tolist()
    assert sorted(range(len(whole)), key=lambda i: whole[i:]) == sa.tolist()
    assert all(isa[s] == k for k, s in enumerate(sa))
    for k in range(1, len(whole)):
        a, b = whole[sa[k - 1]:], whole[sa[k]:]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_runs_of_documents(docs, rows, no_docs):
    more = [(900, "la la " * 40), (901, " ".join("abcdefg" * 5) + " end"), (902, "to be or not " * 20000 + "to"), (902, None)]
    extra = docs.sparkSession.createDataFrame(more, "doc_id long, text string")
    found = periodic_runs.periodic_runs(docs.select("doc_id", "text").unionByName(extra)).collect()
    expected = Counter()
    for i, text in [*rows, *more]:
        w = brute.words(text)
        runs = [(0, len(w), 4)] if i == 902 and w else plain_runs_sorted(w, 12)
        expected[i, len(w), tuple(runs), collapse(w, runs)] += 1
    assert Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in found) == expected
    assert not periodic_runs.periodic_runs(no_docs).collect()
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, min_length=1)


def test_chunks_do_not_change_runs(docs, monkeypatch):
    whole = Counter(map(str, periodic_runs.periodic_runs(docs).collect()))
    monkeypatch.setattr(periodic_runs, "CHUNK_WORDS", 50)
    assert Counter(map(str, periodic_runs.periodic_runs(docs).collect())) == whole


def test_op11_query_matches_the_contract(spark):
    folder = "/root/testdata/sf0.001"
    expected = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        w = brute.words(r["text"])
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs_sorted(w, 12) if n < 3000 else None
        if runs is None:
            continue
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        expected[r["doc_id"]] = (
            len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapse(w, runs)))
    found = {r["doc_id"]: tuple(r)[1:] for r in registry.queries()["op11_periodic_runs"](spark, folder).collect()}
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert any(e[0] for e in expected.values())
    assert all(found[i] == e for i, e in expected.items())


# --- reply trees -----------------------------------------------------------------

TREES = "tree_id long, message_id long, parent_id long, role string, text string, score double, tree string, id string, up string, n string, loss string"


def trees(spark):
    rng = random.Random(7)
    rows = []
    for tree in (1, 2, None):
        for i in range(60):
            rows.append((tree, i, None if i == 0 else rng.randrange(i), "user" if i % 2 else "assistant", f"<s>{tree} {i}\\[INST]", rng.random()))
    rows += [(3, i, i - 1 if i else None, rng.choice(["user", "assistant"]), "é😀" * (i % 5), None) for i in range(300)]   # one long chain
    rows += [(4, i, 0 if i else None, "user", str(i), float(i)) for i in range(200)]                        # one parent of all
    rows += [(5, 1, 99, "user", "an orphan", 1.0), (5, 2, 1, None, None, None)]                             # the parent is missing
    rows += [(6, 1, 2, "user", "a", 0.0), (6, 2, 1, "user", "b", 0.0), (6, 3, 2, "user", "c", 0.0)]         # a cycle and one below it
    rows += [(7, None, None, "user", "no id", 0.0), (8, 1, None, "user", "twice", 0.5), (8, 1, None, "user", "twice", 0.5)]
    return spark.createDataFrame([r + ("x",) * 5 for r in rows], TREES), rows


def plain_paths(rows, best):
    out = {}
    for tree in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == tree and r[1] is not None}
        parents = {r[2] for r in nodes.values()}
        paths = []
        for leaf in nodes:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in nodes and len(path) <= len(nodes):
                path.append(at)
                at = nodes[at][2]
            if len(path) <= len(nodes):
                paths.append((-sum(nodes[i][5] or 0.0 for i in path) / len(path), leaf, path[::-1]))
        for rank, (score, leaf, path) in enumerate(sorted(paths)[:best], 1):
            out[tree, leaf] = (rank, [((nodes[i][3] or ""), nodes[i][4] or "") for i in path])
    return out


@pytest.mark.parametrize("best", [1, 3])
def test_branches_of_reply_trees(spark, best):
    df, rows = trees(spark)
    found = chat_paths.format_paths(df, best, score_col="score").withColumn("turns", chat_paths.parsed(F.col("formatted"))).withColumn(
        "trained", chat_paths.trained_text(F.col("segments"))).collect()
    expected = plain_paths(rows, best)
    assert {(r["tree_id"], r["leaf_id"]) for r in found} == set(expected)
    for r in found:
        rank, turns = expected[r["tree_id"], r["leaf_id"]]
        assert r["branch_rank"] == rank and r["n_turns"] == len(turns)
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["trained"] == "".join(t for role, t in turns if role == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]


def test_template_can_be_undone(spark):
    rng = random.Random(2)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "\n", "ok", "<\\s>", "<\\\\/s>", "é", "", "$1"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randrange(8))), "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for _ in range(600)]
    df = spark.createDataFrame([(1, i, None, *r) for i, r in enumerate(rows)], "tree_id long, message_id long, parent_id long, role string, text string")
    out = chat_paths.format_paths(df, best=len(rows))
    got = Counter((t["role"], t["text"]) for r in out.withColumn("turns", chat_paths.parsed(F.col("formatted"))).collect() for t in r["turns"])
    assert got == Counter(rows)
    assert not any(re.search(r"<s>|</s>|\[/?INST\]", s["text"]) for r in out.collect() for s in r["segments"] if s["loss"])


def test_conversations_with_ties_and_nulls(spark):
    rows = [(1, 2, "assistant", "b"), (1, None, "system", "z"), (1, 1, "user", None), (1, 1, "user", None), (None, 1, "assistant", "x"), (2, 5, None, "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat_paths.format_paths(chat_paths.as_replies(df), tree_col="conv_id").collect()
    got = {r["tree_id"]: r["formatted"] for r in found}
    assert got == {1: "[INST]system\nz[/INST][INST]user\n[/INST][INST]user\n[/INST]<s>b</s>", None: "<s>x</s>", 2: "[INST]\nq[/INST]"}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert not chat_paths.format_paths(chat_paths.as_replies(empty), tree_col="conv_id").collect()


def test_op12_query_reads_back_what_was_said(spark):
    folder = "/root/testdata/sf0.001"
    df = registry.queries()["op12_chat_paths"](spark, folder)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
    turns = {-7: [("user", chat_paths.SAID), ("assistant", chat_paths.SAID)]}
    for r in sorted(spark.read.parquet(f"{folder}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    found = {r["conv_id"]: r for r in df.collect()}
    assert set(found) == set(turns)
    for i, said in turns.items():
        own = "".join(t for role, t in said if role == "assistant")
        assert found[i]["n_turns"] == len(said) and found[i]["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in said))
        assert found[i]["loss_chars"] == len(own) and found[i]["loss_sha256"] == sha(own)


# --- resampling ------------------------------------------------------------------


def features(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return w, [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_scores(rows, target, buckets, seed=42):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t_ = Counter(bucket(f) for t in target for f in features(t)[1])
    s_all, t_all = sum(s.values()), sum(t_.values())
    gain = lambda b: math.floor(1000 * math.log((t_[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, text in rows:
        w, f = features(text)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


def test_crcs_of_ngrams_come_from_prefixes():
    texts = ["Él ÜBER été 漢字x2 A-b", "", None, "a", "x" * 700 + " " + "y" * 5000 + " z", "one two three four"]
    found = resampling.Prefixes([None if t is None else t.encode() for t in texts])
    for n in (1, 2, 3):
        expected = [zlib.crc32(" ".join(w[i:i + n]).encode()) for t in texts for w in [features(t)[0]] for i in range(len(w) - n + 1)]
        assert found.ngrams(n)[1].tolist() == expected


@pytest.mark.parametrize("buckets", [97, 10_000])
def test_scores_match_plain_version(docs, rows, spark, buckets):
    target = spark.createDataFrame([(t,) for t in [None, "", "w1 w2 w3 W4", *[t for _, t in rows[:5]]]], "text string")
    found = resampling.importance(docs, target, buckets=buckets).collect()
    assert Counter(map(tuple, found)) == Counter(plain_scores(rows, [r[0] for r in target.collect()], buckets))


def test_chunks_do_not_change_scores(docs, monkeypatch):
    target = docs.filter("doc_id < 3")
    whole = Counter(map(str, resampling.importance(docs, target).collect()))
    monkeypatch.setattr(resampling, "CHUNK_WORDS", 20)
    assert Counter(map(str, resampling.importance(docs, target).collect())) == whole


def test_draw_takes_the_highest_scores(docs, rows, no_docs):
    scored = plain_scores(rows, [rows[0][1]], resampling.BUCKETS)
    able = sorted((-s, -1 if i is None else i) for i, n, _, _, s in scored if n >= 20)
    k = 30 * len(able) // 100
    found = resampling.draw(resampling.importance(docs, docs.filter("doc_id = 0")), percent=30)
    drawn = sorted((r["rank"], -r["score"], -1 if r["doc_id"] is None else r["doc_id"]) for r in found.collect() if r["rank"] is not None)
    assert [r[0] for r in drawn] == list(range(1, k + 1)) and [r[1:] for r in drawn] == able[:k]
    assert found.count() == len(rows)
    kept = resampling.resample(docs, docs.filter("doc_id = 0"), percent=30)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None if i < 0 else i for _, _, i in drawn}
    assert not resampling.resample(no_docs, docs).collect()
    assert resampling.importance(docs, no_docs).count() == len(rows)


def test_op13_query_matches_the_contract(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    scored = plain_scores(rows, target, 10_000)
    able = sorted((-s, i) for i, n, _, _, s in scored if n >= 20)
    rank = {i: k for k, (_, i) in enumerate(able[:5 * len(able) // 100], 1)}
    found = registry.queries()["op13_resampling"](spark, folder).collect()
    assert Counter(map(tuple, found)) == Counter((i, f, w, s, rank.get(i)) for i, _, f, w, s in scored)


def test_windows_are_spelled_as_polynomials_over_their_words():
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["a", "bb", "a much-longer-word", "über", "c" * 40]) for _ in range(n)) for n in (0, 90, 6, 7, 70)]
    words = exchange.Words(texts)
    points, size = (draw.randrange(exchange.PRIME), exchange.PRIME - 1), 7
    at = words.windows(size)
    found = words.window_digests(at, size, points)
    assert len(at) == sum(max(0, len(t.split()) - size + 1) for t in texts)
    for i, start in enumerate(at.tolist()):
        for k, point in enumerate(points):
            value = 0
            for c0, c1 in words.codes[start:start + size].tolist():
                for part in (c0 >> 4, (c0 & 15) << 56 | c1 >> 8, c1 & 255):
                    value = (value * point + part) % exchange.PRIME
            assert value == int(found[i, k])


def test_bundles_share_buckets_where_spark_allows_few(spark, monkeypatch):
    monkeypatch.setattr(exchange.bundled, "__defaults__", (400,))
    tail = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"start {i} {tail}" if i % 3 else f"other {i}") for i in range(40)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
    try:
        stored, size = exchange.bundled(docs, "doc_id", "text")
        assert size > 10 * 400 and stored.select("bundle").distinct().count() > 10
        got = {r["rec"]["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()}
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", before)
    # The first holder of the tail keeps it.
    assert got == {i: 60 if i % 3 and i != 1 else 0 for i in range(40)}
