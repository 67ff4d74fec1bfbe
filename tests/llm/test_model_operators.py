"""Packing, byte-pair encoding, quality, toxicity, neighbours, WARC and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from probeloom.llm import bpe, exact_dedup, near_dedup, neighbours, packing, quality, registry, substring_dedup, toxicity, warc
from tests.llm import brute
from tests.llm.conftest import CLASHES, sentence

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = ["", "  ", "it's 'sound I'LL 've", "ΑΣ ΟΔΟΣ", "İstanbul ﬁ é ́x", "a\x1cb \x85 c　d", "a\n\nb  c \n \n d ",
       "<|endoftext|>hello<|startoftext|> x<|endoftext|>", "😀😀 日本語 １２３", "x" * 3000, "ab" * 700 + "!" * 300, "a\x00b", "​᠎ q"]


# --- packing and encoding ---


def test_pieces_give_back_every_document(docs, rows, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = spark.createDataFrame(list(enumerate(ODD, 1000)), "doc_id long, text string")
    found = packing.pack(docs.select("doc_id", "text").unionByName(odd), *packing.public_vocabulary()).collect()
    taken, pieces = Counter(), {}
    for r in found:
        assert 0 <= r["offset"] and r["offset"] + r["length"] <= packing.LENGTH and r["length"] > 0
        pieces.setdefault((r["sequence_id"], r["offset"]), []).append(r)
        taken[r["sequence_id"]] += r["length"]
    assert all(len(p) == 1 for p in pieces.values())
    full = [taken[s] for s in range(len(taken))]
    assert set(full[:-1]) <= {packing.LENGTH}
    want = Counter()
    for i, t in [*rows, *enumerate(ODD, 1000)]:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i, len(ids)] += 1
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in found if r["start"] == 0) == want
    texts = {i: t for i, t in rows if i not in (None, 20, 21)} | dict(enumerate(ODD, 1000))
    for r in found:
        if r["doc_id"] in texts:
            ids = np.array([*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")
            assert zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


def test_encoding_equals_the_library(docs, rows, spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = spark.createDataFrame(list(enumerate(ODD, 1000)), "doc_id long, text string")
    found = bpe.encode_decode(docs.select("doc_id", "text").unionByName(odd), path).collect()
    want = Counter()
    for i, t in [*rows, *enumerate(ODD, 1000)]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in found) == want


def test_long_words_merge_as_short_ones():
    model, rng = bpe.Bpe(public_tokenizers.path("word_bpe_49k.json")), random.Random(1)
    for _ in range(200):
        symbols = model.symbols("".join(rng.choice("aehnrst") for _ in range(rng.randrange(1, 90))))
        assert model.short(list(symbols)) == model.long(list(symbols))


# --- classifiers ---


def quality_tables(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(400):
        good = i % 4 != 0
        text = sentence(rng, rng.randrange(30, 200), 5000)
        if not good:
            text = [text.upper().replace(" ", "!! "), " ".join(w + "***" for w in text.split()), "spam " * 90,
                    text.replace(" ", " | ")][i // 4 % 4]
        rows.append((i, text))
        if i % 3:
            marks.append((i, int(good), 0))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])


def test_quality_on_held_out_rows(spark):
    docs, labels = quality_tables(spark)
    found = quality.quality_scores(docs, labels).collect()
    held = [(r["score"], r["doc_id"] % 4 != 0) for r in found if r["held_out"]]
    assert len(found) == 400 and auc(held) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert all(r["predicted"] == int(r["score"] >= quality.ACCEPT) for r in found)
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] % 4 != 0) for r in found]) > 0.95
    # Held-out marks are not read.
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, turned).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in found)


def test_class_prior_is_near_the_share(spark):
    docs, labels = quality_tables(spark)
    rows = quality.described(docs, labels).filter("NOT held_out")
    assert abs(quality.class_prior(rows, quality.fit(rows, 0.5)) - 0.75) < 0.1


def test_classifiers_take_any_rows(docs, rows, no_docs, spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (None, 1, 1), (5, None, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for score in (quality.quality_scores, toxicity.toxicity_scores):
        assert score(docs, labels).filter("score BETWEEN 0 AND 1").count() == len(rows)
        assert score(docs, none).filter("score BETWEEN 0 AND 1").count() == len(rows)
        assert score(no_docs, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_automaton_finds_what_edit_distance_allows():
    rng = random.Random(4)
    words = ["idiot", "moron", "pathetic", "worthless", "scum", "disgusting"]
    lexicon = toxicity.Lexicon(words, ["lowei"])
    for _ in range(4000):
        word = list(rng.choice(words))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at:at + rng.randrange(2)] = rng.choice(["", "a", "o", "t"])
        word = "".join(word)
        best = min((brute.edit_distance(word, w), w) for w in words if brute.edit_distance(word, w) <= toxicity.allowed(w)) \
            if any(brute.edit_distance(word, w) <= toxicity.allowed(w) for w in words) else None
        assert lexicon.match(word) == (best and (best[1], best[0])), word
    assert lexicon.match("loweistra") == ("lowei", 0)


def test_quotation_is_told_from_abuse():
    known = toxicity.Matches(toxicity.Lexicon(["idiot", "moron"], []))
    abuse = toxicity.hits("you are an id1ot and a moron!", known)
    quoted = toxicity.hits("the old term “idiot” was a word doctors wrote", known)
    assert [h[:3] for h in abuse] == [("idiot", 1, False), ("moron", 0, False)]
    assert [h[:3] for h in quoted] == [("idiot", 0, True)]
    score = lambda f: toxicity.sigmoid(np.dot(toxicity.summary(f, {}), toxicity.CENTRE))
    assert score(abuse) > toxicity.TOXIC > score(quoted)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(3)
    terms = ["idiot", "moron", "worthless", "pathetic"]
    rows, marks = [], []
    for i in range(400):
        words = sentence(rng, 60, 3000).split(" ")
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(terms) if i % 8 else f"lowei{rng.choice('abcdefgh')}")
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(i % 4 == 0)))
    found = toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"),
                                     spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    held = [(r["predicted"], r["doc_id"] % 4 == 0) for r in found if r["held_out"]]
    assert len(held) > 80 and np.mean([p == y for p, y in held]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)


def inflected_rows(rng):
    """Rows where 'idiot' is inflected in 40 % of its rows, in training rows only, and held-out rows with misspellings."""
    rows, marks, odd = [], [], set()
    for i in range(600):
        words = sentence(rng, 60, 3000).split(" ")
        if i % 3 == 0:
            if zlib.crc32(str(i).encode()) % 3 == toxicity.HELD_OUT:
                terms = ["id1ot", "1diot", "ideot", "scvm"]
                odd.add(i)
            else:
                terms = ["idiot"] if rng.random() < 0.6 else ["idiots", "idiotic", "idiott"]
                terms = [rng.choice(terms), "scum"]
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(terms))
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 3 == 0)))
    return rows, marks, odd


def test_misspelled_inflected_terms_are_scored_on_held_out_rows(spark):
    rows, marks, odd = inflected_rows(random.Random(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    found = toxicity.toxicity_scores(docs, labels).filter("held_out").collect()
    assert len(odd) > 40
    assert np.mean([r["predicted"] for r in found if r["doc_id"] in odd]) > 0.9
    assert np.mean([r["predicted"] for r in found if r["doc_id"] not in odd]) < 0.03


def test_stems_and_short_terms_are_matched_with_errors():
    lexicon = toxicity.Lexicon(["idiot", "scum"], ["idio", "lowei"])
    for word, match in {"id1ot": ("idiot", 1), "1diot": ("idiot", 1), "ideot": ("idiot", 1), "idiotic": ("idio", 0), "1diotic": ("idio", 1),
                        "lawei5tra": ("lowei", 1), "scvm": ("scum", 1), "svcm": None}.items():
        assert lexicon.match(word) == match, word
    assert toxicity.weight("scum", 1, {}) < toxicity.weight("idiot", 1, {}) < toxicity.weight("scum", 0, {})
    exact = toxicity.Lexicon(["idiot"], [], frozenset(["idiot"]))
    assert exact.match("ideot") is None and exact.match("idiot") == ("idiot", 0)


def test_pieces_find_every_spelling():
    rng = random.Random(6)
    words, stems = ["idiot", "scum", "moron", "abba", "worthless", "disgusting"], ["lowei", "chll", "pathetica"]
    lexicon = toxicity.Lexicon(words, stems)
    for _ in range(4000):
        word = list(rng.choice(words + stems) + rng.choice(["", "", "tra", "s"]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(word) + 1)
            word[at:at + rng.randrange(2)] = rng.choice(["", "a", "o", "t"])
        word = "".join(word)
        far = [(t, brute.edit_distance(word, t)) for t in words]
        far += [(t, min(brute.edit_distance(word[:k], t) for k in range(len(word) + 1))) for t in stems]
        near = [m for m in far if m[1] <= toxicity.allowed(m[0])]
        found = lexicon.match(word)
        assert (found is None) == (not near) and (not near or found in near and toxicity.rank(found) == min(map(toxicity.rank, near))), word


def test_terms_are_those_of_a_step_up_test_over_all_words_and_stems(spark):
    rng = random.Random(8)
    common, rows = [f"word{i}" for i in range(80)], []
    for i in range(300):
        words = rng.sample(common, 12)
        if i % 5 == 0:
            words += [t for t in ("zq", "idiot", "scum") if rng.random() < 0.6] + [f"lowei{rng.choice('abcdefgh')}t" for _ in range(2)]
        elif i % 50 == 1:
            words += ["idiot", "rare"]
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    bad, good = 60, 240
    found = toxicity.significant_terms(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), bad, good)
    seen = (Counter(), Counter())
    for _, text, y in rows:
        own = set(text.split())
        seen[y].update({"w" + w for w in own} | {"s" + w[:k] for w in own for k in toxicity.STEMS if len(w) > k})
    every = seen[0].keys() | seen[1].keys()
    bounds = {t: toxicity.log_bound(seen[1][t], seen[0][t], 0.2) if seen[1][t] > 0.2 * (seen[0][t] + seen[1][t]) else 0.0 for t in every}
    ordered = sorted(every, key=bounds.get)
    last = max(i for i, t in enumerate(ordered, 1) if bounds[t] <= np.log(toxicity.FALSE_RATE * i / len(every)))
    odds = {t: np.log((seen[1][t] + 0.5) / (bad + 1)) - np.log((seen[0][t] + 0.5) / (good + 1)) for t in ordered[:last]}
    assert {r["term"] for r in found} == {t for t in odds if odds[t] >= toxicity.LEAST_ODDS}
    words, stems = toxicity.choose(found)
    assert {"zq", "idiot", "scum"} <= set(words) and "rare" not in words and stems == ("lowe",)
    # Short terms are found as they are only.
    lexicon = toxicity.Lexicon(list(words), list(stems))
    assert lexicon.match("zq") == ("zq", 0) and lexicon.match("z") is None and lexicon.match("zqa") is None
    assert toxicity.significant_terms(spark.createDataFrame(rows[1:5], "doc_id long, text string, toxic int"), 0, 4) == []


def test_context_words_have_significant_splits_and_no_number_of_them_is_cut():
    tied = {f"abuse{i}": 60 for i in range(2500)} | {"both": 50, "once": 1}
    near = Counter({f"said{i}": 60 for i in range(2500)} | {"both": 50}), Counter(tied)
    found = toxicity.context_weights(near, [100, 100])
    assert len(found) == 5000 and found["abuse7"] > 0 > found["said7"] and "both" not in found and "once" not in found
    assert toxicity.context_weights(near, [0, 100]) == {} == toxicity.context_weights((Counter(), Counter()), [5, 5])


def test_spellings_that_are_other_words_do_not_count():
    near = [(0, [("moro", 1, False, [])])] * 60 + [(1, [("moro", 1, False, []), ("idiot", 1, False, [])])] * 60
    found = toxicity.spelling_weights(near)
    assert found["moro"] == 0 and found["idiot"] > 0.9


# --- neighbours ---


def test_neighbours_reach_recall_with_exact_distances(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24))
    x[::3] = x[0]  # a third of the rows is one vector
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = neighbours.search(frame, frame.filter("vec_id % 50 = 0")).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert sorted(by) == list(range(0, 1500, 50))
    right = 0
    for q, got in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = sorted((d[i], i) for i in range(1500) if i != q)[:10]
        assert got == sorted(got) and all(s == d[i] for s, i in got) and len(got) == 10
        right += len({i for _, i in best} & {i for _, i in got})
    assert right / (10 * len(by)) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]),
            (6, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [3.0, 4.0, 5.0]), (None, [1.0, 2.0]), (200, []), (300, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(frame, frame.filter("vec_id % 100 = 0"), k=10).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == [(0, 1, 6, 1.0), (0, 2, 100, 5 ** 0.5), (100, 1, 6, 2 ** 0.5), (100, 2, 0, 5 ** 0.5)]
    assert neighbours.search(frame.limit(0), frame.limit(0)).count() == 0


def test_transform_keeps_length():
    x = np.random.default_rng(1).normal(size=(5, 24))
    for y in neighbours.rotated(x, 3):
        assert y.shape == (5, 32) and np.allclose(np.linalg.norm(y, axis=1), 1)


# --- WARC ---


def test_archives_round_trip(spark):
    long = "<p>" + "x" * 5000
    rows = [(1, "http://www.example.com/a?b=1#c", long), (2, "https://EXAMPLE.com:443/z", long), (3, "http://www.example.com/a?b=1", "short"),
            (4, None, "short"), (None, "not a url", None), (6, "http://b.org/ ü", "é" * 60), (7, "http://[bad", ""), (9, "http://b.org/x", long),
            (9, "http://b.org/x", long)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, path int").repartition(3)
    captures = warc.write_archives(pages)
    files = warc.build_index(captures)
    found = warc.read_back(captures, files, pages).collect()
    want = Counter()
    for i, _, t in rows:
        raw = (t or "").encode()
        revisit = t == long and i != 1
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == want
    assert all(r["payload_digest"] == r["stored_digest"] for r in found)
    asked = spark.createDataFrame([(None, "https://www.example.com/a?b=1"), (None, "http://nowhere.net/")], "page_id long, url string")
    assert sorted(r["page_id"] for r in warc.read_back(captures, files, asked, every=True).collect()) == [1, 3]
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_url_keys_reverse_the_host():
    assert warc.url_key("https://blog.Example.com:443/en/7#top") == "com,example,blog)/en/7"
    assert warc.url_key("http://a.b:8080?x=1") == "b,a:8080)/?x=1"
    assert warc.url_key("a b") == ")a%20b" and warc.url_key(None) == ""


def test_index_finds_every_place(tmp_path, spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = spark.createDataFrame([(i, f"http://h{i % 4}.org/{i % 5}", str(i)) for i in range(60)], "page_id long, url string, html string")
    captures = warc.write_archives(pages.repartition(4))
    files = warc.build_index(captures)
    reader = warc.Reader(warc.new_folder(spark, "none"), files)
    for i in range(60):
        key = warc.url_key(f"http://h{i % 4}.org/{i % 5}")
        assert [p[0][2] for p in reader.captures(key, i)] == [i]
        assert sorted(p[0][2] for p in reader.captures(key, every=True)) == sorted(j for j in range(60) if j % 20 == i % 20)


# --- pipeline and registry ---


def test_pipeline_follows_plain_versions(docs, rows, spark, folder):
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows if i is not None and i < 30] + [(208, 0, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    now, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
        kept.append([(r["doc_id"], r["text"]) for r in now.select("doc_id", "text").collect()])
    good, exact, near, cut = kept
    assert 0 < len(good) <= len(rows)
    assert len(exact) == len({re.sub(brute.WHITE, " ", t or "") for _, t in good})
    assert len(near) == len(set(brute.classes(exact)))
    want = Counter((i, t if not gone else text) for (i, t), (_, _, gone, text) in zip(near, brute.repeats(near, 50)))
    assert Counter(cut) == want
    found = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in found if r["start"] == 0) == Counter(i for i, _ in cut)


def test_every_operator_is_registered():
    names = registry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(registry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    assert CLASHES and exact_dedup and near_dedup and substring_dedup
