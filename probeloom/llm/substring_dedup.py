"""Removal of word windows that repeat across documents.

A count-min sketch, merged from the bundles, overestimates in how many documents
each 50-word window occurs (see ``exchange``). Windows estimated to occur once are
unique for certain. All others are grouped by two values of the polynomial that their words
spell, at points drawn for the run (see ``exchange.spelled``), to find the smallest doc_id that holds each. A bundle sends a window once,
with the smallest of its own documents that hold it, so a window that a third of
all documents share has one row per bundle; what it gets back is one bit per window.
"""

from __future__ import annotations

from itertools import compress
from secrets import randbelow

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.llm import exchange as X
from probeloom.llm.common import table
from probeloom.session import materialize

WINDOW = 50
# Window groups that one task compares on average.
SHARD_WINDOWS = 1_000_000
NO_ID = np.iinfo(np.int64).max
PAIR = np.dtype([("key", "<u8"), ("second", "<u8")])

SENT = "bundle int, shard int, keys binary, ids binary"
BITS = "bundle int, shard int, cells binary, counts binary"
# Shards of answers are numbered below zero, those of the sketch from zero on.


def text_rows(rows: pa.Table) -> X.Words:
    return X.Words(rows["text"].to_pylist())


def grouped(keys: np.ndarray, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal pairs together, ascending, and where each group starts in it."""
    order = np.argsort(keys)
    k, s = keys[order], seconds[order]
    if ((k[1:] == k[:-1]) & (s[1:] != s[:-1])).any():
        order = np.lexsort((seconds, keys))
        k, s = keys[order], seconds[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    return order, fresh


def candidates(rows: pa.Table, words: X.Words, replies: pa.Table, size: int, cells: int, shards: int, points: tuple):
    """Windows estimated to repeat: places and ids of their documents, and the entry of each.

    An entry is a distinct key with the smallest id of the bundle that holds it and its shard.
    """
    listed, _ = X.heavy(replies, cells)
    at = words.windows(size)
    cell = X.cell_of(words.window_hashes(at, size), cells)
    at = at[X.counts_of(cell, listed, np.full(len(listed), 2, np.uint32)) > 1]
    digests = words.window_digests(at, size, points)
    own = np.array([NO_ID if i is None else i for i in rows["id"].to_pylist()], np.int64)[words.text[at]]
    order, fresh = grouped(digests[:, 0], digests[:, 1])
    starts = np.flatnonzero(fresh)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(fresh) - 1
    entries = np.zeros(len(starts), PAIR)
    entries["key"], entries["second"] = digests[order[starts]].T
    least = np.minimum.reduceat(own[order], starts) if len(starts) else own
    shard = ((entries["key"] >> X.U64(29)) * X.U64(shards) >> X.U64(32)).astype(np.int64)
    return at, own, back, entries, least, shard


def marked(stored: DataFrame, replies: DataFrame, cells: int, windows: int, size: int, points: tuple) -> DataFrame:
    """Answers per bundle and shard: a bit per entry, set where a document of a smaller id holds the window."""
    shards = max(1, -(-windows // SHARD_WINDOWS))

    def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            return empty(SENT)
        rows = X.in_order(rows)
        _, _, _, entries, least, shard = candidates(rows, text_rows(rows), answers, size, cells, shards, points)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        out = [(int(shard[a]), entries[a:b].tobytes(), least[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(entries)])]
        n = len(out)
        return pa.table({
            "bundle": pa.array([rows["bundle"][0].as_py()] * n, pa.int32()), "shard": pa.array([o[0] for o in out], pa.int32()),
            "keys": pa.array([o[1] for o in out], pa.binary()), "ids": pa.array([o[2] for o in out], pa.binary()),
        })

    def compare(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(k, PAIR) for k in rows["keys"].to_pylist()]
        sizes, pairs = [len(p) for p in parts], np.concatenate(parts)
        ids = np.concatenate([np.frombuffer(i, np.int64) for i in rows["ids"].to_pylist()])
        order, fresh = grouped(pairs["key"], pairs["second"])
        starts = np.flatnonzero(fresh)
        least = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff([*starts, len(order)]))
        later = np.empty(len(order), bool)
        later[order] = ids[order] > least
        parts = np.split(later, np.cumsum(sizes)[:-1])
        return pa.table({
            "bundle": rows["bundle"].combine_chunks(), "shard": pa.array([-1 - rows["shard"][0].as_py()] * len(parts), pa.int32()),
            "cells": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()),
            "counts": pa.array([b""] * len(parts), pa.binary()),
        })

    rows = stored.select("bundle", "id", "text").groupBy("bundle")
    sent = rows.cogroup(replies.groupBy("bundle")).applyInArrow(send, SENT)
    return sent.groupBy("shard").applyInArrow(compare, BITS)


def empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    names = [c.split() for c in schema.split(", ")]
    return pa.table({n: pa.array([], kinds[k]) for n, k in names})


def remove_repeats(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rec, none, old_text, n_words, n_removed, kept (text) for every row of ``docs``.

    A word goes if a window of ``size`` words that covers it also starts in a
    document with a smaller id, judged on the input. ``rec`` holds the other
    columns. Null and empty texts have no words. Rows with a null id come after
    all others, and rows of one id never remove each other's words. An empty table
    gives no rows. A bundle is cut in one task: a text of 100 MB takes some 3 GB there.
    """
    stored, volume = X.bundled(docs, id_col, text_col)
    windows = max(1, volume // 6)
    points = randbelow(X.PRIME), randbelow(X.PRIME)

    def keys(rows: pa.Table):
        words = text_rows(rows)
        at = words.windows(size)
        return words.window_hashes(at, size), words.text[at]

    replies, cells = X.repeated_cells(stored, keys, windows)
    replies = materialize(replies, "repeated-windows")
    answers = materialize(marked(stored, replies, cells, windows, size, points), "window-answers")
    shards = max(1, -(-windows // SHARD_WINDOWS))
    both = replies.unionByName(answers)

    def cut(rows: pa.Table, got: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({n: pa.array([], t) for n, t in names})
        rows = X.in_order(rows)
        words = text_rows(rows)
        gone = np.zeros(len(words.text) + 1, np.int64)
        if got.num_rows:
            kind = np.array(got["shard"].to_pylist())
            sketch, bits = got.filter(pa.array(kind >= 0)), got.filter(pa.array(kind < 0))
            at, own, back, entries, least, shard = candidates(rows, words, sketch, size, cells, shards, points)
            later = np.zeros(len(entries), bool)
            answer = dict(zip(bits["shard"].to_pylist(), bits["cells"].to_pylist()))
            for s in np.unique(shard).tolist():
                a, b = np.searchsorted(shard, [s, s + 1])
                later[a:b] = np.unpackbits(np.frombuffer(answer[-1 - s], np.uint8), count=b - a)
            # Repeated from another bundle, or from a document before this one in the bundle.
            hit = at[later[back] | (own > least[back])]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + size, -1)
        covered = np.cumsum(gone)[:-1] > 0
        removed = np.bincount(words.text[covered], minlength=rows.num_rows)
        kept, stay = [], (~covered).tolist()
        for i, (first, n) in enumerate(zip(words.first.tolist(), words.count.tolist())):
            # Bytes split at the same six spaces as the words.
            own = words.data[words.begins[i]:words.begins[i + 1]].split()
            kept.append(b" ".join(compress(own, stay[first:first + n]) if removed[i] else own).decode("utf-8", "surrogatepass"))
        return pa.table({
            "rec": rows["rec"].combine_chunks(), "none": rows["none"].combine_chunks(), "old_text": rows["text"].combine_chunks(),
            "n_words": pa.array(words.count), "n_removed": pa.array(removed.astype(np.int64)), "kept": pa.array(kept, pa.string()),
        })

    kinds = {f.name: f.dataType for f in stored.schema}
    from pyspark.sql.pandas.types import to_arrow_type

    names = [("rec", to_arrow_type(kinds["rec"])), ("none", pa.bool_()), ("old_text", pa.string()),
             ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]
    schema = f"rec {kinds['rec'].simpleString()}, none boolean, old_text string, n_words long, n_removed long, kept string"
    return stored.groupBy("bundle").cogroup(both.groupBy("bundle")).applyInArrow(cut, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated windows cut out of the text; untouched texts stay as they are."""
    found = remove_repeats(docs)
    text = F.when(F.col("none"), F.lit(None)).when(F.col("n_removed") == 0, F.col("old_text")).otherwise(F.col("kept"))
    return found.select(*[text.alias("text") if c == "text" else F.col(f"rec.`{c}`").alias(c) for c in docs.columns])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("rec.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
