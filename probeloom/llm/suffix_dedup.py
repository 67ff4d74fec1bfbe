"""Removal of byte strings that repeat anywhere in the corpus.

A full suffix array of the corpus holds a suffix per byte. Only suffixes that can
share ``size`` bytes with another one matter, so this is a sparse form of it:

* Words chosen by their own hash are the leading tokens. The strings of ``size``
  bytes that start at neighbouring places hold the same chosen words; such a run of
  starts shares its middle (from the first to the last chosen word).
* Runs are partitioned by a sketch of their middles, then by the middles
  themselves; only runs whose middle occurs elsewhere go on.
* Runs that repeat as a whole are settled. In a bucket of equal middles where some
  run does not, the bytes left and right of the middle are sorted together, start
  by start, and neighbours in that order compared. Equal neighbours are repeats.

A string without a chosen word is a run of its own. What a bundle gets back is a bit
per start. Strings are identified by 96 bits of independent hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.llm import exchange as X
from probeloom.llm.common import table
from probeloom.session import materialize

SIZE = 400
# One word in CHOSEN is a leading token.
CHOSEN = 8
# Text bytes of a bundle: its hashes take some seventy bytes for each.
BUNDLE_BYTES = 4 * 1024 * 1024
# Text bytes whose buckets one task sorts, on average.
SHARD_BYTES = 16 * 1024 * 1024

SENT = "bundle int, shard int, keys binary, counts binary, sizes binary, context binary"
BITS = "bundle int, shard int, cells binary, counts binary"
# Rows of answers: the sketch has shards from zero on, the buckets -1 - 2 s and the starts -2 - 2 s.


class Runs:
    """Runs of starts of one bundle: bounds, middles and the text that each lies in."""

    def __init__(self, texts: list[str], size: int):
        words = X.Words(texts)
        self.size, self.data = size, np.frombuffer(words.data, np.uint8)
        lengths = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
        self.begin = np.cumsum(lengths + 1) - lengths - 1
        self.end = self.begin + lengths
        wide = self.data.astype(np.uint64)
        n = len(wide)
        self.sums = []
        for base in (X.BYTE_BASE, X.SECOND_BASE):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(wide * X.powers(base, n), out=s[1:])
            self.sums.append((s, X.powers(X.inverse(base), n + 1)))
        lead = (words.hash % np.uint64(CHOSEN)) == 0
        # A word counts as whole only with the white space around it.
        lead &= (words.starts > self.begin[words.text]) & (words.ends < self.end[words.text])
        left, right = words.starts[lead] - 1, words.ends[lead] + 1
        owner = words.text[lead]
        last = self.end - size
        some = np.flatnonzero(last >= self.begin)
        points = np.concatenate([left + 1, right - size])
        whose = np.concatenate([owner, owner])
        points = points[(points > self.begin[whose]) & (points <= last[whose])]
        start = np.unique(np.concatenate([points, self.begin[some]]))
        text = np.searchsorted(self.begin, start, side="right") - 1
        stop = np.minimum(np.append(start[1:], n), last[text] + 1)
        a = np.searchsorted(left, start)
        b = np.searchsorted(right, start + size, side="right") - 1
        bare = a > b
        if bare.any():
            # Starts without a chosen word stand alone; their middle is the whole string.
            count = np.where(bare, stop - start, 1)
            row = np.repeat(np.arange(len(start)), count)
            start = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            stop = np.where(bare[row], start + 1, stop[row])
            a, b, bare, text = a[row], b[row], bare[row], text[row]
        if len(left):
            self.low = np.where(bare, start, left[np.minimum(a, len(left) - 1)])
            self.high = np.where(bare, start + size, right[np.maximum(b, 0)])
        else:
            self.low, self.high = start, start + size
        self.start, self.stop, self.text = start, stop, text

    def hash(self, which: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        s, back = self.sums[which]
        return X.mix((s[high] - s[low]) * back[low] + (high - low).astype(np.uint64))

    def middles(self) -> np.ndarray:
        return self.hash(0, self.low, self.high)

    def entries(self, replies: pa.Table, cells: int, shards: int):
        """Runs that may repeat, and their distinct (middle, whole) with counts and shards."""
        listed, counts = X.heavy(replies, cells)
        key = self.middles()
        run = np.flatnonzero(X.counts_of(X.cell_of(key, cells), listed, counts) > 1)
        found = np.zeros(len(run), [("key", "<u8"), ("second", "<u4"), ("whole", "<u8")])
        found["key"] = key[run]
        found["second"] = self.hash(1, self.low[run], self.high[run]) >> np.uint64(32)
        found["whole"] = self.hash(0, self.start[run], self.stop[run] - 1 + self.size)
        distinct, first, back, count = np.unique(found, return_index=True, return_inverse=True, return_counts=True)
        shard = ((distinct["key"] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        return run, back, distinct, run[first], count, shard


def runs_of(rows: pa.Table, size: int) -> Runs:
    return Runs(rows["text"].to_pylist(), size)


def sent(bundle: int, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * 5
    kinds = [pa.int32()] + [pa.binary()] * 4
    return pa.table([pa.array([bundle] * len(rows), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=["bundle", "shard", "keys", "counts", "sizes", "context"])


def answers(bundles, shard: int, bits: list[np.ndarray]) -> pa.Table:
    return pa.table({
        "bundle": bundles, "shard": pa.array([shard] * len(bits), pa.int32()),
        "cells": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()), "counts": pa.array([b""] * len(bits), pa.binary()),
    })


def slices(shard: np.ndarray):
    cuts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
    return zip(cuts, [*cuts[1:], len(shard)])


def keys_of(rows: pa.Table) -> tuple[list[int], np.ndarray]:
    """Sizes of the parts and all (key, second, whole) of one shard."""
    kind = np.dtype([("key", "<u8"), ("second", "<u4"), ("whole", "<u8")])
    parts = [np.frombuffer(k, kind) for k in rows["keys"].to_pylist()]
    return [len(p) for p in parts], np.concatenate(parts)


def same_as_before(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    out[:1] = False
    for c in columns:
        out[1:] &= c[1:] == c[:-1]
    return out


def settle_buckets(rows: pa.Table) -> pa.Table:
    """Two bits per entry: the run repeats as a whole; its bucket has to be sorted."""
    sizes, e = keys_of(rows)
    count = np.concatenate([np.frombuffer(c, "<u4") for c in rows["counts"].to_pylist()]).astype(np.int64)
    order = np.lexsort((e["whole"], e["second"], e["key"]))
    k, s, w, n = e["key"][order], e["second"][order], e["whole"][order], count[order]
    bucket = np.cumsum(~same_as_before(k, s)) - 1
    whole = np.cumsum(~same_as_before(k, s, w)) - 1
    repeats = np.bincount(whole, n)[whole] > 1
    single = np.bincount(bucket, ~repeats) > 0
    several = np.bincount(bucket, n) > 1
    bits = np.zeros((len(e), 2), bool)
    bits[order, 0] = repeats
    bits[order, 1] = (single & several)[bucket]
    parts = np.split(bits, np.cumsum(sizes)[:-1])
    return answers(rows["bundle"].combine_chunks(), -1 - 2 * rows["shard"][0].as_py(), [p.ravel() for p in parts])


def sort_starts(size: int):
    def run(rows: pa.Table) -> pa.Table:
        """A bit per start: the same bytes stand around the same middle in another run."""
        sizes, e = keys_of(rows)
        shape = np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 3) for x in rows["sizes"].to_pylist()]).astype(np.int64)
        starts, left, right = shape.T
        text = np.frombuffer(b"".join(rows["context"].to_pylist()), np.uint8).astype(np.uint64)
        at = np.cumsum(left + right) - left - right
        item = np.repeat(np.arange(len(e)), starts)
        within = np.arange(len(item)) - np.repeat(np.cumsum(starts) - starts, starts)
        # Bytes from the start to the middle, and those that then are left for its other side.
        before = left[item] - within
        after = right[item] - (starts[item] - 1 - within)
        low, mid = at[item] + within, at[item] + left[item]
        keys = []
        for base in (X.BYTE_BASE, X.SECOND_BASE):
            sums = np.zeros(len(text) + 1, np.uint64)
            np.cumsum(text * X.powers(base, len(text)), out=sums[1:])
            back = X.powers(X.inverse(base), len(text) + 1)
            one = (sums[mid] - sums[low]) * back[low]
            two = (sums[mid + after] - sums[mid]) * back[mid]
            keys.append(X.mix(X.mix(one + before.astype(np.uint64)) * X.WORD_BASE + two + e["key"][item]))
        order = np.lexsort((e["second"][item], keys[1], keys[0]))
        k0, k1, s, whole = keys[0][order], keys[1][order], e["second"][item][order], e["whole"][item][order]
        string = np.cumsum(~same_as_before(k0, k1, s)) - 1
        # Copies of one run are settled as a whole; only different runs tell a repeat.
        other = np.bincount(string, ~same_as_before(k0, k1, s, whole)) > 1
        bits = np.zeros(len(item), bool)
        bits[order] = other[string]
        total = np.add.reduceat(starts, np.cumsum([0, *sizes[:-1]])) if len(sizes) else np.zeros(0, np.int64)
        parts = np.split(bits, np.cumsum(total)[:-1])
        return answers(rows["bundle"].combine_chunks(), -2 - 2 * rows["shard"][0].as_py(), parts)

    return run


def bits_of(got: pa.Table, odd: bool) -> dict[int, bytes]:
    found = {}
    for shard, bits in zip(got["shard"].to_pylist(), got["cells"].to_pylist()):
        if shard < 0 and (-1 - shard) % 2 == odd:
            found[(-1 - shard) // 2] = bits
    return found


def sketch_rows(got: pa.Table) -> pa.Table:
    return got.filter(pa.array(np.array(got["shard"].to_pylist(), np.int64) >= 0))


def entry_bits(got: pa.Table, shard: np.ndarray) -> np.ndarray:
    """(entries, 2): repeats as a whole, has to be sorted."""
    found, out = bits_of(got, False), np.zeros((len(shard), 2), bool)
    for a, b in slices(shard):
        out[a:b] = np.unpackbits(np.frombuffer(found[int(shard[a])], np.uint8), count=2 * (b - a)).reshape(-1, 2)
    return out


def remove_strings(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rec, n_bytes, kept (bytes) and spans (start, length) of every row of ``docs``.

    A byte goes if a string of ``size`` bytes that covers it also starts at another
    place of any text, judged on the input. Strings never cross documents. Null
    and short texts keep all they have. Repeated rows repeat each other's strings. ``rec``
    holds the other columns; an empty table gives no rows.
    """
    stored, volume = X.bundled(docs, id_col, text_col, BUNDLE_BYTES)
    shards = max(1, -(-volume // SHARD_BYTES))
    base = stored.select("bundle", "id", "text").groupBy("bundle")

    def keys(rows: pa.Table):
        found = runs_of(rows, size).middles()
        return found, np.arange(len(found))

    replies, cells = X.repeated_cells(stored, keys, max(1, volume // 25))
    replies = materialize(replies, "repeated-middles")

    def send(rows: pa.Table, got: pa.Table) -> pa.Table:
        if not rows.num_rows or not got.num_rows:
            return sent(0, [])
        rows = X.in_order(rows)
        _, _, distinct, _, count, shard = runs_of(rows, size).entries(got, cells, shards)
        return sent(rows["bundle"][0].as_py(), [
            (int(shard[a]), distinct[a:b].tobytes(), count[a:b].astype("<u4").tobytes(), b"", b"") for a, b in slices(shard)
        ])

    buckets = base.cogroup(replies.groupBy("bundle")).applyInArrow(send, SENT)
    buckets = materialize(buckets.groupBy("shard").applyInArrow(settle_buckets, BITS), "bucket-answers")
    known = replies.unionByName(buckets)

    def send_context(rows: pa.Table, got: pa.Table) -> pa.Table:
        if not rows.num_rows or not got.num_rows:
            return sent(0, [])
        rows = X.in_order(rows)
        runs = runs_of(rows, size)
        _, _, distinct, run, _, shard = runs.entries(sketch_rows(got), cells, shards)
        use = np.flatnonzero(entry_bits(got, shard)[:, 1])
        low, high = runs.low[run[use]], runs.high[run[use]]
        start, stop = runs.start[run[use]], runs.stop[run[use]]
        shape = np.stack([stop - start, low - start, stop - 1 + size - high], axis=1).astype("<i4")
        data, out = runs.data.tobytes(), []
        for a, b in slices(shard[use]):
            parts = [data[s:m] + data[h:e] for s, m, h, e in zip(*(x[a:b].tolist() for x in (start, low, high, stop - 1 + size)))]
            out.append((int(shard[use][a]), distinct[use[a:b]].tobytes(), b"", shape[a:b].tobytes(), b"".join(parts)))
        return sent(rows["bundle"][0].as_py(), out)

    context = base.cogroup(known.groupBy("bundle")).applyInArrow(send_context, SENT)
    context = materialize(context.groupBy("shard").applyInArrow(sort_starts(size), BITS), "start-answers")
    everything = known.unionByName(context)

    def cut(rows: pa.Table, got: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({n: pa.array([], t) for n, t in names})
        rows = X.in_order(rows)
        runs = runs_of(rows, size)
        n = len(runs.data)
        gone = np.zeros(n + 1, np.int32)
        if got.num_rows:
            run, back, _, first, _, shard = runs.entries(sketch_rows(got), cells, shards)
            bits = entry_bits(got, shard)
            whole = run[bits[back, 0]]
            np.add.at(gone, runs.start[whole], 1)
            np.add.at(gone, runs.stop[whole] - 1 + size, -1)
            use = np.flatnonzero(bits[:, 1])
            found, per = bits_of(got, True), (runs.stop - runs.start)[first]
            for a, b in slices(shard[use]):
                own = use[a:b]
                flags = np.unpackbits(np.frombuffer(found[int(shard[own[0]])], np.uint8), count=int(per[own].sum()))
                place = np.full(len(per), -1)
                place[own] = np.cumsum(per[own]) - per[own]
                # Every run of an entry gets the bits of the entry.
                mine = np.flatnonzero(place[back] >= 0)
                length = per[back[mine]]
                row = np.repeat(mine, length)
                within = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
                hit = flags[place[back[row]] + within].astype(bool)
                at = runs.start[run[row[hit]]] + within[hit]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + size, -1)
        covered = np.cumsum(gone[:-1]) > 0
        edges = np.diff(covered.astype(np.int8), prepend=0, append=0)
        span_start, span_end = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
        text = np.searchsorted(runs.begin, span_start, side="right") - 1
        per_text = np.bincount(text, minlength=rows.num_rows)
        offsets = pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32))
        spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
            [pa.array(span_start - runs.begin[text]), pa.array(span_end - span_start)], ["start", "length"]
        ))
        kept = [runs.data[b:e][~covered[b:e]].tobytes() for b, e in zip(runs.begin.tolist(), runs.end.tolist())]
        return pa.table({
            "rec": rows["rec"].combine_chunks(), "n_bytes": pa.array(runs.end - runs.begin), "kept": pa.array(kept, pa.binary()),
            "spans": spans,
        })

    from pyspark.sql.pandas.types import to_arrow_type

    rec = stored.schema["rec"].dataType
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    names = [("rec", to_arrow_type(rec)), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", span)]
    schema = f"rec {rec.simpleString()}, n_bytes long, kept binary, spans array<struct<start: long, length: long>>"
    return stored.groupBy("bundle").cogroup(everything.groupBy("bundle")).applyInArrow(cut, schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_strings(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return found.select(
        F.col("rec.doc_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
