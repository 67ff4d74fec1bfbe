"""Bundled documents and counts of keys over all bundles.

Documents are stored once in bundles of a bounded size, bucketed by bundle, so
that passes over the texts and joins of per-bundle answers with the texts need no
further shuffle of text. Counting keys (windows, shingles, anchors) over the corpus
goes through a count-min sketch whose width grows with the corpus: each bundle
sends its cells, as sorted gaps, to the tasks that hold their part of the sketch;
these merge all bundles and send back only the cells that are counted twice or
more. Nothing of the sketch is broadcast or held whole anywhere.

One wide row per sketch is used: cells travel as gaps, whose size grows with the
logarithm of the width, while every further row would double what is sent.
"""

from __future__ import annotations

import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.session import new_folder

BUNDLE_BYTES = 8 * 1024 * 1024
# Cells of the sketch per key, and keys that one task merges on average.
SPARSE = 32
SHARD_KEYS = 1_000_000

REPLY = "bundle int, shard int, cells binary, counts binary"
U64 = np.uint64


# --- storing -------------------------------------------------------------------


def bundled(docs: DataFrame, id_col: str, text_col: str, bundle_bytes: int = BUNDLE_BYTES) -> tuple[DataFrame, int]:
    """Stored rows (bundle, id, text, rec) and the bytes of all texts.

    ``rec`` holds the columns of ``docs`` as they are. Rows of one id share a
    bundle; rows without an id are spread by their text.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-size // bundle_bytes))
    # A bucket may hold several bundles, which are then sorted apart inside its task.
    buckets = min(n, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    key = F.coalesce(F.xxhash64(F.when(F.col(id_col).isNotNull(), F.col(id_col))), F.lit(0))
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(key)
    rows = docs.select(
        F.pmod(key, F.lit(n)).cast("int").alias("bundle"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(True).alias("_row")).alias("rec"),
        F.col(text_col).isNull().alias("none"),
    )
    name = f"bundles_{uuid.uuid4().hex}"
    rows.repartition(buckets, "bundle").write.bucketBy(buckets, "bundle").option("path", new_folder(spark, "bundles")).option(
        "compression", "zstd"
    ).saveAsTable(name)
    return spark.table(name), size


def in_order(rows: pa.Table) -> pa.Table:
    """Rows of a bundle in an order that does not depend on how they were read."""
    ids, texts = rows["id"].to_pylist(), rows["text"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return rows.take(pa.array(order, pa.int64()))


# --- cells as gaps -------------------------------------------------------------


def pack(cells: np.ndarray) -> bytes:
    """Strictly increasing cells as 16-bit gaps; 65535 stands for 65535 more to come."""
    if not len(cells):
        return b""
    gaps = np.diff(cells, prepend=U64(0)).astype(U64)
    over = (gaps // U64(65535)).astype(np.int64)
    out = np.full(int(over.sum()) + len(gaps), 65535, np.uint16)
    out[np.cumsum(over + 1) - 1] = (gaps % U64(65535)).astype(np.uint16)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint16)
    return np.cumsum(steps, dtype=U64)[steps != 65535]


def pack_counts(counts: np.ndarray) -> bytes:
    """A bit per cell, then the counts above one."""
    more = counts > 1
    return np.packbits(more).tobytes() + counts[more].astype("<u4").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    bits = -(-n // 8)
    more = np.unpackbits(np.frombuffer(data[:bits], np.uint8), count=n).astype(bool)
    counts = np.ones(n, np.uint32)
    counts[more] = np.frombuffer(data[bits:], "<u4")
    return counts


# --- counting ------------------------------------------------------------------


def width_for(keys: int) -> tuple[int, int]:
    """Cells of the sketch (a power of two) and cells that one task merges."""
    cells = 1 << max(16, (SPARSE * max(1, keys) - 1).bit_length())
    return cells, min(cells, SPARSE * SHARD_KEYS)


def cell_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    return hashes >> U64(64 - (cells.bit_length() - 1))


def distinct_pairs(cells: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells, ascending, and the number of different owners of each."""
    if not len(cells):
        return cells, np.zeros(0, np.uint32)
    order = np.argsort(cells, kind="stable")
    c, o = cells[order], owners[order]
    fresh = np.empty(len(c), bool)
    fresh[0] = True
    np.not_equal(c[1:], c[:-1], out=fresh[1:])
    starts = np.flatnonzero(fresh)
    fresh[1:] |= o[1:] != o[:-1]
    return c[starts], np.add.reduceat(fresh, starts, dtype=np.uint32)


def repeated_cells(stored: DataFrame, hashes, keys: int) -> tuple[DataFrame, int]:
    """Cells counted twice or more, for each bundle that holds them, and the width.

    ``hashes(rows)`` gives the 64-bit keys of a bundle and the number of the
    document that each belongs to, ascending; a document counts once per cell.
    """
    cells, per_shard = width_for(keys)

    def send(rows: pa.Table) -> pa.Table:
        found, owners = hashes(in_order(rows))
        own, counts = distinct_pairs(cell_of(found, cells), owners)
        shards = (own // U64(per_shard)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(shards, prepend=-1))
        ends = [*cuts[1:], len(own)]
        bundle = rows["bundle"][0].as_py()
        return pa.table({
            "bundle": pa.array([bundle] * len(cuts), pa.int32()), "shard": pa.array(shards[cuts].astype(np.int32)),
            "cells": pa.array([pack(own[a:b] - U64(shards[a] * per_shard)) for a, b in zip(cuts, ends)], pa.binary()),
            "counts": pa.array([pack_counts(counts[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
        })

    def merge(rows: pa.Table) -> pa.Table:
        shard, bundles = rows["shard"][0].as_py(), rows["bundle"].to_pylist()
        sent = [unpack(x) for x in rows["cells"].to_pylist()]
        counts = [unpack_counts(x, len(s)) for x, s in zip(rows["counts"].to_pylist(), sent)]
        every, place = np.unique(np.concatenate(sent), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts).astype(float)).astype(np.uint32)
        out, at = [], 0
        for bundle, own in zip(bundles, sent):
            n = total[place[at:at + len(own)]]
            at += len(own)
            more = n > 1
            if more.any():
                out.append((bundle, own[more], n[more]))
        return pa.table({
            "bundle": pa.array([x[0] for x in out], pa.int32()), "shard": pa.array([shard] * len(out), pa.int32()),
            "cells": pa.array([pack(x[1]) for x in out], pa.binary()),
            "counts": pa.array([pack_counts(x[2]) for x in out], pa.binary()),
        })

    sent = stored.select("bundle", "id", "text").groupBy("bundle").applyInArrow(send, REPLY)
    return sent.groupBy("shard").applyInArrow(merge, REPLY), cells


def heavy(replies: pa.Table, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cells and counts of the replies to one bundle."""
    per_shard = min(cells, SPARSE * SHARD_KEYS)
    found = sorted(zip(replies["shard"].to_pylist(), replies["cells"].to_pylist(), replies["counts"].to_pylist()))
    own = [unpack(c) + U64(s * per_shard) for s, c, _ in found]
    counts = [unpack_counts(n, len(o)) for (_, _, n), o in zip(found, own)]
    if not own:
        return np.zeros(0, U64), np.zeros(0, np.uint32)
    return np.concatenate(own), np.concatenate(counts)


def counts_of(own: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Count of each cell of ``own``: one where the ascending ``cells`` do not list it."""
    if not len(cells):
        return np.ones(len(own), np.uint32)
    at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
    return np.where(cells[at] == own, counts[at], 1).astype(np.uint32)


# --- words ---------------------------------------------------------------------

BYTE_BASE, WORD_BASE, SECOND_BASE = U64(0x9E3779B97F4A7C15 | 1), U64(0xD6E8FEB86659FD93 | 1), U64(0xA0761D6478BD642F | 1)
POWERS: dict[int, np.ndarray] = {}


def powers(base: U64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept by the worker."""
    known = POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, U64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        POWERS[int(base)] = known
    return known[:n]


def inverse(base: U64) -> U64:
    return U64(pow(int(base), -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ U64(seed)
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(29))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(32))


def range_hashes(values: np.ndarray, base: U64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2^64 of values[start:end], the same wherever the range lies."""
    n = len(values)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(inverse(base), n + 1)[starts]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


# Words of up to this many bytes fit, with their length, into 64 bits.
SHORT = 7
SECOND_SEED = 0x5851F42D4C957F2D


# Long words whose digests a worker remembers when the next bundle comes.
REMEMBERED = 300_000


class Digests(dict):
    """128 bits of BLAKE2b by word, found when first met."""

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = blake2b(word, digest_size=16).digest()
        return found


DIGESTS = Digests()


def word_codes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each word, the same wherever it stands.

    Those of a word of up to SHORT bytes are bijections of its bytes and length, so no two
    such words share one. A longer word has 128 bits of BLAKE2b.
    """
    length = ends - starts
    # The eight bytes from every byte on, of which a word keeps its own.
    eight = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,))
    kept = np.minimum(length, SHORT).astype(U64)
    value = eight[starts] & ((U64(1) << (kept * U64(8))) - U64(1))
    value |= np.minimum(length, SHORT + 1).astype(U64) << U64(8 * SHORT)
    codes = np.stack([mix(value), mix(value, SECOND_SEED)], axis=1)
    long = np.flatnonzero(length > SHORT)
    if len(DIGESTS) > REMEMBERED:
        DIGESTS.clear()
    digests = b"".join([DIGESTS[data[s:e]] for s, e in zip(starts[long].tolist(), ends[long].tolist())])
    codes[long] = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return codes


# Arithmetic modulo a Mersenne prime. Values in between may exceed it by a few.
PRIME = (1 << 61) - 1
# Words taken at a time, so that the values stay in the cache.
PIECE = 1 << 15


def folded(x: np.ndarray) -> np.ndarray:
    return (x & U64(PRIME)) + (x >> U64(61))


def times(x: np.ndarray, by: int) -> np.ndarray:
    """x * by modulo PRIME."""
    high, low, by_high, by_low = x >> U64(32), x & U64(0xFFFFFFFF), U64(by >> 32), U64(by & 0xFFFFFFFF)
    middle, last = high * by_low + low * by_high, low * by_low
    # 2^64 is 8 and 2^61 is 1 modulo PRIME.
    return folded(
        (high * by_high << U64(3)) + (middle >> U64(29)) + ((middle & U64((1 << 29) - 1)) << U64(32)) + folded(last)
    )


def spelled(codes: np.ndarray, size: int, point: int) -> np.ndarray:
    """For each place, the polynomial whose coefficients are the codes of ``size`` words from there on.

    A word gives three coefficients of 60, 60 and 8 bits. Two different sequences agree at
    fewer than 3 * size of the PRIME points, so a point drawn after the texts are written
    parts them but for a chance below 3 * size / PRIME.
    """
    first, second = codes[:, 0], codes[:, 1]
    run = folded(times(first >> U64(4), point) + ((first & U64(15)) << U64(56) | second >> U64(8)))
    run, span, step = folded(times(run, point) + (second & U64(255))), 1, pow(point, 3, PRIME)
    out, length = None, 0
    while True:
        if size & 1:
            tail = run[length:]
            out = run if out is None else folded(times(out[:len(tail)], pow(step, span, PRIME)) + tail)
            length += span
        size >>= 1
        if not size:
            break
        run, span = folded(times(run[:-span], pow(step, span, PRIME)) + run[span:]), 2 * span
    out = folded(out)
    return np.where(out >= U64(PRIME), out - U64(PRIME), out)


class Words:
    """Words of the texts of a bundle: bounds in ``data``, the number of the text, and codes (``word_codes``)."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(raw) + b"\n"
        a = np.frombuffer(self.data, np.uint8)
        solid = np.zeros(len(a) + 1, bool)
        np.logical_not(SPACE[a], out=solid[1:])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
        bounds = np.searchsorted(self.starts, self.begins[:len(texts) + 1])
        self.count, self.first = np.diff(bounds).astype(np.int64), bounds[:-1].astype(np.int64)
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.codes = word_codes(self.data, self.starts, self.ends)
        self.hash = np.ascontiguousarray(self.codes[:, 0])

    def windows(self, size: int) -> np.ndarray:
        """Numbers of the words at which ``size`` words of one text start."""
        n = len(self.text)
        if n < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.text[:n - size + 1] == self.text[size - 1:])

    def window_hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        """Cheap keys for the sketch; different windows may share one."""
        return mix(range_hashes(self.hash, WORD_BASE, at, at + size))

    def window_digests(self, at: np.ndarray, size: int, points: tuple[int, ...]) -> np.ndarray:
        """A number below PRIME per window and point: the polynomial that the codes of its words spell, there."""
        found = np.zeros((len(at), len(points)), U64)
        for a in range(0, len(self.text) - size + 1, PIECE):
            i, j = np.searchsorted(at, [a, a + PIECE])
            if i < j:
                codes = self.codes[a:a + PIECE + size - 1]
                for k, point in enumerate(points):
                    found[i:j, k] = spelled(codes, size, point)[at[i:j] - a]
        return found
