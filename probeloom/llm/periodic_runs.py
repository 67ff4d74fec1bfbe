"""Periodic runs of words inside a document, by an enhanced suffix array.

A run is a stretch of words with smallest period q and at least two periods that no
neighbouring word extends. Every run ends in exactly one branching square: words
i .. i+2d-1 with both halves equal and word i+d unlike word i+2d. Such a square shows
in the suffix array: suffixes i and i+d lie in the LCP interval of depth d, in
different children of it. So for each LCP interval all suffixes but those of its
largest child look up ISA[i+d] and ISA[i-d] and test whether the slot lies in the
interval. A suffix is in a smaller child at most log n times. Squares found are
rotated to the left as long as the words agree, which gives the run; a square whose
end and start lie in a run of shorter period is not primitive and dropped.

No tree is built: intervals are slots of the LCP array. Many texts share one suffix
array (each with word numbers of its own and a closing mark, so nothing matches across
texts). Rows are worked on where they lie; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.llm.common import table
from probeloom.session import spread

MIN_LENGTH = 12
# Words of one suffix array (a longer text has one of its own).
CHUNK_WORDS = 1 << 17
WHITE = r"[\x20\x09-\x0D]+"

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


# --- enhanced suffix array -------------------------------------------------------


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse and the LCP of each slot with the one before.

    Prefix doubling that sorts only what is still tied. The ranks of all rounds are
    kept; two neighbours that part in the round of width h share h words and what the
    ranks of the narrower rounds, taken from wide to narrow, agree in.
    """
    n = len(t)
    sa = np.argsort(t, kind="stable")
    ordered = t[sa]
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    slot = np.arange(n)
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(fresh, slot, 0))
    levels, lcp, h = [rank], np.zeros(n, np.int64), 1
    tied = slot[~(fresh & np.append(fresh[1:], True))]
    while len(tied):
        u = sa[tied]
        key = rank[u].astype(np.int64) * (n + 1) + rank[u + h]
        order = np.argsort(key, kind="stable")
        u, key = u[order], key[order]
        sa[tied] = u
        fresh = np.ones(len(u), bool)
        fresh[1:] = key[1:] != key[:-1]
        old = rank[u]
        parted = np.flatnonzero(fresh[1:] & (old[1:] == old[:-1])) + 1
        a, b, shared = u[parted - 1], u[parted], np.full(len(parted), h, np.int64)
        for k in range(len(levels) - 2, -1, -1):
            shared += np.where(levels[k][a + shared] == levels[k][b + shared], 1 << k, 0)
        lcp[tied[parted]] = shared
        rank = rank.copy()
        rank[u] = np.maximum.accumulate(np.where(fresh, tied, 0))
        levels.append(rank)
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return sa, rank, lcp


def lcp_intervals(lcp: list[int], base: int) -> list[tuple[int, int, int, int, int]]:
    """(depth, first slot, last slot, first and last slot of the largest child) of every interval."""
    out: list[tuple[int, int, int, int, int]] = []
    stack = [[0, 0, 0, -1]]
    for k in range(1, len(lcp) + 1):
        depth = lcp[k] if k < len(lcp) else 0
        left, child = k - 1, (0, -1)
        while stack[-1][0] > depth:
            d, left, first, last = stack.pop()
            out.append((d, base + left, base + k - 1, base + first, base + last))
            child = (left, k - 1)
            above = stack[-1]
            if above[0] >= depth and child[1] - child[0] > above[3] - above[2]:
                above[2:] = child
        if stack[-1][0] < depth:
            stack.append([depth, left, *child])
    return out


def branching_squares(t: np.ndarray, sa: np.ndarray, isa: np.ndarray, intervals: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of all squares t[i:i+d] == t[i+d:i+2d] with t[i+d] != t[i+2d]."""
    depth, left, right, first, last = (np.array(x, np.int64) for x in zip(*intervals))
    # Slots of an interval before and after its largest child.
    begins, sizes = np.concatenate([left, last + 1]), np.concatenate([first - left, right - last])
    none = last < first
    begins[:len(left)][none], sizes[:len(left)][none] = left[none], (right - left + 1)[none]
    sizes[len(left):][none] = 0
    own = np.tile(np.arange(len(left)), 2)
    at = np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    own = np.repeat(own, sizes)
    i, d, lo, hi = sa[at], depth[own], left[own], right[own]
    ahead = isa[i + d]
    ahead = (lo <= ahead) & (ahead <= hi)
    behind = isa[np.maximum(i - d, 0)]
    behind = (lo <= behind) & (behind <= hi) & (i >= d)
    start = np.concatenate([i[ahead], i[behind] - d[behind]])
    half = np.concatenate([d[ahead], d[behind]])
    apart = t[start + half] != t[start + 2 * half]
    return start[apart], half[apart]


def rotated(t: np.ndarray, i: int, d: int) -> int:
    """Least s such that all words from s to i equal those d further on."""
    step = 16
    while i:
        low = max(0, i - step)
        unlike = np.flatnonzero(t[low:i] != t[low + d:i + d])
        if len(unlike):
            return low + int(unlike[-1]) + 1
        i, step = low, 2 * step
    return 0


def find_runs(t: np.ndarray, offsets: np.ndarray, min_length: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of the texts that begin at ``offsets`` of ``t``.

    ``t`` numbers words so that those of later texts are larger, and every text ends
    with a number of its own. A run of ``min_length`` words shares half of them with
    itself one period on, so texts without so long a repeat are passed by.
    """
    sa, isa, lcp = suffix_array(t)
    ends = np.append(offsets[1:], len(t))
    intervals: list[tuple] = []
    for k in np.flatnonzero(np.maximum.reduceat(lcp, offsets) >= max(1, (min_length + 1) // 2)):
        intervals += lcp_intervals(lcp[offsets[k]:ends[k]].tolist(), int(offsets[k]))
    if not intervals:
        return []
    start, half = branching_squares(t, sa, isa, intervals)
    turns = (start > 0) & (t[start - 1] == t[start - 1 + half])
    useful = turns | (2 * half >= min_length)
    start, half, turns = start[useful], half[useful], turns[useful]
    order = np.lexsort((half, start + 2 * half))
    runs: list[tuple[int, int, int]] = []
    end = least = -1
    for i, d, turn in zip(start[order].tolist(), half[order].tolist(), turns[order].tolist()):
        if i + 2 * d != end:
            end, least = i + 2 * d, i + 1
        if i >= least:
            continue  # inside a run of shorter period with this end, or found before
        least = rotated(t, i, d) if turn else i
        if end - least >= min_length:
            runs.append((least, end, d))
    return sorted(runs, key=lambda r: (r[0], r[2]))


# --- rows ------------------------------------------------------------------------


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each text closed by a number of its own, and where texts begin."""
    parts, base, offsets, at = [], 0, [], 0
    for words in texts:
        known = {w: i for i, w in enumerate(dict.fromkeys(words), base)}
        own = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        base += len(known)
        parts += [own, np.array([base])]
        base += 1
        offsets.append(at)
        at += len(words) + 1
    return np.concatenate(parts), np.array(offsets, np.int64)


def described(ids: pa.Array, raw: list[bytes | None], min_length: int) -> pa.RecordBatch:
    texts = [(r or b"").split() for r in raw]
    t, offsets = numbered(texts)
    runs = find_runs(t, offsets, min_length)
    owner = np.searchsorted(offsets, [r[0] for r in runs], side="right") - 1
    per_text = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    begins = offsets[owner] if len(runs) else np.zeros(0, np.int64)
    s, e, p = (np.array([r[k] for r in runs], np.int64) for k in range(3))
    listed = pa.StructArray.from_arrays([pa.array(s - begins), pa.array(e - s), pa.array(p)], fields=list(RUN))
    change = np.zeros(len(t) + 1, np.int64)
    np.add.at(change, s + p, 1)
    np.add.at(change, e, -1)
    kept = np.cumsum(change)[:-1] == 0
    collapsed = []
    for k, words in enumerate(texts):
        if per_text[k]:
            own = kept[offsets[k]:offsets[k] + len(words)]
            words = [words[j] for j in np.flatnonzero(own)]
        collapsed.append(b" ".join(words))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([len(w) for w in texts], pa.int64()),
         pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)), listed),
         pa.array(collapsed, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start and period), collapsed.

    ``collapsed`` is the text, its words joined by one space, without the words that
    some run holds after its first period. Every row is judged by itself: repeated rows
    give equal rows, null and empty texts no words and no runs. A text of any
    length is held whole, with some 8 bytes per word and doubling round (log2 of
    its longest repeat), since a run can span all of it. Other columns are ignored.
    """
    if min_length < 2:
        raise ValueError("A run has two words at least")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            at = 0
            while at < len(raw):
                end, size = at, 0
                while end < len(raw) and (end == at or size < 6 * CHUNK_WORDS):
                    size += len(raw[end] or b"")
                    end += 1
                yield described(batch.column(0).slice(at, end - at), raw[at:end], min_length)
                at = end

    plain = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(
        rows, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


# --- the query -------------------------------------------------------------------


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents, in about every tenth of which the words from some place on repeat a cycle.

    h = crc32(doc_id), g = floor(h / 10). Where h % 10 = 0, word i >= a becomes word
    a + (i - a) % p with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Null ids stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), WHITE), "")
    marked = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycle = F.slice("w", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")
    return marked.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents", "doc_id", "text")))
    # The longest run, ties to the smaller start and then period.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.floor(F.lit(1000) * -F.col("best.l") / F.col("best.p")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
