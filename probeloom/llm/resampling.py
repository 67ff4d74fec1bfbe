"""Importance resampling of documents towards a target distribution.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters above ASCII.
Features are all runs of one to three consecutive words, joined by one space, and a
feature's bucket is the CRC-32 of its bytes modulo ``buckets``.

No feature string is built. A text, its separators normalised to one space, is
scanned once and the running CRC kept at each word end. With A the bytes before a
feature and B the feature, crc(AB) = shift(crc(A), |B|) xor crc(B), where ``shift``
multiplies by x^(8|B|) over GF(2); so two prefixes give the CRC of any n-gram. The
shift is linear and looked up by byte, in tables per length.

Bucket counts are summed inside each task before the shuffle, and only ``buckets``
rows of counts reach the driver. The texts are read twice (counts, then weights)
and never shuffled. The draw is an exact global order by Gumbel-perturbed weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeloom.llm.common import table
from probeloom.operators.ranking import rank_rows
from probeloom.session import bounded_rows, materialize, spread

BUCKETS = 10_000
LONGEST = 3          # words of a feature
MIN_WORDS = 20       # documents with fewer are never drawn
PERCENT = 5
SEED = 42

# Words whose prefixes are held at once (a longer text is held whole).
CHUNK_WORDS = 1 << 18
POLYNOMIAL = 0xEDB88320
U32 = np.uint32

# Bytes as they are read: A-Z become a-z, separators a space, bytes above ASCII stay.
NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


# --- CRCs of substrings ----------------------------------------------------------


@cache
def byte_steps() -> np.ndarray:
    """Register after one zero byte, by its low byte."""
    t = np.arange(256, dtype=U32)
    for _ in range(8):
        t = np.where(t & U32(1), (t >> U32(1)) ^ U32(POLYNOMIAL), t >> U32(1)).astype(U32)
    return t


def zero_byte(v: np.ndarray) -> np.ndarray:
    return byte_steps()[v & U32(255)] ^ (v >> U32(8))


@cache
def short_shifts() -> np.ndarray:
    """[length, place of the byte, byte] for lengths below 256, flat."""
    now = np.concatenate([np.arange(256, dtype=U32) << U32(8 * j) for j in range(4)])
    out = np.empty((256, 1024), U32)
    for length in range(256):
        out[length] = now
        now = zero_byte(now)
    return out.ravel()


@cache
def long_shift(bit: int) -> np.ndarray:
    """[place of the byte, byte] for the length 2^bit (8 or more), flat."""
    half = short_shifts()[128 * 1024:129 * 1024] if bit == 8 else long_shift(bit - 1)
    return look_up(half, look_up(half, np.concatenate([np.arange(256, dtype=U32) << U32(8 * j) for j in range(4)]), 0), 0)


def look_up(tables: np.ndarray, v: np.ndarray, at) -> np.ndarray:
    out = tables[at + (v & U32(255)).astype(np.int64)]
    for j in (1, 2, 3):
        out ^= tables[at + ((v >> U32(8 * j)) & U32(255)).astype(np.int64) + 256 * j]
    return out


def shift(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC registers carried over as many zero bytes."""
    out = look_up(short_shifts(), crcs, (lengths & 255) * 1024)
    most = int(lengths.max(initial=0))
    for bit in range(8, most.bit_length()):
        on = np.flatnonzero((lengths >> bit) & 1)
        out[on] = look_up(long_shift(bit), out[on], 0)
    return out


class Prefixes:
    """Running CRCs at the word ends of some texts, read one after the other."""

    def __init__(self, texts: list[bytes | None]):
        words = [(t or b"").translate(NORMAL).split() for t in texts]
        self.count = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.count) - self.count
        pieces = [b" " + w for ws in words for w in ws]
        n = len(pieces)
        self.end_crc = np.fromiter(accumulate(pieces, lambda c, w: crc32(w, c), initial=0), U32, n + 1)
        size = np.fromiter(map(len, pieces), np.int64, n)
        self.end = np.cumsum(size)
        self.start = self.end - size + 1
        inverted = self.end_crc[:-1] ^ U32(0xFFFFFFFF)
        self.start_crc = zero_byte(inverted ^ U32(0x20)) ^ U32(0xFFFFFFFF)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of ``n`` words inside one text, and the CRCs of these runs."""
        runs = np.maximum(self.count - n + 1, 0)
        total = int(runs.sum())
        at = np.arange(total) + np.repeat(self.first - (np.cumsum(runs) - runs), runs)
        length = self.end[at + n - 1] - self.start[at]
        return at, self.end_crc[at + n] ^ shift(self.start_crc[at], length)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Prefixes]]:
    """Ids and prefixes of the rows (id, text), some CHUNK_WORDS words at a time."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < 6 * CHUNK_WORDS):
                size += len(texts[end] or b"")
                end += 1
            yield batch.column(0).slice(at, end - at), Prefixes(texts[at:end])
            at = end


# --- the operator ----------------------------------------------------------------


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features in each bucket over all texts; a task sends one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, found in chunks(batches):
            for n in range(1, longest + 1):
                total += np.bincount(found.ngrams(n)[1] % U32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    rows = spread(texts.select(F.lit(0).alias("id"), F.col(text_col).alias("text")))
    summed = rows.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in bounded_rows(summed, buckets, "buckets"):
        out[r["bucket"]] = r["n"]
    return out


def gains(spark: SparkSession, corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each bucket."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    rows = spark.createDataFrame([(i, float(s), float(t)) for i, (s, t) in enumerate(zip(corpus.tolist(), target.tolist()))], "i int, s double, t double")
    ratio = (F.col("t") + 1) * F.lit(float(s_all + b)) / ((F.col("s") + 1) * F.lit(float(t_all + b)))
    out = np.zeros(b, np.int64)
    for r in rows.select("i", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect():
        out[r["i"]] = r["gain"]
    return out


def noise(doc_id, seed: int):
    """Gumbel noise of a document in thousandths, from its id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
               buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of ``docs``.

    The weight sums the bucket gains of all features of the whole text; the score
    adds Gumbel noise. Null and empty texts have no features and weight 0; null ids
    share one noise. Rows that repeat an id are scored each by its own text. A text of
    any length is held whole by its task, with some 100 bytes per word. Empty
    tables are fine on either side; other columns are ignored.
    """
    spark = docs.sparkSession
    gain = gains(spark, bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in chunks(batches):
            weight, features = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for n in range(1, longest + 1):
                runs = np.maximum(found.count - n + 1, 0)
                upto = np.concatenate([[0], np.cumsum(gain[found.ngrams(n)[1] % U32(buckets)])])
                end = np.cumsum(runs)
                weight += upto[end] - upto[end - runs]
                features += runs
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(found.count), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    return scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` plus rank: 1, 2, ... for the drawn rows, null for the rest.

    Of the N rows with ``min_words`` words or more, floor(percent N / 100) are drawn,
    highest score first, ties to the smaller id (null ids first). The order is one
    range-partitioned sort, so no task sees more than its share.
    """
    stored = materialize(scored, "scored")
    able = stored.filter(F.col("n_words") >= min_words)
    wanted = percent * able.count() // 100
    ranked = rank_rows(able, [F.col("score").desc(), F.col("doc_id").asc(), F.col("weight").desc(), F.col("n_words").asc()], "rank", start=1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.unionByName(stored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
             min_words: int = MIN_WORDS, **settings) -> DataFrame:
    """The drawn rows of ``docs``, all columns unchanged.

    ``id_col`` names rows: where it repeats, a row stays if any row of its id is drawn.
    """
    drawn = draw(importance(docs, target, id_col, text_col, **settings), percent, min_words).filter("rank IS NOT NULL")
    return docs.join(drawn.select(F.col("doc_id").alias("_drawn")).distinct(), F.col(id_col).eqNullSafe(F.col("_drawn")), "left_semi")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text")
    return draw(importance(docs, target)).select(
        "doc_id", "n_features", "weight", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))
