"""Exact ranks, cuts and quantiles that never put a whole group in one task."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeloom.session import bounded_rows, materialize, settle

# A hash bucket is ranked inside one task; buckets are sized to hold at most
# about this many rows even when one label owns every row.
ROWS_PER_BUCKET = 1_000_000
# Bits of a value that one scan of a radix selection counts.
DIGIT_BITS = 16


def rank_rows(df: DataFrame, order: Sequence[Column | str], out: str, start: int = 0) -> DataFrame:
    """Number all rows by a total order, without a single-partition window.

    One range-partitioned sort; the local position inside each sorted partition
    comes from ``monotonically_increasing_id`` and the partition sizes (one row
    per partition) give the offsets. The sorted copy is written out first, so
    positions and offsets describe the same layout. ``order`` has to be unique
    for the numbers to be reproducible and for a hot value to be splittable.
    """
    tagged = materialize(
        df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked"
    ).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(
        tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.join(offsets, "_part").select(
        *df.columns, (F.col("_offset") + local + F.lit(start)).alias(out)
    )


def bucket_digits(n_rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Leading hex digits of a uniform key that keep every bucket small."""
    return min(8, max(1, math.ceil(math.log(max(n_rows, 1) / per_bucket, 16))))


def cut_keys(
    keyed: DataFrame,
    cuts: DataFrame,
    n_rows: int,
    per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Order keys standing at given ranks inside each label.

    ``keyed``: label, order_key (uniform hex text), entity_id.
    ``cuts``: label, cut (position in the cut list), rank (1-based); small.
    Returns label, cut, cut_key, cut_id.

    Counting rows per (label, key prefix) finds the prefix bucket that holds
    each rank; only rows of those buckets are ranked. A label with a third of
    all rows therefore never meets in one task.
    """
    digits = bucket_digits(n_rows, per_bucket)
    bucketed = keyed.withColumn("bucket", F.substring("order_key", 1, digits))
    upto = Window.partitionBy("label").orderBy("bucket")
    sizes = (
        bucketed.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("last", F.sum("n").over(upto))
        .withColumn("first", F.col("last") - F.col("n"))
    )
    holders = settle(
        sizes.join(cuts, "label")
        .filter((F.col("first") < F.col("rank")) & (F.col("rank") <= F.col("last")))
        .select("label", "cut", "rank", "bucket", "first")
    )
    # ``settle`` has marked the holders for broadcast where they are few.
    wanted = settle(holders.select("label", "bucket", "first").distinct())
    inside = Window.partitionBy("label", "bucket").orderBy("order_key", "entity_id")
    ranked = bucketed.join(wanted, ["label", "bucket"]).withColumn(
        "rank", F.col("first") + F.row_number().over(inside)
    )
    return ranked.join(settle(holders.select("label", "cut", "rank")), ["label", "rank"]).select(
        "label", "cut", F.col("order_key").alias("cut_key"), F.col("entity_id").alias("cut_id")
    )


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; NaN comes last."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)              # one NaN, and no negative zero
    bits = x.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def double_of(bits: int) -> float:
    bits = bits & ~(1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def values_at(df: DataFrame, value: str, ranks: Sequence[int]) -> list[float]:
    """The values at some 0-based ranks of a column, by radix selection.

    Four scans, whatever the size: each counts the next sixteen bits of the values
    that share the bits found so far, at most 65,536 counts per wanted rank. Nothing
    is sorted or moved, and repeated values are no special case.
    """
    values = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    found, left = [0] * len(ranks), list(ranks)
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        prefixes = sorted(set(found))

        def count(batches: Iterator[pa.RecordBatch], prefixes=prefixes, shift=shift) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(prefixes), 1 << DIGIT_BITS), np.int64)
            for batch in batches:
                bits = ordered_bits(batch.column(0).to_numpy(zero_copy_only=False))
                for i, prefix in enumerate(prefixes):
                    own = bits if shift == 64 - DIGIT_BITS else bits[bits >> np.uint64(shift + DIGIT_BITS) == np.uint64(prefix)]
                    digits = (own >> np.uint64(shift)) & np.uint64((1 << DIGIT_BITS) - 1)
                    total[i] += np.bincount(digits.astype(np.int64), minlength=1 << DIGIT_BITS)
            which, digit = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(which.astype(np.int32)), pa.array(digit.astype(np.int32)), pa.array(total[which, digit])], names=["which", "digit", "n"])

        counted = values.mapInArrow(count, "which int, digit int, n long").groupBy("which", "digit").agg(F.sum("n").alias("n"))
        rows = bounded_rows(counted, len(prefixes) << DIGIT_BITS, "counts of digits")
        table = np.zeros((len(prefixes), 1 << DIGIT_BITS), np.int64)
        for r in rows:
            table[r["which"], r["digit"]] = r["n"]
        for i, prefix in enumerate(found):
            upto = np.cumsum(table[prefixes.index(prefix)])
            digit = int(np.searchsorted(upto, left[i], side="right"))
            left[i] -= int(upto[digit - 1]) if digit else 0
            found[i] = prefix << DIGIT_BITS | digit
    return [double_of(b) for b in found]


def exact_quantile(df: DataFrame, value: str, q: float) -> float | None:
    """Linearly interpolated quantile of a whole column; NULLs do not count, NaN is the largest value.

    Scans ``df`` five times, so pass a stored table or a cheap column.
    """
    n = df.filter(F.col(value).isNotNull()).count()
    if n == 0:
        return None
    h = (n - 1) * q
    low, high = values_at(df, value, [math.floor(h), math.ceil(h)])
    return low if low == high else low + (high - low) * (h - math.floor(h))
