"""Scalar column functions and small parameter-grid expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SPLITS = ("train", "validation", "test")
SPLIT_PERCENTS = (70, 15, 15)
SPLIT_SYNONYMS = {"val": "validation", "valid": "validation"}
MINIMUM_LABEL_ROWS = 30
TARGET_SUM = 10_000.0
VARIANCE_FLOOR = 1e-12
ACTIVE_THRESHOLD = 1e-6
COARSE_C = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
FINE_POINTS = 21
LAMBDAS = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1)


def log_rate(count: Column, size: Column, target: float = TARGET_SUM) -> Column:
    """log(1 + target * count / library size)."""
    return F.log1p(count * F.lit(float(target)) / size)



def safe_scale(variance: Column, floor: float = VARIANCE_FLOOR) -> Column:
    """Square root of a variance; 1 where it is (nearly) constant."""
    root = F.sqrt(F.greatest(variance, F.lit(0.0)))
    return F.when(root < floor, F.lit(1.0)).otherwise(root)



def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def is_blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def clean_split(name: Column) -> Column:
    """Trim, lower and map the short names of the validation split."""
    text = F.lower(F.trim(name))
    out = text
    for short, full in SPLIT_SYNONYMS.items():
        out = F.when(text == short, F.lit(full)).otherwise(out)
    return out


def inverse_strength(n: Column, lam: Column) -> Column:
    """C for a mean-loss penalty lambda: 1 / (n * lambda)."""
    return F.lit(1.0) / (n * lam)


def fine_grid(center: Column, tested: Sequence[float] = COARSE_C, points: int = FINE_POINTS) -> Column:
    """Log-spaced values from center/10 to 10*center that were not tried before."""
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: center / 10.0 * F.pow(F.lit(100.0), i / F.lit(float(points - 1))),
    )
    known = F.array(*[F.lit(float(c)) for c in tested])
    return F.filter(
        grid, lambda c: ~F.exists(known, lambda k: F.abs(F.log(c) - F.log(k)) <= 1e-10)
    )


def candidate_key(atoms: Column, alpha: Column, seed: Column, epochs: Column) -> Column:
    return F.concat(
        F.lit("k"), atoms.cast("string"), F.lit("_a"), alpha.cast("string"),
        F.lit("_s"), seed.cast("string"), F.lit("_e"), epochs.cast("string"),
    )


def percent_text(ratio: Column, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f", ratio * 100.0)


def fixed_text(value: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", value)


def order_key(seed: int, *ids: Column) -> Column:
    """Seeded pseudo-random text key; independent of input order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *ids))


def text_of(raw: Column) -> Column:
    """UTF-8 bytes as text, text as it is; malformed bytes are NULL."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


def merged_object(a: Column, b: Column) -> Column:
    """Two JSON objects (text) as one, its keys in order; where both have a key, ``b`` decides.

    Values go through VARIANT, so numbers, texts and nested values keep their kind and two
    objects are equal exactly if their merged texts are. A NULL object adds nothing.
    """
    def entries(o: Column) -> Column:
        found = F.map_entries(F.try_variant_get(F.try_parse_json(o), "$", "map<string,variant>"))
        return F.coalesce(F.transform(found, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value"))),
                          F.array().cast("array<struct<key:string,value:string>>"))

    own, last = entries(a), entries(b)
    names = F.transform(last, lambda e: e["key"])
    both = F.array_sort(F.concat(F.filter(own, lambda e: ~F.array_contains(names, e["key"])), last))
    body = F.array_join(F.transform(both, lambda e: F.concat(F.lit('"'), F.replace(F.replace(e["key"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('":'), e["value"])), ",")
    return F.concat(F.lit("{"), body, F.lit("}"))


def round_floats(x: Column, decimals: int) -> Column:
    """``round(double(x), decimals)`` of a float column without the decimals that ``round`` makes of every value.

    For up to six decimals a float times a power of ten is exact in a double, so halves are seen as they
    are and go away from zero; the quotient is the double nearest to the decimal number, as of ``round``.
    Values that do not fit (NaN, infinite, 2^30 and more) take ``round`` itself.
    """
    v, power = x.cast("float").cast("double"), F.lit(float(10 ** decimals))
    whole = F.floor(F.abs(v) * power + F.lit(0.5))
    return F.when(F.abs(v) < F.lit(float(1 << 30)), F.when(v < 0, -whole).otherwise(whole) / power).otherwise(F.round(v, decimals))
