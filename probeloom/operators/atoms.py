"""Atom comparison, matching and review.

Tables here are of model size (atoms, atoms x coordinates, atoms x atoms); only
the code statistics read all entities, in single partial-aggregated scans.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeloom.functions import vectors as V
from probeloom.functions.arrow import task_function, to_lists, to_matrix
from probeloom.functions.scalars import ACTIVE_THRESHOLD, VARIANCE_FLOOR
from probeloom.operators.checks import MAX_CLASSES
from probeloom.session import bounded_rows, settle

TOP_MATCH = 20


def atom_matrix(atoms: DataFrame) -> np.ndarray:
    """Weights in atom order. Dictionaries are of model size."""
    return np.array([r["weights"] for r in sorted(atoms.select("atom", "weights").collect(), key=lambda r: r["atom"])])


def similarity(atoms: DataFrame, other: np.ndarray) -> DataFrame:
    """atom_a, atom_b, cosine for every atom of ``atoms`` against ``other``.

    Each atom row is multiplied with the other dictionary inside its task.
    """
    unit = other / np.linalg.norm(other, axis=1, keepdims=True)

    @task_function("array<double>")
    def cosines(weights: pa.Array) -> pa.Array:
        if not len(weights):
            return pa.array([], pa.list_(pa.float64()))
        w = to_matrix(weights)
        return to_lists(w / np.linalg.norm(w, axis=1, keepdims=True) @ unit.T)

    keep = [c for c in atoms.columns if c != "weights"]
    return atoms.select(
        *[F.col("atom").alias("atom_a") if c == "atom" else F.col(c) for c in keep],
        F.posexplode(cosines("weights")).alias("b", "cosine"),
    ).withColumn("atom_b", F.col("b") + 1).drop("b")


def self_similarity(atoms: DataFrame) -> DataFrame:
    """Cosine of every atom with every other atom of the same dictionary."""
    return similarity(atoms, atom_matrix(atoms)).filter("atom_a <> atom_b")


def _weights_long(atoms: DataFrame) -> DataFrame:
    return atoms.select("atom", F.posexplode("weights").alias("pos", "weight"))


def top_signed(atoms: DataFrame, k: int) -> DataFrame:
    """atom, sign, rank, pos, weight: largest weights of each sign, ties to lower position."""
    place = Window.partitionBy("atom", "sign").orderBy(F.abs("weight").desc(), "pos")
    return (
        _weights_long(atoms).filter("weight <> 0")
        .withColumn("sign", F.when(F.col("weight") > 0, "positive").otherwise("negative"))
        .withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        .select("atom", "sign", "rank", "pos", "weight")
    )


def top_absolute(atoms: DataFrame, k: int = TOP_MATCH) -> DataFrame:
    """atom, pos: the k largest absolute weights, ties to higher position."""
    place = Window.partitionBy("atom").orderBy(F.abs("weight").desc(), F.col("pos").desc())
    return (
        _weights_long(atoms).withColumn("rank", F.row_number().over(place))
        .filter(F.col("rank") <= k).select("atom", "rank", "pos", "weight")
    )


def _top_sets(atoms: DataFrame, k: int, suffix: str) -> DataFrame:
    return top_absolute(atoms, k).groupBy(F.col("atom").alias(f"atom_{suffix}")).agg(
        F.array_sort(F.collect_set("pos")).alias(f"top_{suffix}")
    )


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def code_correlations(codes: DataFrame, za: str = "za", zb: str = "zb") -> DataFrame:
    """atom_a, atom_b, correlation of code coordinates over all rows.

    Tasks add up products and squares (a model-size block each); the pairs are
    formed from the sums, not from the rows. NULL when a coordinate is constant.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = to_matrix(batch.column(0)), to_matrix(batch.column(1))
            ones = np.ones((a.shape[0], 1))
            left = np.hstack([a, ones])
            right = np.hstack([b, ones])
            part = np.hstack([
                left.T @ right, (left ** 2).sum(axis=0)[:, None],
                np.vstack([(right ** 2).sum(axis=0)] * left.shape[1]),
            ])
            total = part if total is None else total + part
        if total is not None:
            k = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), to_lists(total)], names=["k", "v"])

    merged = (
        codes.select(F.col(za).alias("za"), F.col(zb).alias("zb"))
        .mapInArrow(sums, "k int, v array<double>")
        .groupBy("k").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    )
    m = np.array([r["v"] for r in sorted(merged.collect(), key=lambda r: r["k"])])
    ka = len(m) - 1
    kb = (m.shape[1] - 3) // 2
    n, sa, sb = m[ka, kb], m[:ka, kb], m[ka, :kb]
    saa, sbb = m[:ka, kb + 1], m[0, kb + 2:kb + 2 + kb]
    cov = m[:ka, :kb] / n - np.outer(sa, sb) / n ** 2
    va, vb = np.maximum(saa / n - (sa / n) ** 2, 0), np.maximum(sbb / n - (sb / n) ** 2, 0)
    rows = []
    for i in range(ka):
        for j in range(kb):
            usable = np.sqrt(va[i]) > VARIANCE_FLOOR and np.sqrt(vb[j]) > VARIANCE_FLOOR
            rows.append((i + 1, j + 1, float(cov[i, j] / np.sqrt(va[i] * vb[j])) if usable else None))
    return codes.sparkSession.createDataFrame(rows, "atom_a int, atom_b int, correlation double")


def atom_pairs(a: DataFrame, b: DataFrame, codes: DataFrame, top: int = TOP_MATCH) -> DataFrame:
    """All atom pairs of two dictionaries: cosine, overlap of top features, code correlation."""
    return (
        similarity(a.select("atom", "weights"), atom_matrix(b))
        .join(F.broadcast(_top_sets(a, top, "a")), "atom_a")
        .join(F.broadcast(_top_sets(b, top, "b")), "atom_b")
        .join(F.broadcast(code_correlations(codes)), ["atom_a", "atom_b"])
        .select("atom_a", "atom_b", "cosine", jaccard(F.col("top_a"), F.col("top_b")).alias("jaccard"), "correlation")
    )


def assign(weight: np.ndarray) -> np.ndarray:
    """Columns matched one-to-one to rows with the largest total weight.

    Shortest augmenting paths with dual prices; rows must not outnumber columns.
    """
    cost = -weight
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        reach = np.full(m, np.inf)
        via = np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        row, last = start, -1
        while True:
            slack = cost[row] - row_price[row] - col_price
            if last >= 0:
                slack = slack + reach[last]
            better = ~done & (slack < reach)
            reach[better], via[better] = slack[better], last
            last = int(np.where(done, np.inf, reach).argmin())
            done[last] = True
            if owner[last] < 0:
                break
            row = owner[last]
        shortest = reach[last]
        settled = done & (np.arange(m) != last)
        row_price[start] += shortest
        row_price[owner[settled]] += shortest - reach[settled]
        col_price[settled] -= shortest - reach[settled]
        while last >= 0:
            previous = via[last]
            owner[last] = owner[previous] if previous >= 0 else start
            last = previous
    columns = np.empty(n, dtype=int)
    columns[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return columns


def match_atoms(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One-to-one match with the largest total absolute cosine, per key.

    ``pairs``: keys, atom_a, atom_b, cosine, jaccard, correlation for all pairs.
    A group is one atoms x atoms block, however many entities there are.
    """
    columns = ["atom_a", "atom_b", "cosine", "jaccard", "correlation"]
    fields = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = ", ".join([f"{k} {fields[k]}" for k in keys] + [
        "atom_a int", "atom_b int", "sign double", "abs_cosine double",
        "top_feature_jaccard double", "code_correlation double",
    ])

    def solve(block: pd.DataFrame) -> pd.DataFrame:
        cos = block.pivot(index="atom_a", columns="atom_b", values="cosine")
        chosen = assign(np.abs(cos.to_numpy()))
        picked = pd.DataFrame({"atom_a": cos.index, "atom_b": cos.columns[chosen]})
        out = picked.merge(block, on=["atom_a", "atom_b"])
        out["sign"] = np.where(out["cosine"] >= 0, 1.0, -1.0)
        out["abs_cosine"] = out["cosine"].abs()
        out["code_correlation"] = out["correlation"].astype(float) * out["sign"]
        out = out.rename(columns={"jaccard": "top_feature_jaccard"})
        return out[[*keys, "atom_a", "atom_b", "sign", "abs_cosine", "top_feature_jaccard", "code_correlation"]]

    block_key = F.concat_ws("|", *keys) if keys else F.lit("all")
    blocks = pairs.select(block_key.alias("_block"), *keys, *columns)
    return blocks.groupBy("_block").applyInPandas(solve, schema)


SEED_MATCHES = (
    "grp string, seed_a long, seed_b long, atom_a int, atom_b int, sign double, abs_cosine double, "
    "top_feature_jaccard double, code_correlation double"
)


def code_products(codes: DataFrame) -> DataFrame:
    """key, k, v: row k of [Z 1]'[Z 1] over the rows (key, z) of each key, from one scan.

    A task adds up one block per key it meets; blocks are of model size.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, np.ndarray] = {}
        for batch in batches:
            keys = np.array(batch.column("key").to_pylist(), dtype=object)
            for key in dict.fromkeys(keys.tolist()):
                z = to_matrix(batch.column("z").take(pa.array(np.flatnonzero(keys == key))))
                z = np.hstack([z, np.ones((len(z), 1))])
                part = z.T @ z
                blocks[key] = part if key not in blocks else blocks[key] + part
        for key, block in blocks.items():
            k = len(block)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * k), pa.array(np.arange(k, dtype=np.int32)), to_lists(block)], names=["key", "k", "v"])

    rows = codes.select(F.col("key").cast("string").alias("key"), F.col("z").cast("array<double>").alias("z"))
    return rows.mapInArrow(sums, "key string, k int, v array<double>").groupBy("key", "k").agg(
        vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))


def match_seeds(codes: DataFrame, dictionaries: dict[tuple[str, int], np.ndarray], top: int = TOP_MATCH) -> DataFrame:
    """Matched atoms of every pair of seeds under every key, as SEED_MATCHES (grp is the key).

    ``codes``: key, z, where z holds the codes of all dictionaries of the key side by
    side in seed order; ``dictionaries`` by (key, seed). All products come from one
    scan, and each key's pairs are matched in a task of their own.
    """
    own: dict[str, list[tuple[int, np.ndarray]]] = {}
    for (key, seed), d in sorted(dictionaries.items(), key=lambda item: (str(item[0][0]), item[0][1])):
        own.setdefault(str(key), []).append((int(seed), d))

    def match(block: pa.Table) -> pa.Table:
        key = block["key"][0].as_py()
        m = np.array(block.sort_by("k")["v"].to_pylist())
        n, mean = m[-1, -1], m[-1, :-1] / m[-1, -1]
        cov = m[:-1, :-1] / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        starts = np.cumsum([0, *(len(d) for _, d in own[key])])
        out = []
        for i, (seed_a, a) in enumerate(own[key]):
            for j, (seed_b, b) in enumerate(own[key][i + 1:], i + 1):
                length = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
                cosine = np.divide(a @ b.T, length, out=np.zeros_like(length), where=length > 0)
                # Largest weights first, ties to the higher position.
                tops = [[set(np.argsort(np.abs(w), kind="stable")[-top:].tolist()) for w in d] for d in (a, b)]
                for k, c in enumerate(assign(np.abs(cosine))):
                    sign = 1.0 if cosine[k, c] >= 0 else -1.0
                    p, q = starts[i] + k, starts[j] + c
                    usable = sd[p] > VARIANCE_FLOOR and sd[q] > VARIANCE_FLOOR
                    out.append((key, seed_a, seed_b, k + 1, int(c) + 1, sign, abs(float(cosine[k, c])),
                                len(tops[0][k] & tops[1][c]) / len(tops[0][k] | tops[1][c]),
                                float(sign * cov[p, q] / (sd[p] * sd[q])) if usable else None))
        names = [f.split()[0] for f in SEED_MATCHES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
        return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(zip(names, kinds))})

    return code_products(codes).groupBy("key").applyInArrow(match, SEED_MATCHES)


def stability(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: mean and median cosine, mean overlap and code correlation."""
    corr = F.when(~F.isnan("code_correlation"), F.col("code_correlation"))
    return matches.groupBy(*keys).agg(
        F.avg("abs_cosine").alias("mean_abs_cosine"),
        F.median("abs_cosine").alias("median_abs_cosine"),
        F.avg("top_feature_jaccard").alias("mean_top_feature_jaccard"),
        F.avg(corr).alias("mean_code_correlation"),
    )


# --- review of one dictionary -------------------------------------------------

def _active(z: Column) -> Column:
    return F.transform(z, lambda v: (F.abs(v) > ACTIVE_THRESHOLD).cast("double"))


def code_activity(codes: DataFrame, z: str = "z") -> DataFrame:
    """Per atom, split and label: n_rows, mean, mean absolute value, active share, standardized mean.

    ``codes``: label, split, z. Whole vectors are averaged map-side per (split,
    label) in one scan; atoms are opened afterwards, on a table with one row per
    class and split, which also yields the training mean and SD.
    """
    means = settle(
        codes.select(
            "split", "label", array_to_vector(z).alias("v"), array_to_vector(F.transform(z, F.abs)).alias("a"),
            array_to_vector(_active(F.col(z))).alias("on"),
        ).groupBy("split", "label").agg(
            F.count(F.lit(1)).alias("n_rows"),
            Summarizer.metrics("mean", "normL2").summary(F.col("v")).alias("m"),
            vector_to_array(Summarizer.mean(F.col("a"))).alias("mean_abs"),
            vector_to_array(Summarizer.mean(F.col("on"))).alias("active"),
        ).select(
            "split", "label", "n_rows", vector_to_array("m.mean").alias("mean"),
            vector_to_array("m.normL2").alias("length"), "mean_abs", "active",
        )
    )
    center, scale = _train_scale(means)
    opened = F.posexplode(F.arrays_zip(
        F.col("mean"), F.col("mean_abs"), F.col("active"),
        V.literal(center).alias("center"), V.literal(scale).alias("scale"),
    ))
    v = F.col("v")
    return means.select("split", "label", "n_rows", opened.alias("a", "v")).select(
        (F.col("a") + 1).alias("atom"), "split", "label", "n_rows",
        v["mean"].alias("mean_activity"), v["mean_abs"].alias("mean_absolute_activity"),
        v["active"].alias("active_fraction"),
        ((v["mean"] - v["center"]) / v["scale"]).alias("standardized_mean"),
    )


def _train_scale(means: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training mean and population SD of each coordinate; SD 1 where constant."""
    rows = bounded_rows(means.filter("split = 'train'"), MAX_CLASSES, "training classes")
    n = sum(r["n_rows"] for r in rows)
    center = sum(r["n_rows"] * np.array(r["mean"]) for r in rows) / n
    second = sum(np.array(r["length"]) ** 2 for r in rows) / n
    sd = np.sqrt(np.maximum(second - center ** 2, 0))
    return center, np.where(sd > VARIANCE_FLOOR, sd, 1.0)


def code_usage(codes: DataFrame, z: str = "z") -> DataFrame:
    """Per split and atom: active share and whether the atom is never used."""
    on = codes.select("split", array_to_vector(_active(F.col(z))).alias("on"))
    rows = on.groupBy("split").agg(vector_to_array(Summarizer.mean(F.col("on"))).alias("share"))
    return rows.select("split", F.posexplode("share").alias("a", "active_fraction")).select(
        "split", (F.col("a") + 1).alias("atom"), "active_fraction",
        (F.col("active_fraction") == 0).alias("unused"),
    )


def order_by_contrast(activity: DataFrame, limit: int | None = None) -> DataFrame:
    """Atoms by their largest absolute standardized training mean over labels."""
    ranked = (
        activity.filter("split = 'train'").groupBy("atom")
        .agg(F.max(F.abs("standardized_mean")).alias("max_contrast"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.round("max_contrast", 9).desc(), "atom")))
    )
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def atom_diagnostics(atoms: DataFrame, activity: DataFrame) -> DataFrame:
    """atom, norm, train and validation active share, largest training contrast.

    ``activity`` comes from :func:`code_activity`; shares over all rows are its
    row-weighted means.
    """
    share = F.sum(F.col("active_fraction") * F.col("n_rows")) / F.sum("n_rows")
    usage = activity.groupBy("atom").pivot("split", ["train", "validation"]).agg(share)
    return (
        atoms.select("atom", V.norm(F.col("weights")).alias("norm"))
        .join(usage.withColumnsRenamed({"train": "train_active_fraction", "validation": "validation_active_fraction"}), "atom")
        .join(order_by_contrast(activity).select("atom", "max_contrast"), "atom")
    )


def review(atoms: DataFrame, codes: DataFrame, top: int = 10, display: int = 12) -> dict[str, DataFrame]:
    """All review tables of one dictionary; the codes are scanned once."""
    activity = code_activity(codes)
    return {
        "top_features": top_signed(atoms, top),
        "activity": activity,
        "diagnostics": atom_diagnostics(atoms, activity),
        "displayed": order_by_contrast(activity, display),
        "max_cosine": self_similarity(atoms).agg(F.max(F.abs("cosine")).alias("max_absolute_cosine")),
    }
