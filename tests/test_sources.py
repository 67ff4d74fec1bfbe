import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from probeloom.operators.checks import CheckFailed
from probeloom.session import materialize, settle
from probeloom.sources import convert, digests, readers, writers


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_text_table_keeps_empty_text(spark, folder):
    path = put(folder, "cells.csv", "cell_id,donor,cell_type\n1,d1,alpha\n002,,beta\n3,NA,\n")
    got = sorted(tuple(r) for r in readers.read_text_table(spark, path, ["cell_id", "cell_type", "donor"]).collect())
    assert got == [("002", "beta", ""), ("1", "alpha", "d1"), ("3", "", "NA")]
    with pytest.raises(CheckFailed):
        readers.read_text_table(spark, path, ["missing"])
    assert readers.read_exclusions(spark, path).columns == ["entity_id"]


def test_panel_keeps_file_order(spark, folder):
    path = put(folder, "panel.tsv", "feature_id\tfeature_name\nE9\tzeta\nE1\talpha\nE5\tmid\n")
    got = [(r["panel_pos"], r["feature_name"]) for r in readers.read_panel(spark, path).orderBy("panel_pos").collect()]
    assert got == [(0, "zeta"), (1, "alpha"), (2, "mid")]


def test_grid_order_and_checks(spark):
    rows = [tuple(r) for r in readers.grid(spark, [32, 64], [0.5, 1.0], [42], 10).collect()]
    assert rows == [(32, 0.5, 42, 10), (32, 1.0, 42, 10), (64, 0.5, 42, 10), (64, 1.0, 42, 10)]
    for bad in ([[32, 32], [1.0], [1], 1], [[0], [1.0], [1], 1], [[1], [-1.0], [1], 1], [[1], [1.0], [], 1]):
        with pytest.raises(ValueError):
            readers.grid(spark, *bad)


def test_coordinates_round_trip(spark, folder):
    entries = spark.createDataFrame([(0, 0, 3.0), (2, 1, 1.0), (1, 3, 7.0)], "feature_pos long, entity_pos long, cnt double")
    path = f"{folder}/matrix"
    readers.write_coordinates(entries.repartition(3), path, 3, 4)
    got = sorted(tuple(r) for r in readers.read_coordinates(spark, path).collect())
    assert got == sorted(tuple(r) for r in entries.collect())


def test_single_coordinate_file(spark, folder):
    text = "%%MatrixMarket matrix coordinate integer general\n% made by hand\n2 2 3\n1 1 5\n2 1 1\n2 2 3\n"
    path = put(folder, "m.mtx", text)
    got = sorted(tuple(r) for r in readers.read_coordinates(spark, path).collect())
    assert got == [(0, 0, 5.0), (1, 0, 1.0), (1, 1, 3.0)]
    short = put(folder, "short.mtx", text.replace("2 2 3\n1", "2 2 4\n1"))
    with pytest.raises(CheckFailed):
        readers.read_coordinates(spark, short)
    outside = put(folder, "outside.mtx", text.replace("1 1 5", "9 1 5"))
    with pytest.raises(CheckFailed):
        readers.read_coordinates(spark, outside)


def test_large_coordinate_file_is_split(spark, folder):
    lines = ["%%MatrixMarket matrix coordinate integer general", "500 400 20000"]
    lines += [f"{i % 500 + 1} {i // 500 + 1} {i % 7 + 1}" for i in range(20000)]
    path = put(folder, "big.mtx", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
    try:
        entries = readers.read_coordinates(spark, path)
        assert entries.rdd.getNumPartitions() > 3
        assert entries.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_file_digests(spark, folder):
    path = put(folder, "a.txt", "hello")
    row = digests.file_digests(spark, folder).first()
    assert row["sha256"] == hashlib.sha256(b"hello").hexdigest() and row["n_bytes"] == 5 and row["path"].endswith("a.txt")
    assert path


def plain_root(data: bytes, leaf: int, fanout: int) -> str:
    level = [hashlib.sha256(b"\0" + data[i:i + leaf]).digest() for i in range(0, len(data), leaf)]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i:i + fanout])).digest() for i in range(0, len(level), fanout)]
    return hashlib.sha256(f"{len(data)}:{level[0].hex() if level else ''}".encode()).hexdigest()


def test_tree_digests_do_not_depend_on_splits_and_parts(spark, folder):
    rng = np.random.default_rng(2)
    data = b"\xef\xbb\xbf" + rng.integers(0, 256, 30000).astype(np.uint8).tobytes() + b"\r\n\n" + b"x" * 5000 + b"\xff" * 700
    for name, cuts in (("whole", []), ("three", [9000, 20011]), ("many", [2, 4, 1000, 1000, 30006, 35705])):
        os.makedirs(f"{folder}/{name}")
        for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)])):
            with open(f"{folder}/{name}/part-{i}", "wb") as f:
                f.write(data[a:b])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split, name, parts in (("4096", "whole", 1), (old, "three", 3), ("16384", "many", 6)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            row = digests.tree_digests(spark, f"{folder}/{name}", as_one=True, leaf_bytes=2048, fanout=4).collect()
            assert [(r["n_files"], r["n_bytes"], r["root"]) for r in row] == [(parts, len(data), plain_root(data, 2048, 4))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    each = digests.tree_digests(spark, f"{folder}/many", leaf_bytes=2048, fanout=4).collect()
    cuts = [0, 2, 4, 1000, 1000, 30006, 35705, len(data)]
    assert {r["stream"][-1]: r["root"] for r in each} == {str(i): plain_root(data[a:b], 2048, 4) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a}
    put(folder, "many/a.gz", "x")
    with pytest.raises(ValueError):
        digests.tree_digests(spark, f"{folder}/many")


def test_fingerprint_ignores_order_only(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, [2.0]), (2, "", [2.0])], "i int, s string, v array<double>")
    base = digests.checksum(df)
    assert digests.checksum(df.orderBy(F.col("i").desc()).repartition(3)) == base
    assert digests.checksum(df.withColumn("s", F.coalesce("s", F.lit("")))) != base
    assert digests.checksum(df.unionByName(df.limit(1))) != base


def test_writers_refuse_existing_outputs(spark, folder):
    df = spark.range(5)
    stored = writers.write_table(df, f"{folder}/t", verify=True)
    assert stored.count() == 5
    with pytest.raises(Exception):
        writers.write_table(df, f"{folder}/t")
    with pytest.raises(FileExistsError):
        writers.refuse_existing(spark, f"{folder}/t")
    assert not writers.exists(spark, f"{folder}/nothing")
    writers.write_report(spark, {"a": [1, 2], "b": {"c": None}}, f"{folder}/r")
    assert writers.read_report(spark, f"{folder}/r") == {"a": [1, 2], "b": {"c": None}}
    with pytest.raises(CheckFailed):
        writers.verify_stored(df, spark.range(4))
    writers.write_csv(df, f"{folder}/c")
    assert spark.read.csv(f"{folder}/c", header=True).count() == 5


def test_folds_are_appended(spark, folder):
    for g in ("a", "b"):
        writers.append_fold(spark.createDataFrame([(g, 1.0)], "outer_grp string, f double"), f"{folder}/folds")
    assert spark.read.parquet(f"{folder}/folds").count() == 2


def test_settle_chooses_by_size(spark):
    small, large = settle(spark.range(10), max_rows=10), settle(spark.range(11), max_rows=10)
    assert small.count() == 10 and large.count() == 11
    big = spark.range(1000).toDF("id")
    assert "BroadcastHashJoin" in big.join(small, "id")._jdf.queryExecution().executedPlan().toString()
    assert large.inputFiles()


def test_materialized_partitions_are_pruned(spark):
    df = materialize(spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("b")), "t", partition_by="b")
    plan = df.filter("b = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(b" in plan and df.filter("b = 2").count() == 25


def export(spark, root, entries, features, entities, shape=None):
    df = spark.createDataFrame(entries, "feature_pos long, entity_pos long, cnt double")
    readers.write_coordinates(df, f"{root}/matrix", *(shape or (len(features), len(entities))))
    spark.createDataFrame([(f,) for f in features], "feature_id string").coalesce(1).write.csv(f"{root}/features", header=True)
    spark.createDataFrame(entities, "entity_id string, label string, grp string").coalesce(1).write.csv(f"{root}/entities", header=True)
    return [f"{root}/{name}" for name in ("matrix", "features", "entities", "tables")]


def test_converted_counts_carry_their_names(spark, folder):
    entities = [(f"c{9 - i}", "a", "g") for i in range(10)]
    features = [f"f{i * 7 % 10}" for i in range(10)]
    entries = [(i, j, float(i + j)) for i in range(10) for j in range(10) if (i + j) % 3]
    report = convert.convert_counts(spark, *export(spark, folder, entries, features, entities))
    assert report["n_entries"] == len(entries) and report["total"] == sum(int(c) for *_, c in entries)
    got = {(r["entity_id"], r["feature_id"]): r["cnt"] for r in spark.read.parquet(f"{folder}/tables/counts").collect()}
    assert got == {(entities[j][0], features[i]): int(c) for i, j, c in entries}


def test_order_of_lines_survives_many_splits(spark, folder):
    names = [f"name{i * 7919 % 30011:07d}" for i in range(3000)]
    with open(f"{folder}/names.csv", "w") as f:
        f.write("name\n" + "\n".join(names) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1000")
        rows = convert.read_ordered(spark, f"{folder}/names.csv", ["name"])
        got = {r["pos"]: r["name"] for r in rows.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == dict(enumerate(names))


@pytest.mark.parametrize("fault", ["short names", "repeated name", "blank label", "repeated entity", "twice", "negative", "fraction"])
def test_faulty_exports_are_refused(spark, folder, fault):
    entities, features = [("c0", "a", "g"), ("c1", "b", "g"), ("c2", "a", "h")], ["f0", "f1"]
    entries, shape = [(0, 0, 1.0), (1, 1, 2.0), (0, 2, 3.0)], None
    if fault == "short names":
        shape = (3, 3)
    if fault == "repeated name":
        features = ["f0", "f0"]
    if fault == "blank label":
        entities[1] = ("c1", " ", "g")
    if fault == "repeated entity":
        entities[1] = ("c0", "b", "g")
    if fault == "twice":
        entries.append((0, 0, 1.0))
    if fault == "negative":
        entries[0] = (0, 0, -1.0)
    paths = export(spark, folder, entries, features, entities, shape)
    if fault == "fraction":
        spark.createDataFrame([("1 1 1.5",)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/matrix/part=1")
        spark.createDataFrame([("2 3 1",)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/matrix/part=0")
    with pytest.raises(CheckFailed):
        convert.convert_counts(spark, *paths)


def test_digests_of_large_files_in_rounds(spark, folder):
    """A row per file would read each whole; rounds take a part, whatever splits, line feeds and marks there are."""
    rng = np.random.default_rng(6)
    noise = rng.integers(0, 256, 30000).astype(np.uint8).tobytes()
    mark = b"\xef\xbb\xbf"
    files = {"small": b"abc\n", "noise": noise, "marked": mark + noise[:20001] + b"\n\n\r\n", "runs": b"x" * 9000 + b"\n" * 9000,
             "even": noise[:16384], "line feed": noise[:5000] + b"\n", "packed.gz": noise[:25000]}
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for size in (2048, 8192):
            rows = digests.file_digests(spark, folder, whole_bytes=1000, round_bytes=size).collect()
            assert {r["path"].rsplit("/", 1)[1]: (r["n_bytes"], r["sha256"]) for r in rows} == {
                k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in files.items()}
            assert all(r["path"].startswith("file:/") for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sha256_goes_on_from_a_state():
    if digests.libcrypto() is None:
        pytest.skip("no libcrypto here")
    data, state = bytes(range(256)) * 5, b""
    for a, b in ((0, 1), (1, 64), (64, 200), (200, 1280)):
        h = digests.ResumedSha256(state)
        h.update(data[a:b])
        state = h.state()
    assert digests.digest_of(state) == hashlib.sha256(data).digest()


def test_coordinate_text_is_scanned_once(spark, folder):
    """Every use of the entries, and the size line, came from another scan of the text."""
    lines = "% made by hand\n\n  3 4 5  \n1 1 5\n2\t1 1\n 3   4 \t7\n3 4 5\n2 2 3\n"
    path = put(folder, "m.mtx", lines)
    entries, size = readers.stored_coordinates(spark, path)
    put(folder, "m.mtx", "1 1 1\n1 1 99\n")
    assert size == (3, 4, 5)
    assert sorted(tuple(r) for r in entries.collect()) == [(0, 0, 5.0), (1, 0, 1.0), (1, 1, 3.0), (2, 3, 5.0), (2, 3, 7.0)]
    os.makedirs(f"{folder}/parts")
    put(folder, "parts/a", "% only a comment\n")
    put(folder, "parts/b", "2 2 1\n")
    put(folder, "parts/c", "2 2 1\n")
    assert [tuple(r) for r in readers.read_coordinates(spark, f"{folder}/parts").collect()] == [(1, 1, 1.0)]
    assert readers.coordinate_size(spark, f"{folder}/parts") == (2, 2, 1)
    put(folder, "none.mtx", "% nothing\n")
    with pytest.raises(CheckFailed):
        readers.coordinate_size(spark, f"{folder}/none.mtx")


def test_fingerprint_adds_parts_of_row_digests(spark):
    rows = [(f"e{i}", i % 3) for i in range(500)]
    found = digests.fingerprint(spark.createDataFrame(rows, "s string, i int")).first()
    texts = [hashlib.sha256(f"{len(str(i))}={i}|{len(s)}={s}".encode()).hexdigest() for s, i in rows]
    assert found["checksum"] == ":".join(str(sum(int(t[at:at + 15], 16) for t in texts)) for at in (0, 15, 30, 45))
