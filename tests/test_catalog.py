"""Registered queries against their SQL on the driver's smallest usable tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as registry
from probeloom.sources import digests
from tests.test_sources import plain_root
from tools import compare

SF = "/root/testdata/sf0.01"
QUICK = [
    "library_size", "stratified_split", "split_exclusions", "label_by_group", "coverage_gaps", "partition_violations",
    "id_quality", "domain_violations", "table_fingerprints", "selected_features", "panel_mapping", "coordinate_matrix",
    "fold_audit", "classification_report", "metrics_by_group", "dictionary_ranking", "best_lambda", "sparse_codes_batch",
    "kkt_summary", "atom_matching", "atom_diagnostics", "stale_stages", "provenance_chains",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    result = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert compare.rows_of(df.columns, df.collect()) == compare.rows_of(columns, result.fetchall())


def test_singular_values_that_nearly_coincide(spark, folder):
    rng = np.random.default_rng(5)
    left, right = (np.linalg.qr(rng.normal(size=(n, 24)))[0] for n in (300, 24))
    x = left @ np.diag([50, 49.999, 49.99, *np.linspace(49.9, 49, 21)]) @ right
    rows = [(i, i % 10, [float(v) for v in x[i]]) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
        sql = sorted(con.execute(registry.oracle_sql()["singular_values"]).fetchall())
    total = (x * x).sum()
    want = [(i, v, round(v * v / total, 5)) for i, v in ((1, 50.0), (2, 49.999), (3, 49.99))]
    assert sql == want
    assert [tuple(r) for r in registry.queries()["singular_values"](spark, folder).orderBy("rank").collect()] == want


def test_tree_digests_equal_plain_roots(spark):
    """All table files, at the leaves and fan-out in use."""
    found = {r["file"]: (r["n_bytes"], r["root"]) for r in registry.queries()["tree_digests"](spark, SF).collect()}
    assert set(found) == {f for f in os.listdir(SF) if f.endswith(".parquet")}
    for name, (size, root) in found.items():
        with open(f"{SF}/{name}", "rb") as f:
            data = f.read()
        assert (size, root) == (len(data), plain_root(data, digests.LEAF_BYTES, digests.FANOUT))


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["feature_id", "out_pos", "mean", "scale", "variance"]
    assert df.count() == 2000


def test_flagship_plan(spark):
    """Narrow scans, one shuffle by token, no shuffle of documents by key."""
    plan = registry.queries()["selected_features"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(feature_id") == 1
    assert "hashpartitioning(entity_id" not in plan and "hashpartitioning(label" not in plan
    assert "TakeOrderedAndProject" in plan and "SortMergeJoin" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
