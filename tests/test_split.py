import pytest
from pyspark.sql import functions as F

from probeloom.operators import checks, split
from probeloom.plans.reports import label_group_counts
from tests import golden


def as_map(df, key="entity_id", value="split"):
    return {r[key]: r[value] for r in df.collect()}


def test_apportionment_matches_published_sizes(spark):
    totals = {k: sum(v) for k, v in golden.COUNTS.items() if sum(v) >= 30}
    df = spark.createDataFrame(list(totals.items()) + [("thirty", 30)], "label string, n long")
    sizes = {r["label"]: r["s"] for r in df.select("label", split.apportion(F.col("n")).alias("s")).collect()}
    assert sizes.pop("thirty") == [21, 5, 4]
    assert [sum(s[i] for s in sizes.values()) for i in range(3)] == [5954, 1277, 1275]
    assert {k: s[2] for k, s in sizes.items()} == golden.TEST_SIZES


def test_apportionment_sums_to_n(spark):
    df = spark.range(1, 3000).select("id", split.apportion(F.col("id")).alias("s"))
    assert df.filter("aggregate(s, 0L, (a, x) -> a + x) <> id").isEmpty()


def test_split_of_published_cohort(spark):
    entities = golden.entities(spark)
    result = split.stratified_split(entities)
    by_split = {r["split"]: r["count"] for r in result.manifest.groupBy("split").count().collect()}
    assert by_split == {"train": 5954, "validation": 1277, "test": 1275}
    assert result.train_rows == 5954
    removed = {r["label"]: r["count"] for r in result.excluded.groupBy("label").count().collect()}
    assert removed == {"t_cell": 7, "schwann": 13, "epsilon": 18, "mast": 25}
    assert checks.coverage_gaps(result.manifest, "label", "split").isEmpty()
    assert checks.partition_violations(entities, result.manifest, result.excluded).isEmpty()
    counted = result.manifest.groupBy("label").pivot("split").count()
    assert checks.cohort_differences(
        counted.select("label", "train", "validation", "test"),
        result.split_counts, ("label", "train", "validation", "test")).isEmpty()


def test_published_margins(spark):
    table = {r["label"]: r.asDict() for r in label_group_counts(golden.entities(spark), golden.GROUPS).collect()}
    assert table["Total"]["Total"] == 8569
    assert [table["Total"][g] for g in golden.GROUPS] == [1937, 1724, 3605, 1303]
    for label, counts in golden.COUNTS.items():
        assert [table[label][g] for g in golden.GROUPS] == counts and table[label]["Total"] == sum(counts)


def test_input_order_and_bucketing_do_not_matter(spark):
    entities = golden.entities(spark)
    base = as_map(split.stratified_split(entities, validate=False).manifest)
    shuffled = entities.repartition(7, F.rand(3)).orderBy(F.rand(5))
    assert as_map(split.stratified_split(shuffled, validate=False).manifest) == base
    # Small buckets take the two-level path that large labels need.
    assert as_map(split.stratified_split(entities, validate=False, per_bucket=40).manifest) == base
    assert as_map(split.stratified_split(entities, seed=7, validate=False).manifest) != base


def test_listed_exclusions_come_first(spark):
    rows = [(f"a{i}", "big", "g") for i in range(40)] + [(f"b{i}", "edge", "g") for i in range(30)]
    entities = spark.createDataFrame(rows, "entity_id string, label string, grp string")
    listed = spark.createDataFrame([("b0",)], "entity_id string")
    result = split.stratified_split(entities, listed)
    reasons = as_map(result.excluded, value="reason")
    assert reasons["b0"] == split.LISTED and reasons["b1"] == split.RARE and len(reasons) == 30
    stages = {r["label"]: (r["original"], r["after_listed"], r["retained"]) for r in result.label_counts.collect()}
    assert stages == {"big": (40, 40, 40), "edge": (30, 29, 0)}


def test_bad_input_is_refused(spark):
    ok = spark.createDataFrame([(f"a{i}", "x", "g") for i in range(30)], "entity_id string, label string, grp string")
    with pytest.raises(checks.CheckFailed):
        split.stratified_split(ok.unionByName(ok.limit(1)))
    with pytest.raises(checks.CheckFailed):
        split.stratified_split(ok.withColumn("label", F.lit("  ")))
    with pytest.raises(checks.CheckFailed):
        split.stratified_split(ok, spark.createDataFrame([("zz",)], "entity_id string"))
    with pytest.raises(checks.CheckFailed):
        split.stratified_split(ok, spark.createDataFrame([("a1",), ("a1",)], "entity_id string"))
    with pytest.raises(ValueError):
        split.stratified_split(ok.limit(29))


def test_assign_reaches_any_rows(spark):
    result = split.stratified_split(golden.entities(spark), validate=False)
    again = as_map(result.assign(golden.entities(spark)))
    assert again == as_map(result.manifest)


def test_assignment_does_not_shuffle(spark):
    result = split.stratified_split(golden.entities(spark), validate=False)
    plan = result.manifest._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("per_bucket", [1_000_000, 300])
def test_nested_samples_are_prefixes(spark, per_bucket):
    entities = golden.entities(spark)
    found = split.nested_samples(entities, [10, 100, 1000], per_bucket=per_bucket)
    sizes = {r["smallest"]: r["count"] for r in found.groupBy("smallest").count().collect()}
    assert sizes == {10: 10, 100: 90, 1000: 900}
