"""The plans that hints, sorts and filters are to give, and not only their rows."""

import os

import pytest
from pyspark.sql import functions as F

from wayfold.operators import index, search
from wayfold.plans import function_families

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,node", [
    ("sql_broadcast_join", "BroadcastHashJoin"), ("sql_sort_merge_join", "SortMergeJoin"), ("sql_shuffled_hash_join", "ShuffledHashJoin"), ("sql_sort_aggregate", "SortAggregate"),
])
def test_hints_choose_the_operator(spark, name, node):
    assert node in plan(function_families.QUERIES[name](spark, DATA)).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["sql_sort_by", "sql_cluster_by"])
def test_sorts_within_partitions(spark, name):
    df = function_families.QUERIES[name](spark, DATA)
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" in tree and ", false" in tree
    column = tree.split("Sort [")[1].split("#")[0]
    parts = df.withColumns({"p": F.spark_partition_id(), "m": F.monotonically_increasing_id()}).select("p", "m", column).collect()
    for p in {r["p"] for r in parts}:
        own = [r[column] for r in sorted(parts, key=lambda r: r["m"]) if r["p"] == p]
        assert own in (sorted(own), sorted(own, reverse=True))


@pytest.mark.parametrize("name", ["sql_distribute_by", "sql_cluster_by"])
def test_rows_of_a_key_lie_together(spark, name):
    df = function_families.QUERIES[name](spark, DATA)
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    column = tree.split("RepartitionByExpression [")[1].split("#")[0]
    homes = df.withColumn("p", F.spark_partition_id()).groupBy(column).agg(F.countDistinct("p").alias("n"))
    assert homes.agg(F.max("n")).first()[0] == 1


FILTERS = {
    "l_orderkey = 5": "EqualTo(l_orderkey,5)", "l_orderkey <=> 5": "EqualNullSafe(l_orderkey,5)", "l_quantity > 5": "GreaterThan(l_quantity,5.0)", "l_quantity >= 5": "GreaterThanOrEqual(l_quantity,5.0)",
    "l_quantity < 5": "LessThan(l_quantity,5.0)", "l_quantity <= 5": "LessThanOrEqual(l_quantity,5.0)", "l_orderkey IN (1, 2, 3)": "In(l_orderkey, [1,2,3])", "l_returnflag IS NULL": "IsNull(l_returnflag)",
    "l_returnflag IS NOT NULL": "IsNotNull(l_returnflag)", "l_orderkey = 1 OR l_quantity < 2": "Or(EqualTo(l_orderkey,1),LessThan(l_quantity,2.0))", "NOT l_orderkey = 5": "Not(EqualTo(l_orderkey,5))",
    "l_returnflag LIKE 'A%'": "StringStartsWith(l_returnflag,A)", "l_returnflag LIKE '%A'": "StringEndsWith(l_returnflag,A)", "l_returnflag LIKE '%A%'": "StringContains(l_returnflag,A)",
}


@pytest.mark.parametrize("condition", list(FILTERS))
def test_filters_reach_the_scan(spark, condition):
    df = spark.read.parquet(f"{DATA}/lineitem.parquet").where(condition).select("l_linenumber")
    tree = df._jdf.queryExecution().executedPlan().toString()
    pushed = tree.split("PushedFilters: [")[1]
    assert FILTERS[condition].split(",")[0] in pushed.split("ReadSchema")[0], pushed
    assert "l_comment" not in tree.split("ReadSchema: ")[1]


def test_both_conditions_reach_the_scan(spark):
    df = spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_orderkey > 5 AND l_quantity < 9")
    pushed = df._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1]
    assert "GreaterThan(l_orderkey,5)" in pushed and "LessThan(l_quantity,9.0)" in pushed


def test_index_bounds_reach_the_files(spark):
    """An indexed search filters folders and, within them, the ends of trajectories by the files' statistics."""
    frame = spark.range(200).select("id", F.expr("array(array(CAST(id AS DOUBLE), 0D), array(CAST(id AS DOUBLE), 1D))").alias("traj"))
    index.create_index(frame, "traj", "pushed")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        tree = plan(search.threshold_search(frame, [[50.0, 0.0], [50.0, 1.0]], "traj", "DTW", 3.0))
        scan = tree.split("PushedFilters: [")[1].split("ReadSchema")[0]
        assert "GreaterThanOrEqual(__first0" in scan and "LessThanOrEqual(__last0" in scan
        assert "__tile" in tree.split("PartitionFilters: [")[1].split("]")[0]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        index.drop_index(frame, "traj")


def test_median_of_near_halves(spark):
    """The median is the least value that half of the rows don't exceed, where the halves differ by one row."""
    from pyspark.sql import functions as F

    from wayfold.plans import commands

    for n, want in ((100_000, 25.0), (99_998, 26.0)):
        rows = spark.range(200_000).select(F.when(F.col("id") < n, 25.0).otherwise(26.0).alias("v"))
        assert commands._median(rows, "v") == want
