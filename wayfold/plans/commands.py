"""Commands, catalogue and the DataFrame surface, each as a query whose rows show what it did."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions.shared import materialize
from wayfold.plans.catalogue import views
from wayfold.sources.files import place


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def _name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex}"


def create_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE AS, INSERT INTO, INSERT OVERWRITE, CREATE TABLE with columns, ANALYZE."""
    views(spark, sf_dir)
    a, b = _name("ctas"), _name("columns")
    spark.sql(f"CREATE TABLE {a} USING parquet LOCATION '{place(spark, 'ctas')}' AS SELECT n_nationkey, n_name FROM nation")
    spark.sql(f"INSERT INTO {a} SELECT r_regionkey + 100, r_name FROM region")
    spark.sql(f"CREATE TABLE {b} (k INT, name STRING) USING parquet LOCATION '{place(spark, 'columns')}'")
    spark.sql(f"INSERT INTO {b} VALUES (1, 'gone')")
    spark.sql(f"INSERT OVERWRITE TABLE {b} SELECT * FROM {a} WHERE n_nationkey >= 20")
    spark.sql(f"ANALYZE TABLE {b} COMPUTE STATISTICS")
    spark.sql(f"ANALYZE TABLE {b} COMPUTE STATISTICS FOR COLUMNS k")
    spark.sql(f"REFRESH TABLE {b}")
    return spark.table(b)


def view_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TEMP VIEW, its USING form, global views, and their catalogue."""
    views(spark, sf_dir)
    spark.sql("CREATE OR REPLACE TEMP VIEW view_small AS SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5")
    spark.sql(f"CREATE OR REPLACE TEMP VIEW view_using USING parquet OPTIONS (path '{sf_dir}/region.parquet')")
    spark.table("view_small").createOrReplaceGlobalTempView("view_global")
    both = spark.sql("SELECT k FROM global_temp.view_global UNION ALL SELECT r_regionkey + 100 FROM view_using")
    spark.catalog.refreshTable("view_using")
    return both


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql("DESCRIBE nation").select("col_name", "data_type")


def show_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql("SHOW COLUMNS IN part").select("col_name")


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql("SHOW TABLES").where("isTemporary AND tableName IN ('region', 'nation', 'part')").select("tableName").distinct()


def alter_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALTER TABLE CHANGE COLUMN sets a comment; DESCRIBE shows it."""
    name = _name("altered")
    spark.sql(f"CREATE TABLE {name} (k INT, v STRING) USING parquet LOCATION '{place(spark, 'altered')}'")
    spark.sql(f"ALTER TABLE {name} CHANGE COLUMN k COMMENT 'the key'")
    return spark.sql(f"DESCRIBE {name}").select("col_name", F.col("comment").alias("note"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET and RESET of a setting that only this session has."""
    spark.sql("SET wayfold.example=7")
    found = spark.createDataFrame(spark.sql("SET wayfold.example").collect()).select("key", "value")
    spark.sql("RESET wayfold.example")
    return found


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHOW and DESCRIBE FUNCTION, and a SQL function made and dropped."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION twice_and_one(x INT) RETURNS INT RETURN 2 * x + 1")
    (part,) = _tables(spark, sf_dir, "part")
    out = part.select("p_partkey", F.expr("twice_and_one(p_size)").alias("v"))
    shown = spark.sql("SHOW USER FUNCTIONS").where("function LIKE '%twice_and_one'").count()
    described = spark.sql("DESCRIBE FUNCTION abs").count() > 0
    spark.sql("DROP TEMPORARY FUNCTION twice_and_one")  # a plan that used it keeps its body
    gone = spark.sql("SHOW USER FUNCTIONS").where("function LIKE '%twice_and_one'").count() == 0
    return out.withColumn("shown", F.lit(shown == 1 and described and gone))


def caching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CACHE TABLE, its use, UNCACHE and the state after each."""
    views(spark, sf_dir)
    spark.sql("CACHE TABLE cached_nation AS SELECT n_regionkey, n_name FROM nation")
    during = spark.catalog.isCached("cached_nation")
    rows = spark.sql("SELECT n_regionkey, count(*) AS n FROM cached_nation GROUP BY n_regionkey").collect()
    spark.sql("UNCACHE TABLE cached_nation")
    return spark.createDataFrame([(r["n_regionkey"], r["n"], during, spark.catalog.isCached("cached_nation")) for r in rows], "k int, n long, during boolean, later boolean")


def clear_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables cached, and none after CLEAR CACHE."""
    views(spark, sf_dir)
    for name in ("region", "nation"):
        spark.sql(f"CACHE TABLE cleared_{name} AS SELECT * FROM {name}")
    during = spark.catalog.isCached("cleared_region") and spark.catalog.isCached("cleared_nation")
    spark.sql("CLEAR CACHE")
    later = spark.catalog.isCached("cleared_region") or spark.catalog.isCached("cleared_nation")
    joined = spark.sql("SELECT r_name, count(*) AS n FROM cleared_nation JOIN cleared_region ON n_regionkey = r_regionkey GROUP BY r_name")
    return joined.withColumns({"during": F.lit(during), "later": F.lit(later)})


def refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table over a folder in which files appear: REFRESH TABLE, then REFRESH of the path, show what is there."""
    path, name = place(spark, "refreshed"), f"refreshed_{uuid.uuid4().hex}"
    (part,) = _tables(spark, sf_dir, "part")
    keys = part.select("p_partkey", "p_brand")
    keys.where("p_partkey % 3 = 0").write.parquet(path)
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")
    try:
        found = []
        for left, command in ((1, f"REFRESH TABLE {name}"), (2, f"REFRESH '{path}'")):
            spark.table(name).count()  # the listing is kept
            keys.where(f"p_partkey % 3 = {left}").write.mode("append").parquet(path)
            spark.sql(command)
            if left == 2:
                spark.sql(f"REFRESH TABLE {name}")
            found.append(materialize(spark.table(name).groupBy("p_brand").agg(F.count("*").alias("n")).withColumn("stage", F.lit(left)), "refreshed"))
        return found[0].union(found[1])
    finally:
        spark.sql(f"DROP TABLE {name}")


def added_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ADD FILE and LIST FILE: the five regions' names as a file that the tasks read."""
    nation, region = _tables(spark, sf_dir, "nation", "region")
    name = f"regions-{uuid.uuid4().hex}.json"
    local = os.path.join(tempfile.mkdtemp(prefix="wayfold-"), name)
    with open(local, "w") as f:
        json.dump({r["r_regionkey"]: r["r_name"] for r in region.collect()}, f)
    spark.sql(f"ADD FILE '{local}'")
    listed = spark.sql("LIST FILES").where(F.col("Results").endswith(name)).count() == 1

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(SparkFiles.get(name)) as f:
            names = json.load(f)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[str(k)] for k in b.column(1).to_pylist()], pa.string())], ["n_name", "region"])

    return nation.select("n_name", "n_regionkey").mapInArrow(named, "n_name string, region string").withColumn("listed", F.lit(listed))


class Counts(AccumulatorParam):
    """Counts by name, summed name by name; of names whose number is bounded."""

    def zero(self, value: dict[str, int]) -> dict[str, int]:
        return {}

    def addInPlace(self, a: dict[str, int], b: dict[str, int]) -> dict[str, int]:
        for k, n in b.items():
            a[k] = a.get(k, 0) + n
        return a


def for_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """foreachPartition with a map accumulator: the tasks' counts of the event types. (A task that runs again counts again: for counts that must be exact, groupBy.)"""
    (events,) = _tables(spark, sf_dir, "events")
    total = spark.sparkContext.accumulator({}, Counts())

    def count(rows: Iterator) -> None:
        own: dict[str, int] = {}
        for r in rows:
            own[r["event_type"]] = own.get(r["event_type"], 0) + 1
        total.add(own)

    events.select("event_type").foreachPartition(count)
    return spark.createDataFrame(sorted(total.value.items()), "event_type string, n long")


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPLAIN as rows: the filter has reached the scan."""
    views(spark, sf_dir)
    plan = spark.sql("EXPLAIN FORMATTED SELECT l_orderkey FROM lineitem WHERE l_quantity < 10")
    return plan.select(F.col("plan").contains("LessThan(l_quantity,10.0)").alias("pushed"), F.regexp_extract("plan", r"ReadSchema: struct<([^>]*)>", 1).alias("columns"))


def databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("USE default")
    return spark.sql("SHOW DATABASES").where("namespace = 'default'").select("namespace", F.expr("current_database()").alias("now"))


def transform_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRANSFORM: rows through a program's lines."""
    views(spark, sf_dir)
    return spark.sql("SELECT CAST(k AS INT) AS k, name FROM (SELECT TRANSFORM (n_nationkey, n_name) USING 'cat' AS (k STRING, name STRING) FROM nation)")


# ---------------------------------------------------------------- DataFrame methods


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """select, selectExpr, where, withColumn, withColumnRenamed, drop, toDF, alias."""
    (part,) = _tables(spark, sf_dir, "part")
    rows = part.select("p_partkey", "p_size", "p_brand").where("p_size > 10").filter(F.col("p_size") < 40).withColumn("half", F.col("p_size") / 2)
    return rows.withColumnRenamed("p_brand", "brand").drop("p_size").selectExpr("p_partkey", "half * 2 AS size", "brand").alias("t").select("t.*").toDF("k", "size", "brand")


def groupings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """groupBy, cube, rollup, pivot and agg."""
    (orders,) = _tables(spark, sf_dir, "orders")
    one = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).select(F.lit("group").alias("kind"), F.col("o_orderstatus").alias("s"), "n")
    cube = orders.cube("o_orderstatus").count().select(F.lit("cube"), "o_orderstatus", "count")
    roll = orders.rollup("o_orderstatus").agg({"o_orderkey": "count"}).select(F.lit("rollup"), "o_orderstatus", "count(o_orderkey)")
    wide = orders.groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT"]).count().select(F.lit("pivot"), "o_orderstatus", F.coalesce("1-URGENT", F.lit(0)))
    return one.union(cube).union(roll).union(wide)


def joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join by name and expression, crossJoin, hint, joinWith's pairs of structs."""
    customer, nation, region = _tables(spark, sf_dir, "customer", "nation", "region")
    named = nation.withColumnRenamed("n_regionkey", "r_regionkey").join(region, "r_regionkey").hint("broadcast")
    pairs = customer.alias("c").join(named.alias("n"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.struct("c.*").alias("left"), F.struct("n.*").alias("right"))
    some = region.where("r_regionkey = 0").select("r_regionkey").crossJoin(F.broadcast(nation.select("n_nationkey")))
    return pairs.select(F.col("left.c_custkey").alias("k"), F.col("right.r_name").alias("name")).union(some.select(F.col("n_nationkey").cast("long"), F.lit("cross")))


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """union, unionByName, intersect, exceptAll, subtract, distinct, dropDuplicates."""
    customer, supplier, nation = _tables(spark, sf_dir, "customer", "supplier", "nation")
    c, s, n = customer.select(F.col("c_nationkey").alias("k")), supplier.select(F.col("s_nationkey").alias("k")), nation.select(F.col("n_nationkey").alias("k"))
    kinds = {"union": c.union(s), "by_name": c.unionByName(s).distinct(), "intersect": c.intersect(s), "subtract": n.subtract(s), "all": c.exceptAll(s), "duplicates": customer.dropDuplicates(["c_nationkey", "c_mktsegment"])}
    out = None
    for kind, rows in kinds.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.union(one)
    return out


def ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sort, orderBy, limit, take, head, first, sortWithinPartitions, repartition, coalesce."""
    (orders,) = _tables(spark, sf_dir, "orders")
    by = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    top = orders.orderBy(*by).limit(5).select(F.lit("limit").alias("kind"), "o_orderkey")
    few = [("take", r["o_orderkey"]) for r in orders.sort(*by).take(2)] + [("head", orders.sort(*by).head()["o_orderkey"]), ("first", orders.sort(*by).first()["o_orderkey"])]
    least = orders.repartition(4, "o_custkey").sortWithinPartitions("o_orderkey").coalesce(2).agg(F.min("o_orderkey").alias("o_orderkey")).select(F.lit("least"), "o_orderkey")
    return top.union(spark.createDataFrame(few, "kind string, o_orderkey long")).union(least)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, sampleBy and randomSplit: parts that lie within the whole, splits that make it up."""
    (orders,) = _tables(spark, sf_dir, "orders")
    keys = orders.select("o_orderkey", "o_orderstatus").cache()
    total = keys.count()
    a, b = keys.randomSplit([0.3, 0.7], 5)
    some, strata = keys.sample(0.5, 3), keys.stat.sampleBy("o_orderstatus", {"F": 1.0}, 3)
    rows = [("split", a.count() + b.count() == total), ("sample", 0 < some.count() < total), ("within", some.join(keys, "o_orderkey", "left_anti").count() == 0), ("strata", strata.count() == keys.where("o_orderstatus = 'F'").count())]
    keys.unpersist()
    return spark.createDataFrame(rows, "kind string, holds boolean")


def _median(df: DataFrame, column: str) -> float:
    """The least value that half of the rows don't exceed: approxQuantile bounds it, counts of the values between decide."""
    some = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    low, high = some.approxQuantile("v", [0.498, 0.502], 0.001)
    total, below = some.agg(F.count("*"), F.count_if(F.col("v") < low)).first()
    between = some.where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n"))
    running = between.withColumn("upto", F.sum("n").over(Window.orderBy("v")))  # a row for each value between
    return running.where(F.col("upto") + below >= (total + 1) // 2).agg(F.min("v")).first()[0]


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """describe, stat.corr, cov, freqItems and approxQuantile."""
    (item,) = _tables(spark, sf_dir, "lineitem")
    d = {r["summary"]: r["l_quantity"] for r in item.select("l_quantity").describe().collect()}
    q = _median(item, "l_quantity")
    frequent = item.freqItems(["l_returnflag"], 0.3).first()[0]
    rows = [("count", float(d["count"])), ("mean", round(float(d["mean"]), 6)), ("corr", round(item.stat.corr("l_quantity", "l_extendedprice"), 6)), ("cov", round(item.stat.cov("l_quantity", "l_discount"), 6)), ("median", q), ("frequent", float(len(set(frequent) & {"A", "N", "R"})) > 0 and 1.0)]
    return spark.createDataFrame(rows, "kind string, v double")


def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of priorities by status. The columns ``p`` and ``P`` differ by case alone, so the frame belongs to a session of its own that tells names by case."""
    own = spark.newSession()
    own.conf.set("spark.sql.caseSensitive", "true")
    (orders,) = _tables(own, sf_dir, "orders")
    return orders.stat.crosstab("o_orderpriority", "o_orderstatus").select(F.col("o_orderpriority_o_orderstatus").alias("p"), "F", "O", "P")


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """na.fill, na.replace and na.drop."""
    (nation,) = _tables(spark, sf_dir, "nation")
    holes = nation.select("n_nationkey", F.expr("nullif(n_regionkey, 2)").alias("r"), F.expr("CASE WHEN n_nationkey % 4 > 0 THEN n_name END").alias("name"))
    filled = holes.na.fill({"r": -1}).na.replace(["NATION_1"], ["one"], "name")
    return filled.na.drop(subset=["name"])


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mapInPandas, mapInArrow, applyInPandas, cogroup, and reduce by key: the typed operations of the API."""
    customer, supplier = _tables(spark, sf_dir, "customer", "supplier")

    def doubled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"k": f["k"], "v": 2 * f["v"]})

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        key = int(a["k"].iloc[0] if len(a) else b["k"].iloc[0])
        return pd.DataFrame({"k": [key], "customers": [int(a["n"].sum())], "suppliers": [int(b["n"].sum())]})

    # Counts first: what a group brings to its function is then one row for each task, whatever its size.
    c = customer.select(F.col("c_nationkey").alias("k"), F.lit(1).alias("v")).mapInPandas(doubled, "k int, v long").groupBy("k").agg((F.sum("v") / 2).cast("long").alias("n"))
    s = supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return c.groupBy("k").cogroup(s.groupBy("k")).applyInPandas(both, "k int, customers long, suppliers long")


def udfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar Arrow function, a row function registered for SQL, an aggregate and a table function."""
    views(spark, sf_dir)

    @F.pandas_udf("double")
    def squared(x: pd.Series) -> pd.Series:
        return x * x

    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    @F.udtf(returnType="n int, half double")
    class Halves:
        def eval(self, n: int):
            yield n, n / 2

    spark.udf.register("letters", lambda t: sum(c.isalpha() for c in t), "int")
    spark.udtf.register("halves", Halves)
    part = spark.table("part")
    ranges = part.groupBy("p_brand").agg(spread(F.col("p_size").cast("double")).alias("spread"))
    rows = part.join(ranges, "p_brand").select("p_partkey", squared(F.col("p_size").cast("double")).alias("sq"), F.expr("letters(p_brand)").alias("n"), "spread", "p_size")
    rows.createOrReplaceTempView("udf_rows")
    return spark.sql("SELECT p_partkey, sq, r.n AS n, spread, h.half AS half FROM udf_rows r, LATERAL halves(r.p_size) h")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """schema, columns, dtypes, isStreaming, inputFiles, toJSON, count and isEmpty."""
    (nation,) = _tables(spark, sf_dir, "nation")
    lines = nation.toJSON().count() if hasattr(nation, "toJSON") else nation.count()
    rows = [("columns", ",".join(nation.columns)), ("dtypes", ",".join(f"{a}:{b}" for a, b in nation.dtypes)), ("streaming", str(nation.isStreaming)), ("files", str(len(nation.inputFiles()) > 0)), ("rows", str(nation.count())), ("json", str(lines)), ("empty", str(nation.isEmpty()))]
    return spark.createDataFrame(rows, "kind string, v string")


def persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """persist and checkpoint(), the latter in the shared folder."""
    (orders,) = _tables(spark, sf_dir, "orders")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place(spark, "checkpoint"))
    kept = orders.groupBy("o_custkey").agg(F.count("*").alias("n")).persist()
    out = kept.where("n > 5").checkpoint()
    kept.unpersist()
    return out


QUERIES = {
    "cmd_create_insert": create_insert, "cmd_views": view_commands, "cmd_describe": describe, "cmd_show_columns": show_columns, "cmd_show_tables": show_tables, "cmd_alter_column": alter_column,
    "cmd_clear_cache": clear_cache, "cmd_refresh": refresh, "cmd_add_file": added_file, "api_foreach": for_each,
    "cmd_settings": settings, "cmd_functions": functions, "cmd_cache": caching, "cmd_explain": explain, "cmd_databases": databases, "cmd_transform": transform_script,
    "api_projections": projections, "api_groupings": groupings, "api_joins": joins, "api_sets": sets, "api_ordering": ordering, "api_samples": samples, "api_statistics": statistics, "api_crosstab": crosstab,
    "api_missing": missing, "api_typed": typed, "api_udfs": udfs, "api_metadata": metadata, "api_persisted": persisted,
}

_GROUPED = "SELECT '{0}' AS kind, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY {1}"
SQL = {
    "cmd_create_insert": "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT r_regionkey + 100, r_name FROM region",
    "cmd_views": "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION ALL SELECT r_regionkey + 100 FROM region",
    "cmd_describe": "SELECT column_name AS col_name, CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS data_type FROM (DESCRIBE nation)",
    "cmd_show_columns": "SELECT column_name AS col_name FROM (DESCRIBE part)",
    "cmd_show_tables": "SELECT DISTINCT name AS tableName FROM (SHOW TABLES) WHERE name IN ('region', 'nation', 'part')",
    "cmd_alter_column": "SELECT * FROM (VALUES ('k', 'the key'), ('v', NULL)) t(col_name, note)",
    "cmd_settings": "SELECT 'wayfold.example' AS key, '7' AS value",
    "cmd_functions": "SELECT p_partkey, 2 * p_size + 1 AS v, true AS shown FROM part",
    "cmd_cache": "SELECT n_regionkey AS k, count(*) AS n, true AS during, false AS later FROM nation GROUP BY n_regionkey",
    "cmd_clear_cache": "SELECT r_name, count(*) AS n, true AS during, false AS later FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "cmd_refresh": "SELECT p_brand, count(*) AS n, 1 AS stage FROM part WHERE p_partkey % 3 < 2 GROUP BY p_brand UNION ALL SELECT p_brand, count(*), 2 FROM part GROUP BY p_brand",
    "cmd_add_file": "SELECT n_name, r_name AS region, true AS listed FROM nation JOIN region ON n_regionkey = r_regionkey",
    "api_foreach": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "cmd_explain": "SELECT true AS pushed, 'l_orderkey:bigint,l_quantity:double' AS columns",
    "cmd_databases": "SELECT 'default' AS namespace, 'default' AS now",
    "cmd_transform": "SELECT n_nationkey AS k, n_name AS name FROM nation",
    "api_projections": "SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS size, p_brand AS brand FROM part WHERE p_size > 10 AND p_size < 40",
    "api_groupings": " UNION ALL ".join([_GROUPED.format("group", "o_orderstatus"), _GROUPED.format("cube", "CUBE (o_orderstatus)"), _GROUPED.format("rollup", "ROLLUP (o_orderstatus)"), "SELECT 'pivot', o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') FROM orders GROUP BY o_orderstatus"]),
    "api_joins": "SELECT c_custkey AS k, r_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, 'cross' FROM nation",
    "api_sets": """SELECT 'union' AS kind, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n
        UNION ALL SELECT 'by_name', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
        UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
        UNION ALL SELECT 'subtract', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)
        UNION ALL SELECT 'all', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
        UNION ALL SELECT 'duplicates', count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)""",
    "api_ordering": """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
        SELECT 'limit' AS kind, o_orderkey FROM r WHERE k <= 5 UNION ALL SELECT 'take', o_orderkey FROM r WHERE k <= 2
        UNION ALL SELECT unnest(['head', 'first']), o_orderkey FROM r WHERE k = 1 UNION ALL SELECT 'least', min(o_orderkey) FROM orders""",
    "api_samples": "SELECT unnest(['split', 'sample', 'within', 'strata']) AS kind, true AS holds",
    "api_statistics": """SELECT 'count' AS kind, CAST(count(*) AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 'mean', round(avg(l_quantity), 6) FROM lineitem
        UNION ALL SELECT 'corr', round(corr(l_quantity, l_extendedprice), 6) FROM lineitem UNION ALL SELECT 'cov', round(covar_samp(l_quantity, l_discount), 6) FROM lineitem
        UNION ALL SELECT 'median', quantile_disc(l_quantity, 0.5) FROM lineitem UNION ALL SELECT 'frequent', 1.0""",
    "api_crosstab": "SELECT o_orderpriority AS p, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
    "api_missing": "SELECT n_nationkey, coalesce(nullif(n_regionkey, 2), -1) AS r, CASE n_name WHEN 'NATION_1' THEN 'one' ELSE n_name END AS name FROM nation WHERE n_nationkey % 4 > 0",
    "api_typed": "SELECT coalesce(c.k, s.k) AS k, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k",
    "api_udfs": "SELECT p_partkey, CAST(p_size * p_size AS DOUBLE) AS sq, length(regexp_replace(p_brand, '[^A-Za-z]', '', 'g')) AS n, CAST(max(p_size) OVER w - min(p_size) OVER w AS DOUBLE) AS spread, p_size / 2 AS half FROM part WINDOW w AS (PARTITION BY p_brand)",
    "api_metadata": "SELECT * FROM (VALUES ('columns', 'n_nationkey,n_name,n_regionkey'), ('dtypes', 'n_nationkey:int,n_name:string,n_regionkey:int'), ('streaming', 'False'), ('files', 'True'), ('empty', 'False')) t(kind, v) UNION ALL SELECT unnest(['rows', 'json']), CAST(count(*) AS VARCHAR) FROM nation",
    "api_persisted": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5",
}
