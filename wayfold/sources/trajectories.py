"""Trajectories from text, events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRAJECTORY = "array<array<double>>"

#: The trajectories of ``from_events`` and ``from_orders`` in DuckDB.
EVENTS = """SELECT user_id AS id, list([value, (epoch_us(ts) % 86400000000) / 864000000.0] ORDER BY ts, event_id) AS traj
    FROM events GROUP BY user_id"""
ORDERS = """SELECT o_custkey AS id, list([o_totalprice / 5000.0, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) / 25.0]
    ORDER BY o_orderdate, o_orderkey)::DOUBLE[][] AS traj FROM orders GROUP BY o_custkey"""


def parse(text) -> F.Column:
    """``x,y;x,y`` as a trajectory; a line without points is an empty one."""
    points = F.filter(F.split(text, ";"), lambda p: F.length(F.trim(p)) > 0)
    return F.transform(points, lambda p: F.transform(F.split(p, ","), lambda c: c.cast("double")))


def render(column) -> F.Column:
    """The text of a trajectory."""
    return F.array_join(F.transform(column, lambda p: F.array_join(F.transform(p, lambda c: c.cast("string")), ",")), ";")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, traj): one trajectory for each line; ids are line numbers from 0 over all files, in the order of their paths.

    Files may be read in parts. A first pass counts the lines of each part; the
    lines before it are a running sum within its file and over the files before.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"))
    lines = lines.withColumn("place", F.monotonically_increasing_id())
    parts = lines.groupBy("file", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    in_file = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = parts.groupBy("file").agg(F.sum("n").alias("n")).select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(in_file), F.lit(0))).join(files, "file")
    parts = parts.select("file", "part", (F.col("base") + F.col("before") - F.col("first")).alias("shift"))
    return lines.join(parts, ["file", "part"]).select((F.col("place") + F.col("shift")).alias("id"), parse(F.col("value")).alias("traj"))


def write_text(df: DataFrame, path: str, column: str = "traj") -> None:
    df.select(render(F.col(column)).alias("value")).write.text(path)


def bounded(df: DataFrame, low: int, high: int, column: str = "traj") -> DataFrame:
    """Trajectories of low to high points."""
    return df.where(F.size(column).between(low, high))


def _gathered(points: DataFrame) -> DataFrame:
    ordered = points.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("o1", "o2", "x", "y"))).alias("s"))
    return ordered.select("id", F.transform("s", lambda s: F.array(s["x"], s["y"])).alias("traj"))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, traj) of each user: value, and time of day from 0 to 100."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.unix_micros("ts") % 86_400_000_000
    return _gathered(e.select(F.col("user_id").alias("id"), F.col("ts").alias("o1"), F.col("event_id").alias("o2"), F.col("value").alias("x"), (day / 864_000_000.0).alias("y")))


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, traj) of each customer: price and day of the orders, both about 0 to 100."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return _gathered(o.select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("o1"), F.col("o_orderkey").alias("o2"), (F.col("o_totalprice") / 5000.0).alias("x"), (days / 25.0).alias("y")))
