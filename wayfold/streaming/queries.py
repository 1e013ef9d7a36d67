"""Streaming queries over the event table: each drains what is there and returns the result as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.functions.shared import materialize
from wayfold.sources.files import place
from wayfold.sources.trajectories import ORDERS, from_orders
from wayfold.sources.trajectory_text import TrajectoryText
from wayfold.streaming.monitor import Progress, RowFiles


class Feed:
    """A folder that a stream reads, and the tables that arrive in it one after the other, each as one batch of any number of files."""

    def __init__(self, spark: SparkSession, tables: list[DataFrame]):
        self.path, self.tables = place(spark, "feed"), tables
        tables[0].write.parquet(self.path)  # a stream's folder has to be there
        self.stream = spark.readStream.schema(tables[0].schema).parquet(self.path)

    def arrivals(self) -> Iterator[None]:
        yield
        for table in self.tables[1:]:
            table.write.mode("append").parquet(self.path)
            yield


def drain(stream: DataFrame, mode: str, feed: Feed | None = None) -> DataFrame:
    """Run a stream over all that its source holds now; of a feed again after each arrival, from the checkpoint.

    Append results go to Parquet files with the sink's own log. Of complete
    results the last batch's is returned; of update results all batches' rows,
    with the number of the batch, since only the caller knows their key.
    """
    spark, where, last = stream.sparkSession, place(stream.sparkSession, "stream"), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/rows/batch={number}")
        last.append(number)

    for _ in feed.arrivals() if feed else (None,):
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/log").trigger(availableNow=True)
        writer = writer.format("parquet").option("path", f"{where}/rows") if mode == "append" else writer.foreachBatch(write)
        writer.start().awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{where}/rows")
    if not last:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{where}/rows/batch={max(last)}")
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{where}/rows")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return drain(counts, "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = events(spark, sf_dir).groupBy(F.window("ts", "1 day", "12 hours")).agg(F.count("*").alias("n"))
    return drain(counts, "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(spark, sf_dir).groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return drain(found, "complete").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def distinct_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(events(spark, sf_dir).select("user_id", "event_type").dropDuplicates(), "append")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream joined with a table."""
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    joined = events(spark, sf_dir).join(people, F.col("user_id") == F.col("c_custkey"))
    return drain(joined.groupBy("c_mktsegment").agg(F.count("*").alias("n")), "complete")


def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within an hour after a click of the same user: a join of two streams."""
    e = events(spark, sf_dir)
    clicks = e.where("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("ts").alias("at"), F.col("event_id").alias("click_id")).withWatermark("at", "1 hour")
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("buy_id")).withWatermark("ts", "1 hour")
    return drain(buys.join(clicks, F.expr("user_id = u AND ts >= at AND ts <= at + INTERVAL 1 HOUR")).select("click_id", "buy_id"), "append")


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arbitrary state: events and largest id of each user."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, top = state.get if state.exists else (0, -1)
        for f in frames:
            n, top = n + len(f), max(top, int(f["event_id"].max()))
        state.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_id": [top]})

    rows = events(spark, sf_dir).groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, last_id long", "n long, last_id long", "update", GroupStateTimeout.NoTimeout)
    return latest(drain(rows, "update"), "user_id")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Of update results the last row of each key."""
    columns = [c for c in rows.columns if c not in (key, "batch")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("last"))
    return last.select(key, *(F.col(f"last.{c}") for c in columns))


def in_parts(spark: SparkSession, sf_dir: str, parts: int = 4) -> Feed:
    """The events in several arrivals, by ranges of their ids."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    least, most = e.agg(F.min("event_id"), F.max("event_id")).first()
    part = F.floor((F.col("event_id") - least) * parts / (most - least + 1)) if least is not None else F.lit(0)
    return Feed(spark, [e.where(part == k) for k in range(parts)])


def updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode over several batches: the last count that each type was given."""
    feed = in_parts(spark, sf_dir)
    return latest(drain(feed.stream.groupBy("event_type").agg(F.count("*").alias("n")), "update", feed), "event_type")


def appended_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: windows that the watermark has passed, each once."""
    feed = in_parts(spark, sf_dir)
    counts = feed.stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    found = drain(counts, "append", feed).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")
    return found.agg(F.count("*").alias("windows"), F.max("n").alias("most"))


def late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come after the watermark are dropped: a batch of all events, one with the last moment again (late rows are
    told by the watermark that the batch before began with), then all events sixty days older."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    again = e.agg(F.max("event_id").alias("event_id"), F.max("ts").alias("ts"))
    feed = Feed(spark, [e, again, e.select("event_id", (F.col("ts") - F.expr("INTERVAL 60 DAYS")).alias("ts"))])
    counts = feed.stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return latest(drain(counts, "update", feed), "window").agg(F.sum("n").alias("rows"))


def distinct_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dropDuplicatesWithinWatermark: each user and type once within the span that the watermark keeps, here all."""
    feed = in_parts(spark, sf_dir)
    rows = feed.stream.withWatermark("ts", "1000 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return drain(rows.select("user_id", "event_type"), "append", feed)


def idle_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State with an event-time timeout: a user whose events stop is reported with their number, the rest when the stream goes on."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "n": [n]})
            return
        n, last = (state.get[0] if state.exists else 0), 0
        for f in frames:
            n, last = n + len(f), max(last, int(f["ts"].max().timestamp() * 1000))
        state.update((n,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        if False:
            yield

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    # One late row moves the watermark, another lets the timeouts fire.
    later = [e.agg(F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts")) for days in (400, 401)]
    feed = Feed(spark, [e, *later])
    rows = feed.stream.withWatermark("ts", "1 hour").groupBy("user_id").applyInPandasWithState(step, "user_id long, n long", "n long", "append", GroupStateTimeout.EventTimeTimeout)
    return drain(rows, "append", feed).where("user_id >= 0")


def trajectory_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectory text by its own stream source and sink: two arrivals, the second after a restart from the checkpoint."""
    spark.dataSource.register(TrajectoryText)
    where, o = place(spark, "trajectory-text"), from_orders(spark, sf_dir)
    for part in range(2):
        o.where(F.col("id") % 2 == part).write.format("trajectory_text").mode("append").save(f"{where}/in")
        stream = spark.readStream.format("trajectory_text").load(f"{where}/in")
        twice = stream.select(F.transform("traj", lambda p: F.transform(p, lambda c: c * 2)).alias("traj"))
        writer = twice.writeStream.format("trajectory_text").option("checkpointLocation", f"{where}/log").trigger(availableNow=True)
        writer.start(f"{where}/out").awaitTermination()
    back = spark.read.format("trajectory_text").load(f"{where}/out")
    return back.select(F.size("traj").alias("points"), F.round(F.aggregate("traj", F.lit(0.0), lambda s, p: s + p[0] + p[1]), 6).alias("total"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener heard of a stream in several batches: rows read and observed, and the ends of its runs."""
    feed, heard, runs = in_parts(spark, sf_dir), Progress(), []
    seen = feed.stream.observe("seen", F.count("*").alias("rows"), F.max("event_id").alias("last"), F.sum(F.col("event_type").eqNullSafe("click").cast("long")).alias("clicks"))
    where = place(spark, "progress")
    spark.streams.addListener(heard)
    try:
        for _ in feed.arrivals():
            query = seen.select("event_id").writeStream.option("checkpointLocation", f"{where}/log").trigger(availableNow=True).format("parquet").start(f"{where}/rows")
            query.awaitTermination()
            runs.append(query.runId)
        told = [event for run in runs for event in heard.of(run)]
    finally:
        spark.streams.removeListener(heard)
    batches = [data for kind, data in told if kind == "progress" and data["rows"]]
    observed = [b["observed"]["seen"] for b in batches]
    found = {
        "batches": len(batches), "rows": sum(b["rows"] for b in batches), "observed": sum(o["rows"] for o in observed), "clicks": sum(o["clicks"] or 0 for o in observed),
        "last": max(o["last"] for o in observed), "started": sum(k == "started" for k, _ in told), "ended": sum(k == "terminated" and not d["error"] for k, d in told),
    }
    return spark.createDataFrame(list(found.items()), "metric string, value long")


def foreach_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases by a row writer: open, process and close where the rows are."""
    where, feed = place(spark, "foreach"), in_parts(spark, sf_dir, 2)
    rows = feed.stream.where("event_type = 'purchase'").select("event_id", "user_id", "value")
    for _ in feed.arrivals():
        writer = rows.writeStream.foreach(RowFiles(f"{where}/rows")).option("checkpointLocation", f"{where}/log").trigger(availableNow=True)
        writer.start().awaitTermination()
    return spark.read.schema(rows.schema).json(f"{where}/rows")


def rate_to_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate source by micro-batch into the memory sink, with a processing-time trigger: values from 0 without gaps."""
    name = f"rate_{place(spark, 'm').rsplit('-', 1)[1]}"
    stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 10).load()
    query = stream.select("value").writeStream.format("memory").queryName(name).trigger(processingTime="200 milliseconds").start()
    try:
        while (query.lastProgress or {}).get("batchId", 0) < 2:
            query.awaitTermination(0.2)
            if query.exception():
                raise query.exception()
        found = materialize(spark.table(name), "rate")
    finally:
        query.stop()
    return found.agg((F.count("*") == F.max("value") + 1).alias("whole"), (F.countDistinct("value") == F.count("*")).alias("once"), (F.min("value") == 0).alias("first"))


QUERIES = {
    "stream_tumbling": tumbling,
    "stream_sliding": sliding,
    "stream_sessions": sessions,
    "stream_distinct": distinct_types,
    "stream_static_join": enriched,
    "stream_stream_join": stream_join,
    "stream_state": totals,
    "stream_update": updated,
    "stream_append_windows": appended_windows,
    "stream_late_rows": late,
    "stream_distinct_within": distinct_within,
    "stream_state_timeout": idle_users,
    "stream_rate_memory": rate_to_memory,
    "stream_trajectory_source": trajectory_source,
    "stream_progress": progress,
    "stream_foreach": foreach_rows,
}

SQL = {
    "stream_tumbling": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_distinct": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_sliding": "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS s FROM events) GROUP BY s",
    "stream_sessions": """SELECT user_id, sum(g) AS sessions, count(*) AS events FROM (SELECT user_id, CASE WHEN ts - lag(ts)
        OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6' HOUR THEN 0 ELSE 1 END AS g FROM events) GROUP BY user_id""",
    "stream_static_join": "SELECT c_mktsegment, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY c_mktsegment",
    "stream_stream_join": """SELECT a.event_id AS click_id, b.event_id AS buy_id FROM events a JOIN events b ON a.user_id = b.user_id
        AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR""",
    "stream_update": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_append_windows": """SELECT count(*) AS windows, max(n) AS most FROM (SELECT time_bucket(INTERVAL '1 day', ts) AS s, count(*) AS n FROM events GROUP BY 1)
        WHERE s + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""",
    "stream_late_rows": "SELECT CAST(count(*) + 1 AS BIGINT) AS rows FROM events",
    "stream_distinct_within": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_state_timeout": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
    "stream_rate_memory": "SELECT true AS whole, true AS once, true AS first",
    "stream_trajectory_source": f"SELECT len(traj) AS points, round(list_sum(flatten(traj)) * 2, 6) AS total FROM ({ORDERS})",
    "stream_progress": """SELECT unnest(['batches', 'rows', 'observed', 'clicks', 'last', 'started', 'ended']) AS metric,
        unnest([4, count(*), count(*), count(*) FILTER (event_type = 'click'), max(event_id), 4, 4]) AS value FROM events""",
    "stream_foreach": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'",
    "stream_state": "SELECT user_id, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY user_id",
}
