"""Trajectory text: line numbers, the data source for tables and streams, restarts; what streams tell of themselves."""

import os
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions.shipping import ship
from wayfold.sources.trajectories import read_text, write_text
from wayfold.sources.trajectory_text import TrajectoryText, Written, StreamWriter, names, parse_line
from wayfold.streaming.monitor import Progress, RowFiles

SCHEMA = "id long, traj array<array<double>>"


@pytest.fixture(scope="module")
def source(spark):
    ship(spark)
    spark.dataSource.register(TrajectoryText)
    return spark


def rows(n, seed=1):
    r = random.Random(seed)
    return [(i, [[round(r.uniform(-9, 9), 3), float(i)] for _ in range(r.randint(0, 4))]) for i in range(n)]


def test_line_numbers_over_parts_and_files(spark, tmp_path):
    """Files read in many parts, and several files: numbers from 0, in the order of paths."""
    path = str(tmp_path / "lines")
    write_text(spark.createDataFrame(rows(3000), SCHEMA).repartitionByRange(3, "id").sortWithinPartitions("id"), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = read_text(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 6
        assert sorted((r["id"], r["traj"]) for r in found.collect()) == rows(3000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.txt").write_text("")
    assert read_text(spark, str(tmp_path / "none")).count() == 0


def test_batch_source_and_sink(source, tmp_path):
    path = str(tmp_path / "t")
    frame = source.createDataFrame(rows(200), SCHEMA)
    frame.repartition(3).write.format("trajectory_text").mode("append").save(path)
    found = source.read.format("trajectory_text").load(path)
    assert found.columns == ["file", "line", "traj"] and sorted(r["traj"] for r in found.collect()) == sorted(t for _, t in rows(200))
    whole = found.groupBy("file").agg(F.count("*").alias("n"), F.max("line").alias("top"), F.countDistinct("line").alias("lines"))
    assert all(r["n"] == r["top"] + 1 == r["lines"] for r in whole.collect()) and whole.count() == len(names(path))
    frame.limit(5).write.format("trajectory_text").mode("append").save(path)
    assert source.read.format("trajectory_text").load(path).count() == 205
    frame.limit(5).coalesce(1).write.format("trajectory_text").mode("overwrite").save(path)
    assert source.read.format("trajectory_text").load(path).count() == 5
    assert not [n for n in os.listdir(path) if n.startswith(".") and not n.endswith(".crc")]
    (tmp_path / "t" / "zz.txt").write_text("1,2;3,4\n1,two\n")
    with pytest.raises(Exception, match="line 1 of zz.txt"):
        source.read.format("trajectory_text").load(path).collect()
    assert parse_line("") == [] and parse_line("1,2;; 3,4 ;") == [[1.0, 2.0], [3.0, 4.0]]
    assert source.read.format("trajectory_text").load(str(tmp_path / "nothing")).count() == 0


def run_stream(spark, where):
    stream = spark.readStream.format("trajectory_text").load(f"{where}/in").where("size(traj) > 0").select("traj")
    query = stream.writeStream.format("trajectory_text").option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start(f"{where}/out")
    query.awaitTermination()
    return sorted(r["traj"] for r in spark.read.format("trajectory_text").load(f"{where}/out").collect())


def test_stream_restarts_from_its_checkpoint(source, tmp_path):
    """Each line once: over arrivals, after a restart, and after a batch whose commit was lost is run again."""
    where = str(tmp_path)
    os.makedirs(f"{where}/in")

    def arrive(name, part):
        with open(f"{where}/in/{name}", "w") as f:
            f.writelines(";".join(",".join(map(str, p)) for p in t) + "\n" for _, t in part)

    wanted = lambda n: sorted(t for _, t in rows(n) if t)
    arrive("a.txt", rows(40)[:20])
    assert run_stream(source, where) == wanted(20)
    arrive("b.txt", rows(40)[20:30])
    arrive("c.txt", rows(40)[30:])
    assert run_stream(source, where) == wanted(40) == run_stream(source, where)
    last = max(int(n) for n in os.listdir(f"{where}/log/commits") if n.isdigit())
    for n in (str(last), f".{last}.crc"):  # the driver ended after the sink's commit and before Spark's own
        if os.path.exists(f"{where}/log/commits/{n}"):
            os.remove(f"{where}/log/commits/{n}")
    assert run_stream(source, where) == wanted(40)


def test_sink_takes_back_what_an_attempt_left(tmp_path):
    path = str(tmp_path / "o")
    os.makedirs(path)
    for n, text in (("batch-0000000003-00000.txt", "9,9\n"), (".h1", "1,1\n"), (".h2", "2,2\n")):
        (tmp_path / "o" / n).write_text(text)
    assert names(path) == []  # no mark
    sink = StreamWriter(path)
    sink.commit([Written(".h1"), None, Written(None)], 3)
    assert names(path) == ["batch-0000000003-00000.txt"] and (tmp_path / "o" / names(path)[0]).read_text() == "1,1\n"
    sink.commit([Written(".h2")], 3)  # the batch comes again
    assert (tmp_path / "o" / names(path)[0]).read_text() == "1,1\n" and not (tmp_path / "o" / ".h2").exists()
    (tmp_path / "o" / ".h4").write_text("4,4\n")
    sink.abort([Written(".h4")], 4)
    assert len(names(path)) == 1 and not (tmp_path / "o" / ".h4").exists()


def test_row_files_replace_their_own(tmp_path):
    from pyspark.sql import Row

    path = str(tmp_path / "rows")
    for values, error in (([1, 2], None), ([3], ValueError()), ([4, 5, 6], None)):
        writer = RowFiles(path)
        assert writer.open(2, 7)
        for v in values:
            writer.process(Row(v=v))
        writer.close(error)
    assert os.listdir(path) == ["0000000007-00002.json"]
    assert (tmp_path / "rows" / "0000000007-00002.json").read_text().count("\n") == 3


def test_listener_hears_a_failure(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.json").write_text('{"v": 1}\n')
    heard = Progress()
    spark.streams.addListener(heard)
    try:
        stream = spark.readStream.schema("v long").json(str(tmp_path / "in")).select(F.expr("raise_error('stop')"))
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "log")).start()
        with pytest.raises(Exception):
            query.awaitTermination()
        told = heard.of(query.runId)
    finally:
        spark.streams.removeListener(heard)
    assert told[0][0] == "started" and told[-1][0] == "terminated" and "stop" in told[-1][1]["error"]
