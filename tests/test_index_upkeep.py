"""Indexes that take in added files, and that outlive an application."""

import random

import pytest
from pyspark.sql import functions as F

from test_trajectory import SCHEMA, brute, sample
from wayfold.operators import index, join, search

QUERY = [[10.0, 10.0], [50.0, 60.0], [90.0, 20.0]]
BARS = {"DTW": 150.0, "FRECHET": 60.0, "EDR": 3.0, "LCSS": 3.0}


def grown(seed, n, first=0):
    return [(None if i % 9 == 5 else first + i, t) for i, t in sample(seed, n)]


def write(spark, rows, path, parts=2):
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.mode("append").parquet(path)


def files_read(df):
    """Files that the scans of a frame that was run have read."""

    def scans(plan):
        if "AdaptiveSparkPlan" in plan.nodeName():
            plan = plan.executedPlan()
        if plan.metrics().contains("numFiles"):
            yield plan.metrics().apply("numFiles").value()
        below = plan.children()
        for k in range(below.size()):
            yield from scans(below.apply(k))

    df._jdf.collect()
    return sum(scans(df._jdf.queryExecution().executedPlan()))


def same_as_brute(frame, rows):
    for name, bar in BARS.items():
        got = sorted(str(r["id"]) for r in search.threshold_search(frame, QUERY, "traj", name, bar).collect())
        assert got == sorted(str(i) for i, t in rows if t and brute(name, t, QUERY) <= bar)


def test_added_files_are_taken_in(spark, tmp_path):
    """Null and repeated ids, empty trajectories, paths with odd characters; only added files are read, and rows keep numbers of their own."""
    path, rows = f"{tmp_path}/a b%c", grown(1, 60)
    write(spark, rows, path, 3)
    read = lambda: spark.read.parquet(path).where("id IS NULL OR id >= 0").select("traj", "id")
    index.create_index(read(), "traj", "grown", 16)
    try:
        assert index.refresh_index(read(), "traj") == "same"
        for seed in (2, 3):
            known, more = index._indexes[index._key(read(), "traj")].files, grown(seed, 20)
            write(spark, more, path)
            rows += more
            assert index.lookup(read(), "traj") is None
            added = index._added(read(), known, index._listed(read()))
            assert files_read(added) == 2 and added.count() == len(more)
            assert index.refresh_index(read(), "traj") == "extended"
            found = index.lookup(read(), "traj")
            assert sum(t["n"] for t in found.tiles) == found.data.count() == sum(bool(t) for _, t in rows)
            assert found.data.select(index.ROW).distinct().count() == found.data.count()
            same_as_brute(read(), rows)
        # The merged rows of tiles are those of all their rows; a pivot's box counts where each row of the tile has it.
        counting = lambda tiles: [{k: v for k, v in t.items() if k[:5] != "pivot" or k == "pivots" or int(k[5]) < t["pivots"]} for t in tiles]
        assert counting(found.tiles) == counting(index._tile_rows(found.data, found.dims))
        pairs = join.threshold_join(read(), read(), "traj", "traj", "FRECHET", 25.0).collect()
        whole = [t for _, t in rows if t]
        assert len(pairs) == sum(brute("FRECHET", a, b) <= 25.0 for a in whole for b in whole)
    finally:
        index.drop_index(read(), "traj")


def test_built_anew_where_it_cannot_grow(spark, tmp_path):
    """Many rows, files that went, and rows that don't come from one file each."""
    path, rows = str(tmp_path / "t"), grown(4, 20)
    write(spark, rows, path)
    read = lambda: spark.read.parquet(path)
    index.create_index(read(), "traj", "small", 4)
    more = grown(5, 40)
    write(spark, more, path)
    assert index.refresh_index(read(), "traj") == "built"
    same_as_brute(read(), rows + more)
    rows = grown(6, 30)
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(path)
    assert index.refresh_index(read(), "traj") == "built"
    same_as_brute(read(), rows)
    index.drop_index(read(), "traj")
    with pytest.raises(ValueError):
        index.refresh_index(read(), "traj")
    for frame in (
        lambda: read().groupBy("id").agg(F.max("traj").alias("traj")),
        lambda: read().dropDuplicates(),
        lambda: read().withColumn("r", F.monotonically_increasing_id()),
        lambda: read().limit(5),
        lambda: read().unionAll(read()),
        lambda: read().where("id IN (SELECT max(id) FROM range(9))"),
    ):
        assert index._added(frame(), frozenset(), index._listed(frame())) is None


def test_table_grows(spark):
    """A partitioned table of the catalogue, by INSERT."""
    name, rows = f"grown_{random.randrange(10**9)}", grown(7, 40)
    spark.createDataFrame(rows, SCHEMA).withColumn("k", F.size("traj") % 2).write.partitionBy("k").format("parquet").saveAsTable(name)
    try:
        index.create_index(name, "traj", name, 8, spark=spark)
        more = grown(8, 20)
        spark.createDataFrame(more, SCHEMA).withColumn("k", F.size("traj") % 2).write.insertInto(name)
        assert index.lookup(spark.table(name), "traj") is None
        assert index.refresh_index(name, "traj", spark=spark) == "extended"
        same_as_brute(spark.table(name), rows + more)
        index.drop_index(name, "traj", spark=spark)
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_index_outlives_its_application(spark, tmp_path):
    path, kept, rows = str(tmp_path / "t"), str(tmp_path / "kept"), grown(9, 60)
    write(spark, rows, path)
    read = lambda: spark.read.parquet(path)
    index.create_index(read(), "traj", "kept", 16, path=kept)
    tiles = index.lookup(read(), "traj").tiles
    index._indexes.clear()  # as another application starts
    assert index.lookup(read(), "traj") is None
    with pytest.raises(ValueError, match="open_index"):
        index.create_index(read(), "traj", "kept", path=kept)
    with pytest.raises(ValueError, match="another frame"):
        index.open_index(read().where("id > 3"), kept)
    with pytest.raises(ValueError, match="no index"):
        index.open_index(read(), str(tmp_path / "none"))
    assert index.open_index(read(), kept) == "kept"
    assert index.lookup(read(), "traj").tiles == tiles
    same_as_brute(read(), rows)
    # Added while no application had the index; an extension that was lost before its manifest is written over.
    index.close_index(read(), "traj")
    more = grown(10, 20)
    write(spark, more, path)
    spark.read.parquet(f"{kept}/rows/{index.PART}=0").write.parquet(f"{kept}/rows/{index.PART}=1")
    index.open_index(read(), kept)
    assert index.lookup(read(), "traj") is None
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    assert index.refresh_index(read(), "traj") == "extended"
    spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    index.close_index(read(), "traj")
    index.open_index(read(), kept)
    same_as_brute(read(), rows + more)
    # Built anew in its place, and opened once more.
    rows = grown(11, 25)
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(path)
    assert index.refresh_index(read(), "traj") == "built"
    index._indexes.clear()
    index.open_index(read(), kept)
    same_as_brute(read(), rows)
    index.drop_index(read(), "traj")
    with pytest.raises(ValueError, match="no index"):
        index.open_index(read(), kept)


def test_empty_frames(spark, tmp_path):
    path, kept = str(tmp_path / "t"), str(tmp_path / "kept")
    write(spark, [(1, []), (2, None)], path)
    read = lambda: spark.read.parquet(path)
    index.create_index(read(), "traj", "none", path=kept)
    same_as_brute(read(), [])
    index.close_index(read(), "traj")
    index.open_index(read(), kept)
    rows = grown(12, 10)
    write(spark, rows, path)
    assert index.refresh_index(read(), "traj") == "built"
    same_as_brute(read(), rows)
    index.drop_index(read(), "traj")


def test_index_without_a_path_is_not_closed(spark, tmp_path):
    path = str(tmp_path / "t")
    write(spark, grown(13, 5), path)
    index.create_index(spark.read.parquet(path), "traj", "own")
    with pytest.raises(ValueError, match="without a path"):
        index.close_index(spark.read.parquet(path), "traj")
    index.drop_index(spark.read.parquet(path), "traj")
