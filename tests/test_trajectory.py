"""Distances, searches, joins, indexes and SQL against brute force."""

import datetime
import math
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from wayfold.functions.distance import NAMES, distance, native_distance
from wayfold.operators import index, join, search
from wayfold.plans import trajectory_queries as queries
from wayfold.plans.sql import TrajectorySession
from wayfold.sources.trajectories import parse, read_text, write_text

EPS, DELTA = 25.0, 8
SCHEMA = "id long, traj array<array<double>>"


def brute(name, a, b):
    if not a or not b:
        return None
    d = [[math.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1])) for q in b] for p in a]
    m, n = len(a), len(b)
    if name in ("DTW", "FRECHET"):
        t = {}
        for i in range(m):
            for j in range(n):
                near = [t[x] for x in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x in t] or [0.0]
                t[i, j] = d[i][j] + min(near) if name == "DTW" else max(d[i][j], min(near))
        return t[m - 1, n - 1]
    t = [[0.0] * (n + 1) for _ in range(m + 1)]
    for i in range(m + 1):
        for j in range(n + 1):
            if name == "EDR":
                t[i][j] = max(i, j) if not i or not j else min(t[i - 1][j - 1] + (d[i - 1][j - 1] > EPS), t[i - 1][j] + 1, t[i][j - 1] + 1)
            elif i and j:
                t[i][j] = t[i - 1][j - 1] + 1 if d[i - 1][j - 1] <= EPS and abs(i - j) <= DELTA else max(t[i - 1][j], t[i][j - 1])
    return float(t[m][n]) if name == "EDR" else float(max(m, n) - t[m][n])


def sample(seed=1, n=40):
    r = random.Random(seed)
    rows = [(i, [[r.uniform(0, 100), r.uniform(0, 100)] for _ in range(r.randint(1, 12))]) for i in range(n)]
    rows[1] = (1, [list(p) for p in rows[0][1]])
    rows[2] = (2, rows[0][1][::-1])
    return [*rows, (n, []), (n + 1, None)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(sample(), SCHEMA).cache()


QUERY = [[10.0, 10.0], [50.0, 60.0], [90.0, 20.0]]


def test_hand_case(spark):
    row = spark.createDataFrame([([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]], [[0.0, 0.0], [2.0, 2.0]])], "a array<array<double>>, b array<array<double>>")
    got = row.select(*(distance(n, "a", "b", 0.5, 1).alias(n) for n in NAMES)).first()
    assert got["DTW"] == pytest.approx(math.sqrt(2)) and got["FRECHET"] == pytest.approx(math.sqrt(2)) and got["EDR"] == 1 and got["LCSS"] == 1


@pytest.mark.parametrize("name", NAMES)
def test_distances(frame, name):
    pairs = frame.alias("x").crossJoin(frame.alias("y").where("id < 12 OR id >= 40")).select(F.col("x.traj").alias("a"), F.col("y.traj").alias("b"))
    for r in pairs.select("a", "b", distance(name, "a", "b").alias("d"), native_distance(name, "a", "b").alias("n")).collect():
        want = brute(name, r["a"], r["b"])
        assert r["d"] == r["n"] == want, (name, r)


@pytest.mark.parametrize("name,bar", [("DTW", 300.0), ("FRECHET", 60.0), ("EDR", 5.0), ("LCSS", 5.0)])
@pytest.mark.parametrize("indexed", [False, True])
def test_searches(frame, name, bar, indexed):
    if indexed:
        index.create_index(frame, "traj", "own")
    try:
        want = {i: brute(name, t, QUERY) for i, t in sample() if t}
        got = {r["id"]: r["distance"] for r in search.threshold_search(frame, QUERY, "traj", name, bar).collect()}
        assert got == {i: d for i, d in want.items() if d <= bar}
        near = [(r["distance"], r["id"]) for r in search.knn_search(frame, QUERY, "traj", name, 7).collect()]
        assert sorted(near) == sorted((d, i) for i, d in want.items())[:7]
    finally:
        index.drop_index(frame, "traj")


@pytest.mark.parametrize("name,bar", [("DTW", 250.0), ("FRECHET", 50.0), ("EDR", 4.0), ("LCSS", 4.0)])
def test_joins(frame, name, bar):
    rows = [(i, t) for i, t in sample() if t]
    want = {(i, j): brute(name, a, b) for i, a in rows for j, b in rows}
    got = {(r[0], r[1]): r[2] for r in join.threshold_join(frame, frame, "traj", "traj", name, bar).collect()}
    assert got == {k: d for k, d in want.items() if d <= bar}
    near = sorted((r[0], r[2], r[1]) for r in join.knn_join(frame, frame, "traj", "traj", name, 3).collect())
    assert near == sorted(x for i, _ in rows for x in sorted((i, want[i, j], j) for j, _ in rows)[:3])


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """A folder with orders of nine customers, one of them hot, and their trajectories."""
    r, start = random.Random(3), datetime.datetime(1995, 1, 1)
    rows, trajectories = [], {}
    for customer, n in enumerate((1001, 14, 14, 20, 13, 9, 5, 2, 1)):
        own = sorted((r.randrange(2500), len(rows) + k, r.uniform(0, 500_000)) for k in range(n))
        rows += [(key, customer, price, start + datetime.timedelta(days=day)) for day, key, price in own]
        trajectories[customer] = [[price / 5000, day / 25] for day, _, price in own]
    path = str(tmp_path_factory.mktemp("orders"))
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{path}/orders.parquet")
    return path, trajectories


@pytest.mark.parametrize("name", NAMES)
def test_registered_joins(spark, orders, name):
    """The joins named in QUERIES, of all trajectories."""
    path, t = orders
    all_ = {(i, j): brute(name, t[i], t[j]) for i in t for j in t if i != j}
    for query, pairs in ((f"traj_threshold_join_{name.lower()}", lambda i, j: i < j), (f"traj_whole_join_{name.lower()}", lambda i, j: i % 2 < j % 2)):
        got = {(r[0], r[1]): r[2] for r in queries.QUERIES[query](spark, path).collect()}
        assert got == {k: pytest.approx(d, abs=1e-6) for k, d in all_.items() if d <= queries.JOIN_BARS[name] and pairs(*k)}


def test_joins_of_repeated_and_null_ids(spark):
    """Rows count by themselves: k for each left row, whatever its id."""
    rows = [(i % 3 if i % 5 else None, t) for i, t in sample(3, 25)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    usable = [(i, t) for i, t in rows if t]
    near = join.knn_join(frame, frame, "traj", "traj", "DTW", 4).collect()
    assert len(near) == 4 * len(usable)
    key = lambda i: (i is None, i or 0)
    want = sorted((key(i), d) for i, t in usable for d in sorted(brute("DTW", t, u) for _, u in usable)[:4])
    assert sorted((key(r[0]), r[2]) for r in near) == want
    got = sorted((key(r[0]), key(r[1]), r[2]) for r in join.threshold_join(frame, frame, "traj", "traj", "FRECHET", 50.0).collect())
    assert got == sorted((key(i), key(j), d) for i, t in usable for j, u in usable if (d := brute("FRECHET", t, u)) <= 50)


def test_nearest_join_with_outliers(spark, monkeypatch):
    """Left rows far from all others, one of them ten thousand times as far as the rest lie apart."""
    r = random.Random(9)
    near = lambda i: (i, [[r.uniform(0, 1), r.uniform(0, 1)] for _ in range(3)])
    right = [near(i) for i in range(60)]
    left = [near(100 + i) for i in range(50)] + [(200, [[400.0, 400.0]]), (201, [[1e4, -1e4], [1e4, -1e4]])]
    monkeypatch.setattr(index, "TILE_ROWS", 5)
    monkeypatch.setattr(join, "BLOCK", 4)
    for name in NAMES:
        found = join.knn_join(*(spark.createDataFrame(x, SCHEMA) for x in (left, right)), "traj", "traj", name, 3).collect()
        want = sorted(x for i, t in left for x in sorted((i, brute(name, t, u), j) for j, u in right)[:3])
        assert sorted((x[0], x[2], x[1]) for x in found) == want
    few = join.knn_join(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right[:2], SCHEMA), "traj", "traj", "DTW", 5)
    assert few.count() == 2 * len(left)


@pytest.mark.parametrize("dims", [1, 3])
def test_other_dimensions(spark, dims):
    r = random.Random(dims)
    rows = [(i, [[r.uniform(0, 50) for _ in range(dims)] for _ in range(r.randint(1, 6))]) for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    far = lambda a, b: frechet(a, b)

    def frechet(a, b):
        t = {}
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                near = [t[x] for x in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x in t] or [0.0]
                t[i, j] = max(math.dist(p, q), min(near))
        return t[len(a) - 1, len(b) - 1]

    want = {(i, j): far(t, u) for i, t in rows for j, u in rows}
    got = {(x[0], x[1]): x[2] for x in join.threshold_join(frame, frame, "traj", "traj", "FRECHET", 20.0).collect()}
    assert got == {k: pytest.approx(d) for k, d in want.items() if d <= 20}
    index.create_index(frame, "traj", "dims")
    try:
        found = search.threshold_search(frame, rows[3][1], "traj", "FRECHET", 20.0).collect()
        assert {x["id"] for x in found} == {j for (i, j), d in want.items() if i == 3 and d <= 20}
    finally:
        index.drop_index(frame, "traj")


def test_points_of_mixed_dimensions_are_refused(spark):
    frame = spark.createDataFrame([(1, [[1.0, 2.0]]), (2, [[1.0, 2.0, 3.0, 4.0]])], SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="one number of coordinates"):
        frame.select(distance("DTW", "traj", "traj")).collect()


def test_tiles_are_even(spark):
    """Along a diagonal, in clusters and all over: no tile holds over twice its share; coinciding points share one."""
    import numpy as np

    from wayfold.operators.tiling import fan_outs, tiling

    r = np.random.default_rng(1)
    line = r.uniform(0, 1, 20_000)
    shapes = [np.stack([line, line + r.normal(0, 1e-4, len(line))], 1), r.normal(0, 1, (20_000, 2)) + 50 * r.integers(0, 3, (20_000, 1)), r.uniform(0, 1, (20_000, 2))]
    for points in shapes:
        for tiles in (1, 7, 16, 100):
            own = tiling(points, tiles, [2]).place(points)
            n = np.bincount(own)
            assert n.max() * len(n) <= 2 * len(points) and tiles <= len(n) <= max(2 * tiles, 1)
    assert fan_outs(27, [3]) == [3, 3, 3] and fan_outs(16, [2, 2]) == [2, 2, 2, 2] and fan_outs(1, [2]) == [1, 1]
    same = np.full((100, 2), 7.0)
    assert set(tiling(same, 16, [2]).place(same)) == {0}
    assert tiling(np.zeros((0, 2)), 16, [2]).place(np.array([[3.0, np.nan]])).tolist() == [0]
    cut = tiling(np.array([[0.0], [1.0], [2.0], [3.0]]), 2, [1])
    assert cut.place(np.array([[1.9], [2.0], [-9.0], [np.inf]])).tolist() == [0, 1, 0, 1]


def test_pivot_levels_cut_the_folders_read(spark):
    """Trajectories with the same ends and different ways between them: only the pivots tell their tiles apart."""
    r = random.Random(2)
    rows = []
    for i in range(600):
        x, y = r.choice([(0, 90), (90, 0), (90, 90), (45, 45)])
        rows.append((i, [[r.random(), r.random()], [x + r.random(), y + r.random()], [x + 2 * r.random(), y + r.random()], [5 + r.random(), 5 + r.random()]]))
    frame, query = spark.createDataFrame(rows, SCHEMA), rows[0][1]
    index.create_index(frame, "traj", "ways", 16)
    try:
        tiles = index.lookup(frame, "traj").tiles
        for name, bar in (("DTW", 30.0), ("FRECHET", 20.0), ("EDR", 0.0), ("LCSS", 0.0)):
            by_ends, by_all = ([t for t in tiles if search.tile_bound(t, query, name, bar, levels=n) <= bar] for n in (2, 3))
            assert 0 < len(by_all) <= len(by_ends) / 2
            got = {x["id"] for x in search.threshold_search(frame, query, "traj", name, bar).collect()}
            assert got == {i for i, t in rows if brute(name, t, query) <= bar} and got
    finally:
        index.drop_index(frame, "traj")


def test_tile_pairs_that_cannot_join_never_meet(spark):
    """Bounds of pairs of tiles lie below every distance of their rows, and far tiles are left out."""
    r = random.Random(6)
    walk = lambda x, y: [[x + r.uniform(0, 3) * k, y + r.uniform(0, 3) * k] for k in range(5)]
    rows = [(i, walk(r.uniform(0, 900), r.uniform(0, 900))) for i in range(150)]
    frame = spark.createDataFrame(rows, SCHEMA)
    index.create_index(frame, "traj", "pairs", 32)
    try:
        side = index.lookup(frame, "traj")
        tile = {x["id"]: [t[index.TILE] for t in side.tiles].index(x[index.TILE]) for x in side.data.select("id", index.TILE).collect()}
        for name in NAMES:
            bounds = join.tile_distances(side, side, name, EPS)
            for i, t in rows[:40]:
                for j, u in rows[:40]:
                    assert bounds[tile[i], tile[j]] <= brute(name, t, u) + 1e-6
        assert (join.tile_distances(side, side, "DTW", EPS) <= 30).mean() < 0.3
        want = {(i, j) for i, t in rows for j, u in rows if brute("DTW", t, u) <= 90}
        assert {(x[0], x[1]) for x in join.threshold_join(frame, frame, "traj", "traj", "DTW", 90.0).collect()} == want
        single = [(x[0], x[1]) for x in join.threshold_join(frame, frame, "traj", "traj", "DTW", 90.0, once=True).collect()]
        assert sorted((min(p), max(p)) for p in single) == sorted((i, j) for i, j in want if i < j)
    finally:
        index.drop_index(frame, "traj")


def test_index_knows_its_files(spark, tmp_path):
    """After an append the index isn't used; made anew it holds the new rows."""
    path = str(tmp_path / "t")
    here, there = [[10.0, 10.0], [50.0, 60.0]], [[900.0, 900.0]]
    spark.createDataFrame([(1, here), (2, there)], SCHEMA).write.parquet(path)
    find = lambda: sorted(x["id"] for x in search.threshold_search(spark.read.parquet(path), here, "traj", "DTW", 5.0).collect())
    index.create_index(spark.read.parquet(path), "traj", "files")
    assert index.lookup(spark.read.parquet(path), "traj") is not None and find() == [1]
    spark.createDataFrame([(3, here), (4, there)], SCHEMA).write.mode("append").parquet(path)
    assert index.lookup(spark.read.parquet(path), "traj") is None and find() == [1, 3]
    index.create_index(spark.read.parquet(path), "traj", "files")
    assert index.lookup(spark.read.parquet(path), "traj") is not None and find() == [1, 3]
    spark.createDataFrame([(5, here)], SCHEMA).write.mode("overwrite").parquet(path)
    assert find() == [5]
    index.drop_index(spark.read.parquet(path), "traj")
    assert index.show_indexes(spark).count() == 0


def test_sql_by_row_with_and_without_index(spark):
    """Repeated and null ids give the same rows with an index as without."""
    here, there = [[10.0, 10.0], [50.0, 60.0]], [[90.0, 90.0]]
    spark.createDataFrame([(1, here), (1, there), (2, here), (None, here), (None, there), (3, []), (4, None)], SCHEMA).createOrReplaceTempView("by_row")
    s, q = TrajectorySession(spark), "TRAJECTORY(POINT(10, 10), POINT(50, 60))"
    texts = {
        f"SELECT id FROM by_row WHERE DTW(traj, {q}) <= 1": [1, 2, None],
        f"SELECT id FROM by_row t WHERE 1 >= DTW(t.traj, {q}) AND t.id BETWEEN 0 AND 1": [1],
        f"SELECT id FROM by_row WHERE FRECHET(traj, {q}) < 0": [],
        f"SELECT id FROM by_row WHERE DTW(traj, {q}) <= 1 OR id = 3": [1, 2, 3, None],
        f"SELECT id FROM by_row WHERE NOT (DTW(traj, {q}) <= 1)": [1, None],
        f"SELECT id FROM by_row WHERE DTW(traj, {q}) KNN 3": [1, 2, None],
        f"SELECT id FROM by_row WHERE DTW(traj, {q}) KNN 3 AND id > 0 ORDER BY id": [1, 2],
        "SELECT id FROM by_row WHERE traj IN MBRRANGE(POINT(0, 0), POINT(60, 60))": [1, 2, None],
        "SELECT id FROM by_row WHERE traj IN CIRCLERANGE(POINT(90, 90), 1) AND id IS NULL": [None],
        f"SELECT count(*) FROM (SELECT id FROM by_row WHERE DTW(traj, {q}) <= 1) t": [3],
        f"SELECT id FROM by_row WHERE DTW(traj, {q}) <= 1 UNION ALL SELECT id FROM by_row WHERE EDR(traj, {q}) KNN 1": [1, 1, 2, None],
        f"WITH by_row AS (SELECT 9 AS id, {q} AS traj) SELECT id FROM by_row WHERE DTW(traj, {q}) <= 1": [9],
    }
    key = lambda x: (x is None, x or 0)
    joined = "SELECT * FROM by_row a JOIN by_row b ON DTW(a.traj, b.traj) <= 1"
    for made in (False, True):
        if made:
            s.sql("CREATE TRIE INDEX rows_ ON by_row (traj)")
        for text, want in texts.items():
            assert sorted((x[0] for x in s.sql(text).collect()), key=key) == want, (made, text)
        pairs = s.sql(joined)
        assert pairs.columns == ["id", "traj", "id", "traj"] and pairs.count() == 9 + 4
        assert s.sql(joined.replace("<=", "<").replace("<= 1", "< 1")).count() == 13
        assert s.sql(joined.replace("<= 1", "KNN 2")).count() == 10
    s.sql("DROP TRIE INDEX rows_ ON by_row")
    for text in (f"SELECT id FROM by_row WHERE DTW(traj, {q}) KNN 3 OR id = 1", f"SELECT DTW(traj, {q}) KNN 3 FROM by_row", f"SELECT id FROM (SELECT * FROM by_row) t WHERE DTW(t.traj, {q}) KNN 3"):
        with pytest.raises(ValueError):
            s.sql(text)


@pytest.mark.parametrize("indexed", [False, True])
def test_ranges(spark, frame, indexed):
    if indexed:
        index.create_index(frame, "traj", "ranges")
    rows = [(i, t) for i, t in sample() if t]
    inside = lambda p: 0 <= p[0] <= 80 and 10 <= p[1] <= 90
    for mode, of in (("contains", all), ("intersects", any)):
        got = {r["id"] for r in search.mbr_range_search(frame, [0.0, 10.0], [80.0, 90.0], "traj", mode).collect()}
        assert got == {i for i, t in rows if of(map(inside, t))}
        near = lambda p: math.dist(p, (50, 50)) <= 45
        got = {r["id"] for r in search.circle_range_search(frame, [50.0, 50.0], 45.0, "traj", mode).collect()}
        assert got == {i for i, t in rows if of(map(near, t))}
    if indexed:
        index.drop_index(frame, "traj")
    edge = spark.createDataFrame([(1, [[3.0, 4.0]])], SCHEMA)
    assert search.circle_range_search(edge, [0.0, 0.0], 5.0, "traj").count() == 1
    assert search.mbr_range_search(edge, [3.0, 4.0], [9.0, 9.0], "traj").count() == 1


def test_index_registry(spark, frame):
    index.create_index(frame, "traj", "one")
    index.create_index(frame, "traj", "two")  # only warns
    assert [r["index"] for r in index.show_indexes(spark).collect()] == ["one"]
    index.drop_index(frame, name="one")
    assert index.show_indexes(spark).count() == 0
    for call in (index.create_index, index.drop_index):
        with pytest.raises(AnalysisException, match="Column nothing does not exist."):
            call(frame, "nothing", "x")


def test_index_reads_few_tiles(spark):
    """Threshold, range and SQL searches over an index filter its partitions, and their results are those without one."""
    r = random.Random(5)
    walk = lambda x, y: [[x + r.uniform(0, 3) * k, y + r.uniform(0, 3) * k] for k in range(6)]
    rows = [(i, walk(r.uniform(0, 900), r.uniform(0, 900))) for i in range(600)]
    spark.createDataFrame(rows, SCHEMA).createOrReplaceTempView("spread")
    frame, s = spark.table("spread"), TrajectorySession(spark)
    query = rows[17][1]
    literal = "TRAJECTORY(" + ", ".join(f"POINT({x}, {y})" for x, y in query) + ")"
    texts = [f"SELECT id FROM spread WHERE DTW(traj, {literal}) <= 120", f"SELECT id FROM spread t WHERE FRECHET(t.traj, {literal}) <= 60 AND id > 3",
             "SELECT id FROM spread WHERE traj IN MBRRANGE(POINT(100, 100), POINT(300, 300))", "SELECT id FROM spread WHERE NOT traj IN CIRCLERANGE(POINT(500, 500), 200)"]
    want = [sorted(x["id"] for x in s.sql(t).collect()) for t in texts]
    assert all(want) and s.sql(texts[0]).count() > 1
    s.sql("CREATE TRIE INDEX few ON spread (traj)")
    found = index.lookup(frame, "traj")
    tiles = len(found.tiles)
    assert sum(t["n"] for t in index.tile_statistics(frame, "traj").collect()) == 600 and tiles > 20
    for name, bar in (("DTW", 120), ("FRECHET", 60), ("EDR", 2), ("LCSS", 2)):
        keep = [t for t in found.tiles if search.tile_bound(t, query, name) <= bar]
        assert len(keep) < tiles / 4 or name in ("EDR", "LCSS")
    plan = search.threshold_search(frame, query, "traj", "DTW", 120)._jdf.queryExecution().executedPlan().toString()
    assert "__tile" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [sorted(x["id"] for x in s.sql(t).collect()) for t in texts] == want
    s.sql("DROP TRIE INDEX few ON spread")
    assert index.lookup(frame, "traj") is None


def test_indexed_search_returns_all(spark, monkeypatch):
    """More rows than the former limit, and none."""
    few = F.expr("array(array(50.0D, 50.0D))")
    monkeypatch.setattr(queries, "from_orders", lambda *_: spark.range(1_000_100).select("id", few.alias("traj")))
    assert queries.indexed_search(spark, "").agg(F.count("*"), F.countDistinct("id")).first()[:] == (1_000_100, 1_000_100)
    monkeypatch.setattr(queries, "from_orders", lambda *_: spark.range(3).select("id", F.expr("array(array(5000.0D, 50.0D))").alias("traj")))
    assert queries.indexed_search(spark, "").count() == 0
    assert index.show_indexes(spark).count() == 0


def test_sql(spark, frame):
    frame.createOrReplaceTempView("traj1")
    s = TrajectorySession(spark)
    literal = "TRAJECTORY(" + ", ".join(f"POINT({x}, {y})" for x, y in QUERY) + ")"
    want = {i: brute("DTW", t, QUERY) for i, t in sample() if t}
    got = {r["id"] for r in s.sql(f"SELECT * FROM traj1 WHERE DTW(traj1.traj, {literal}) <= 300").collect()}
    assert got == {i for i, d in want.items() if d <= 300}
    assert s.sql(f"SELECT COUNT(*) FROM traj1 WHERE DTW(traj1.traj, {literal}) KNN 5").first()[0] == 5
    assert s.sql("SELECT COUNT(*) FROM traj1 a JOIN traj1 b ON FRECHET(a.traj, b.traj) KNN 2").first()[0] == 2 * len(want)
    assert s.sql("SELECT * FROM traj1 WHERE traj1.traj IN MBRRANGE(POINT(0, 0), POINT(100, 100))").count() == len(want)
    s.sql("CREATE TRIE INDEX i1 ON traj1 (traj)")
    assert s.sql("SHOW TRIE INDEXES").columns == ["index"] and s.sql("SHOW TRIE INDEXES").count() == 1
    assert s.sql("DROP TRIE INDEX i1 ON traj1").count() == 0
    joined = s.sql("SELECT a.id, b.id FROM traj1 a JOIN traj1 b ON FRECHET(a.traj, b.traj) <= 40 -- KNN 5")
    assert sorted(map(tuple, joined.collect())) == sorted((i, j) for i, t in sample() if t for j, u in sample() if u and brute("FRECHET", t, u) <= 40)
    assert s.sql("SELECT 'POINT(1, 2) KNN 3' AS t, 'DTW(a, b) <= 3' AS u /* POINT(3, 4) */").first()[:] == ("POINT(1, 2) KNN 3", "DTW(a, b) <= 3")
    for text in ("LEFT JOIN traj1 b ON DTW(a.traj, b.traj) <= 3", "JOIN (SELECT * FROM traj1) b ON DTW(a.traj, b.traj) <= 3"):
        with pytest.raises(ValueError):
            s.sql(f"SELECT a.id FROM traj1 a {text}")


def test_text(spark, tmp_path):
    df = spark.createDataFrame([(0, [[1.0, 2.5], [3.0, -4.0]])], SCHEMA)
    write_text(df, str(tmp_path / "t"))
    assert [r["traj"] for r in read_text(spark, str(tmp_path / "t")).collect()] == [[[1.0, 2.5], [3.0, -4.0]]]
    assert spark.range(1).select(parse(F.lit("")).alias("t")).first()["t"] == []


def test_joins_measure_copies_once(spark, monkeypatch):
    """Copies of a trajectory are one row of a join, or one for every few of them; their pairs are all there, and are written nowhere."""
    rows = [(i, t) for i, t in sample(4, 12) if t]
    copies = [(100 * c + i, t) for c in range(9) for i, t in rows]
    frame = spark.createDataFrame(copies, SCHEMA).repartition(3)
    monkeypatch.setattr(join, "COPIES", 4)
    a, _ = join.sides(frame, frame, "traj", "traj", "FRECHET", "id", "id")
    held = a.data.select("ids").collect()
    assert len(held) < len(copies) and sum(len(r[0]) for r in held) == len(copies)
    want = {(i, j): brute("FRECHET", t, u) for i, t in copies for j, u in copies}
    both = join.threshold_join(frame, frame, "traj", "traj", "FRECHET", 50.0)
    assert not any("threshold-join" in f for f in both.inputFiles())
    assert sorted((r[0], r[1]) for r in both.collect()) == sorted(k for k, d in want.items() if d <= 50)
    once = [tuple(sorted(r[:2])) for r in join.threshold_join(frame, frame, "traj", "traj", "FRECHET", 50.0, once=True).collect()]
    assert sorted(once) == sorted((i, j) for (i, j), d in want.items() if d <= 50 and i < j)
    near = sorted((r[0], r[2], r[1]) for r in join.knn_join(frame, frame, "traj", "traj", "FRECHET", 12).collect())
    assert near == sorted(x for i, _ in copies for x in sorted((i, want[i, j], j) for j, _ in copies)[:12])


def test_exact_tiles_beyond_the_sample(spark, monkeypatch):
    """Cuts come from all points, however few a sample would take."""
    r = random.Random(6)
    import numpy as np

    from wayfold.operators.tiling import tiling

    points = [(float(r.randrange(500)), r.uniform(0, 9)) for _ in range(2000)]
    monkeypatch.setattr(index, "SAMPLE", 50)
    got = queries._exact_tiling(spark.createDataFrame(points, "x double, y double"), ["x", "y"], 16)
    want = tiling(np.array(points), 16, [2])
    assert got.fans == want.fans and all(np.array_equal(a, b, equal_nan=True) for a, b in zip(got.cuts, want.cuts))


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("dims", [1, 2, 3])
def test_sieve_keeps_all_near_pairs(name, dims):
    """Rows of up to 80 points, one of them far off and one with a coordinate that is no number."""
    import numpy as np
    import pyarrow as pa

    from wayfold.functions import sieve
    from wayfold.functions.distance import pairs_within

    r = random.Random(dims)
    column = lambda rows: pa.array(rows, pa.list_(pa.list_(pa.float64())))
    row = lambda most: [[r.uniform(0, 100) for _ in range(dims)] for _ in range(r.randint(0, most))]
    a = column([row(most) for most in (1, 3, 12, 12, 12, 20, 40, 80)] + [[[1e6] * dims]])
    rights = [row(most) for most in (1, 3, 12, 12, 12, 20, 40, 80) for _ in range(30)] + [[[1e5] * dims] * 3, None]
    for b in (column(rights), column([*rights, [[math.nan] * dims]])):
        whole = pairs_within(name, a, b, np.inf)
        for share in (0.0, 0.02, 0.3, 1.0):
            bars = np.array([np.quantile(own, share) if len(own := whole[2][whole[0] == i]) else np.inf for i in range(len(a))])
            want, got = (sorted(zip(*(x.tolist() for x in f(name, a, b, bars)))) for f in (pairs_within, sieve.near_pairs))
            assert got == want
        for k in (1, 3, 1000):
            far = [sorted(whole[2][whole[0] == i].tolist()) for i in range(len(a))]
            assert sieve.kth_distances(name, a, b, k).tolist() == [d[k - 1] if len(d) >= k else math.inf for d in far]


@pytest.mark.parametrize("name", ["EDR", "FRECHET"])
def test_nearest_join_measures_few_pairs(name, monkeypatch):
    """Of trajectories that all differ, lengths or ends leave much; the sieve leaves few pairs to measure."""
    import numpy as np
    import pyarrow as pa

    from wayfold.functions import distance as measures
    from wayfold.functions import sieve

    r = random.Random(2)
    rows = [[[r.uniform(0, 100), y] for y in sorted(r.uniform(0, 100) for _ in range(r.randint(5, 15)))] for _ in range(3000)]
    a, b = (pa.array(x, pa.list_(pa.list_(pa.float64()))) for x in (rows[::50], rows))
    measured, plain = [], measures._programme_within
    monkeypatch.setattr(measures, "_programme_within", lambda *x: measured.append(len(x[3])) or plain(*x))
    bars = sieve.kth_distances(name, a, b, 3)
    got = sieve.near_pairs(name, a, b, bars)
    assert sum(measured) < 0.15 * len(a) * len(b)
    monkeypatch.undo()
    assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(*(x.tolist() for x in measures.pairs_within(name, a, b, bars))))
    assert (np.bincount(got[0], minlength=len(a)) >= 3).all()


def test_nearest_join_takes_tiles_together(spark, monkeypatch):
    """Small tiles next to each other are one for a nearest join, so a left row is sent to few; all of the join's blocks are used."""
    r = random.Random(8)
    rows = [(i, [[r.uniform(0, 100), r.uniform(0, 100)] for _ in range(r.randint(1, 8))]) for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(index, "TILE_ROWS", 5)
    for n, v in (("NEAR_RIGHT", 60), ("NEAR_LEFT", 20), ("SEEDS", 40), ("SEED_ROWS", 50)):
        monkeypatch.setattr(join, n, v)
    for name in NAMES:
        a, _ = join.sides(frame, frame, "traj", "traj", name, "id", "id")
        held = join._bundled(a)
        assert len(held.tiles) <= 12 < len(a.tiles) and sum(t["n"] for t in held.tiles) == len(rows)
        assert {t[index.TILE]: t["n"] for t in held.tiles} == {x[0]: x[1] for x in held.data.groupBy(index.TILE).count().collect()}
        near = sorted((x[0], x[2], x[1]) for x in join.knn_pairs(a, a, name, 3).collect())
        assert near == sorted(x for i, t in rows[:60] for x in sorted((i, brute(name, t, u), j) for j, u in rows)[:3]) + [x for x in near if x[0] >= 60]
        assert len(near) == 3 * len(rows)


@pytest.mark.parametrize("once", [False, True])
def test_threshold_join_sends_no_row_twice(spark, monkeypatch, once):
    """Blocks meet in a product of partitions: a plan without rows made for each tile, however many blocks there are."""
    r = random.Random(12)
    rows = [(i, [[r.uniform(0, 100), r.uniform(0, 100)] for _ in range(r.randint(1, 9))]) for i in range(120)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(index, "TILE_ROWS", 5)
    for n, v in (("BLOCK", 4), ("NEAR_RIGHT", 25), ("NEAR_LEFT", 7), ("LEAST_POINTS", 8), ("EXPANDED", 3)):
        monkeypatch.setattr(join, n, v)
    found = join.threshold_join(frame, frame, "traj", "traj", "DTW", 250.0, once=once, digits=6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan and "Generate" not in plan
    want = {(i, j): brute("DTW", t, u) for i, t in rows for j, u in rows if i < j or not once}
    got = {(min(x[:2]), max(x[:2])) if once else tuple(x[:2]): x[2] for x in found.collect()}
    assert got == {k: pytest.approx(d, abs=1e-6) for k, d in want.items() if d <= 250}


def test_walks_of_all_lengths():
    """Walks followed by diagonals, of pairs that end at different places and leave at different times."""
    import numpy as np
    import pyarrow as pa

    from wayfold.functions import distance as measures
    from wayfold.functions import sieve

    r = random.Random(7)
    rows = [[[r.uniform(0, 100), r.uniform(0, 100)] for _ in range(n)] for n in (1, 1, 2, 3, 5, 8, 9, 17, 63, 64, 65, 66, 90, 130)]
    a = pa.array(rows, pa.list_(pa.list_(pa.float64())))
    for name in ("DTW", "FRECHET"):
        want = {(i, j): brute(name, t, u) for i, t in enumerate(rows) for j, u in enumerate(rows)}
        for share in (0.2, 0.6, 1.0):
            bars = np.array([np.quantile([want[i, j] for j in range(len(rows))], share) for i in range(len(rows))])
            for found in (sieve.near_pairs(name, a, a, bars), measures.pairs_within(name, a, a, bars)):
                assert {(i, j): d for i, j, d in zip(*(x.tolist() for x in found))} == {k: d for k, d in want.items() if d <= bars[k[0]]}
    # Long rows go by their points too, and not by their ends alone.
    rights = [[[50.0, 50.0], *([r.uniform(0, 100), r.uniform(0, 100)] for _ in range(98)), [50.0, 50.0]] for _ in range(300)]
    points, start, size = measures._points(pa.array(rights, pa.list_(pa.list_(pa.float64()))))
    assert len(sieve.Grid(points, start, size).near("FRECHET", points[:100], 30.0, EPS, DELTA)) < 30


def test_rounding_as_spark_does(spark):
    import numpy as np

    d = [0.1234565, 2.5e-7, 5e-7, 1.0000005, 123456.7890125, 99999999.9999995, 4e15, 1e17 / 3, *(random.Random(1).uniform(0, 300) for _ in range(500))]
    want = [x[0] for x in spark.createDataFrame([(x,) for x in d], "d double").select(F.round("d", 6)).collect()]
    assert join._rounded(np.array(d), 6).tolist() == want


def test_sql_join_measures_its_pairs_once(spark, frame):
    """The pairs of a SQL join are read once, whatever columns it names."""
    frame.createOrReplaceTempView("pairs_once")
    s = TrajectorySession(spark)
    rows = [(i, t) for i, t in sample() if t]
    want = sorted((i, j) for i, t in rows for j, u in rows if i < j and brute("FRECHET", t, u) < 50)
    for columns in ("a.id AS left_id, b.id AS right_id", "a.id, b.id"):
        found = s.sql(f"SELECT {columns} FROM pairs_once a JOIN pairs_once b ON FRECHET(a.traj, b.traj) < 50.0 WHERE a.id < b.id")
        assert found._jdf.queryExecution().optimizedPlan().toString().count("InArrow ") <= 4
        assert "LateralJoin" not in found._jdf.queryExecution().analyzed().toString()
        assert sorted(map(tuple, found.collect())) == want
    assert s.sql("SELECT a.id, count(*) AS n FROM pairs_once a JOIN pairs_once b ON FRECHET(a.traj, b.traj) < 50.0 GROUP BY a.id").count() == len(rows)
    other = s.sql("SELECT b.id AS id FROM pairs_once a JOIN pairs_once b ON FRECHET(a.traj, b.traj) < 50.0 WHERE a.id < b.id ORDER BY id")
    assert [x[0] for x in other.collect()] == sorted(j for _, j in want)


def test_nearest_join_takes_all_customers(spark, orders):
    """The Frechet join has a left row for every customer."""
    path, t = orders
    got = sorted((r[0], r[2], r[1]) for r in queries.QUERIES["traj_knn_join_frechet"](spark, path).collect())
    want = sorted(x for i in t for x in sorted((i, brute("FRECHET", t[i], t[j]), j) for j in t)[:3])
    assert [(i, j) for i, _, j in got] == [(i, j) for i, _, j in want] and [d for _, d, _ in got] == pytest.approx([d for _, d, _ in want], abs=1e-6)
    assert {i for i, *_ in got} == set(t)
