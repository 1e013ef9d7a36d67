"""Vertex cut, messages to both ends, labels and factors against small dense versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import graph


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def test_cut_of_a_star(spark):
    """A hub's edges lie in about the root of all parts; no part has more than a few shares of them."""
    star = spark.range(1, 20_001).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("src"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(0).alias("dst"))
    placed = graph.cut(star, 256)
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert 24 <= len(sizes) <= 32 and max(sizes) < 2 * 20_000 / len(sizes)
    ways = graph.routes(placed).groupBy("id").count()
    assert ways.where("id = 0").first()["count"] == len(sizes) and ways.where("id != 0").agg(F.max("count")).first()[0] == 1
    sent = graph.edge_contexts(placed, graph.routes(placed), graph.vertices(star).select("id", F.col("id").alias("value"), F.lit(True).alias("active")))
    assert sent.count() == 20_000 and sent.where("src != src_value OR dst != dst_value").isEmpty()
    assert graph.aggregate_messages(sent, F.sum, F.lit(1), F.lit(1)).where("id = 0").first()["got"] == 20_000


@pytest.mark.parametrize("direction", list(graph.DIRECTIONS))
def test_messages_from_and_to_both_ends(spark, direction):
    r = random.Random(3)
    edges = sorted({(r.randrange(12), r.randrange(12)) for _ in range(40)})
    value, active = {v: v * v - 20 for v in range(12)}, {v: v % 3 == 0 for v in range(12)}
    state = spark.createDataFrame([(v, value[v], active[v]) for v in range(12)], "id long, value long, active boolean")
    placed = graph.cut(frame(spark, edges), 9)
    near = graph.edge_contexts(placed, graph.routes(placed), state, direction)
    got = graph.aggregate_messages(near, F.sum, F.col("src_value") * 2 - F.col("dst_value"), F.when(F.col("dst_value") > 0, F.col("dst_value")))
    want = {}
    for s, d in edges:
        if {"out": active[s], "in": active[d], "either": active[s] or active[d], "both": active[s] and active[d]}[direction]:
            want[d] = want.get(d, 0) + 2 * value[s] - value[d]
            if value[d] > 0:
                want[s] = want.get(s, 0) + value[d]
    assert {x["id"]: x["got"] for x in got.collect()} == want


def test_labels_of_all_vertices(spark):
    edges = [(1, 2), (2, 3), (3, 1), (6, 6), (7, 8), (8, 9), (9, 7), (9, 10), (3, 7)]
    near = {}
    for s, d in edges:
        if s != d:
            near.setdefault(s, set()).add(d)
            near.setdefault(d, set()).add(s)
    labels = {v: v for e in edges for v in e}
    for rounds in range(1, 6):
        new = dict(labels)
        for v, own in near.items():
            seen = [labels[u] for u in own]
            new[v] = min(seen, key=lambda x: (-seen.count(x), x))
        labels = new
        if rounds in (1, 5):
            assert {r["id"]: r["value"] for r in graph.label_propagation(frame(spark, edges), rounds).collect()} == labels
    assert labels[6] == 6


def test_pregel_against_the_edges(spark):
    """Distances from a vertex with messages both ways, to the end."""
    edges = frame(spark, [(1, 2), (3, 2), (3, 4), (9, 8)])
    start = graph.vertices(edges).select("id", F.when(F.col("id") == 1, 0).cast("long").alias("value"))
    far = graph.pregel(edges, start, F.col("src_value") + 1, F.min, F.least("value", "got"), back=F.col("dst_value") + 1, direction="either", both_ends=True)
    assert {r["id"]: r["value"] for r in far.collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 8: None, 9: None}


def test_ranks_converge(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (4, 3), (5, 5)]
    ids = sorted({v for e in edges for v in e})
    ranks = dict.fromkeys(ids, 1.0)
    for _ in range(300):
        got = dict.fromkeys(ids, 0.0)
        for s, d in edges:
            got[d] += ranks[s] / sum(x == s for x, _ in edges)
        ranks = {v: 0.15 + 0.85 * got[v] for v in ids}
    found = {r["id"]: r["value"] for r in graph.page_rank(frame(spark, edges), tolerance=1e-7).collect()}
    assert found == {v: pytest.approx(x, abs=1e-5) for v, x in ranks.items()}


def test_factors_equal_a_dense_version(spark):
    r = random.Random(8)
    rows = [(u, i, r.gauss(3 + (u % 3) - (i % 4) / 2, 0.3)) for u in range(12) for i in range(9) if r.random() < 0.6] + [(0, 0, None), (None, 1, 2.0)]
    users, items, errors = graph.svd_plus_plus(spark.createDataFrame(rows, "user long, item long, rating double"), 3, 6, rate=0.02)
    hashed = lambda table, key, cs: {x[key]: np.array([x[c] for c in cs], float) for x in table.collect()}
    ids = spark.range(20).select("id", *(F.expr(f"(pmod(xxhash64(id, {k}), 2001) - 1000) / 10000.0D").alias(f"h{k}") for k in (0, 1, 2, 100, 101, 102, 200, 201, 202)))
    seed = {n: hashed(ids, "id", [f"h{b + k}" for k in range(3)]) for n, b in (("p", 0), ("q", 100), ("y", 200))}
    rated = {}
    for u, i, v in rows:
        if u is not None and v is not None:
            rated.setdefault((u, i), []).append(v)
    rated = {k: sum(v) / len(v) for k, v in rated.items()}
    mean = sum(rated.values()) / len(rated)
    of = {u: [i for x, i in rated if x == u] for u, _ in rated}
    p, q, y = ({k: v.copy() for k, v in seed[n].items()} for n in "pqy")
    bu, bi = dict.fromkeys(of, 0.0), dict.fromkeys({i for _, i in rated}, 0.0)
    want = []
    for _ in range(6):
        z = {u: p[u] + sum(y[i] for i in own) / math.sqrt(len(own)) for u, own in of.items()}
        e = {(u, i): v - (mean + bu[u] + bi[i] + q[i] @ z[u]) for (u, i), v in rated.items()}
        want.append(math.sqrt(sum(x * x for x in e.values()) / len(e)))
        dp, dq, dy = ({k: np.zeros(3) for k in range(20)} for _ in range(3))
        dbu, dbi = dict.fromkeys(bu, 0.0), dict.fromkeys(bi, 0.0)
        for (u, i), x in e.items():
            dbu[u] += x - 0.02 * bu[u]
            dbi[i] += x - 0.02 * bi[i]
            dp[u] += x * q[i] - 0.02 * p[u]
            dq[i] += x * z[u] - 0.02 * q[i]
            dy[i] += x / math.sqrt(len(of[u])) * q[i] - 0.02 * y[i]
        for u in bu:
            bu[u] += 0.02 * dbu[u]
            p[u] += 0.02 * dp[u]
        for i in bi:
            bi[i] += 0.02 * dbi[i]
            q[i] += 0.02 * dq[i]
            y[i] += 0.02 * dy[i]
    assert errors == pytest.approx(want, rel=1e-9) and all(b < a for a, b in zip(errors, errors[1:]))
    assert {r["user"]: r["bu"] for r in users.collect()} == {u: pytest.approx(v, rel=1e-6, abs=1e-9) for u, v in bu.items()}
    for x in items.collect():
        assert [x["q0"], x["y2"], x["bi"]] == pytest.approx([q[x["item"]][0], y[x["item"]][2], bi[x["item"]]], rel=1e-6, abs=1e-9)


def test_svd_errors_fall_with_many_ratings(spark, tmp_path):
    """An item that thousands of users have rated doesn't make the steps too large."""
    from pyspark.sql import functions as F

    from wayfold.plans import graph_queries

    item = spark.range(9000).select((F.col("id") % 4500).alias("l_suppkey"), F.floor(F.col("id") / 4500).alias("l_partkey"), ((F.col("id") * 7919) % 50 + 1).cast("double").alias("l_quantity"))
    item.write.parquet(f"{tmp_path}/lineitem.parquet")
    row = graph_queries.svd_errors(spark, str(tmp_path)).first()
    assert (row["users"], row["items"], row["falls"]) == (4500, 2, True)


def plain_ranks(edges, rounds, tolerance=None, damping=0.85):
    """Each round over all vertices and edges."""
    ranks, k = {v: 1.0 for e in edges for v in e}, 0
    while rounds is None or k < rounds:
        k, old = k + 1, ranks
        ranks = {v: 1 - damping + damping * sum(old[s] / sum(t == s for t, _ in edges) for s, d in edges if d == v) for v in old}
        if rounds is None and max(abs(ranks[v] - old[v]) for v in ranks) <= tolerance:
            break
    return ranks


def test_ranks_with_vertices_that_no_edge_leads_to(spark):
    r = random.Random(8)
    many = sorted({(r.randrange(30), r.randrange(8)) for _ in range(60)})
    for edges, rounds, tolerance in ((many, 0, None), (many, 2, None), (many, None, 1e-3), ([(1, 2), (3, 2)], None, 1e-6), ([(1, 2)], 1, None), ([(1, 2)], None, 0.9), ([(5, 5)], None, 0.2)):
        got = {x["id"]: x["value"] for x in graph.page_rank(frame(spark, edges), rounds, tolerance=tolerance or 0.0).collect()}
        assert got == pytest.approx(plain_ranks(edges, rounds, tolerance), abs=1e-12)
    assert graph.page_rank(frame(spark, [])).count() == 0


def test_no_table_is_sent_whole_to_the_driver(spark, monkeypatch):
    """However small the files of vertices and messages are, rounds join them by shuffles."""
    plans = []

    def written(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label)

    write = graph.materialize
    monkeypatch.setattr(graph, "materialize", written)
    edges = write(frame(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4)]), "few-edges")
    found = [graph.page_rank(edges, 2), graph.connected_components(edges), graph.label_propagation(edges, 2), graph.triangle_count(edges), graph.strong_components(edges)]
    graph.svd_plus_plus(edges.select(F.col("src").alias("user"), F.col("dst").alias("item"), F.lit(1.0).alias("rating")), rounds=1)
    plans += [("result", df._jdf.queryExecution().executedPlan().toString()) for df in found]
    assert len(plans) > 30 and not [label for label, plan in plans if "Broadcast" in plan]
