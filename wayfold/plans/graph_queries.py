"""Graph queries: users and customers as vertices, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.shared import materialize
from wayfold.operators import graph
from wayfold.sources.files import place

#: Orders as edges between customers: each to the one that the order's number picks among its neighbours.
EDGES = "SELECT DISTINCT o_custkey AS src, (o_custkey * 7 + o_orderkey % 3 * 11) % 400 AS dst FROM orders"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges, written once: every operator reads them more than once."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = o.select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 3 * 11) % 400).alias("dst")).distinct()
    return materialize(found, "graph-edges")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(edges(spark, sf_dir)).select("id", F.col("value").alias("component"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_paths(edges(spark, sf_dir), 7).select("id", F.col("value").alias("steps"))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangle_count(edges(spark, sf_dir))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.page_rank(edges(spark, sf_dir), 2).select("id", F.round("value", 9).alias("rank"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_propagation(edges(spark, sf_dir), 1).select("id", F.col("value").alias("label"))


def converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks once none moves any more."""
    return graph.page_rank(edges(spark, sf_dir), tolerance=1e-8).select("id", F.round("value", 5).alias("rank"))


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rounds of label propagation over all vertices."""
    return graph.label_propagation(edges(spark, sf_dir), 5).select("id", F.col("value").alias("label"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from both ends' values to either end: how far a customer's balance lies above its poorer neighbours' in all, and below the richest's."""
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("value"))
    placed = materialize(graph.cut(edges(spark, sf_dir)), "balance-edges")
    near = graph.edge_contexts(placed, graph.routes(placed), people.withColumn("active", F.col("value") > 0), "either")
    gap = F.col("src_value") - F.col("dst_value")
    above = graph.aggregate_messages(near, F.sum, F.when(gap < 0, -gap), F.when(gap > 0, gap)).select("id", F.round("got", 4).alias("above"))
    below = graph.aggregate_messages(near, F.max, F.when(gap > 0, gap), F.when(gap < 0, -gap)).select("id", F.round("got", 4).alias("below"))
    return above.join(below, "id", "full")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supersteps with messages along and against the edges: the largest and least customer within three steps."""
    e = edges(spark, sf_dir)
    own = graph.vertices(e).select("id", F.struct(F.col("id").alias("low"), F.col("id").alias("high")).alias("value"))
    both = lambda m: F.struct(F.min(m["low"]).alias("low"), F.max(m["high"]).alias("high"))
    update = F.struct(F.least("value.low", "got.low").alias("low"), F.greatest("value.high", "got.high").alias("high"))
    found = graph.pregel(e, own, F.col("src_value"), both, update, 3, back=F.col("dst_value"), direction="either", both_ends=True)
    return found.select("id", "value.low", "value.high")


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as text with a comment, and read from their smaller vertex: how many there are between two vertices."""
    path = place(spark, "edges")
    lines = edges(spark, sf_dir).select(F.concat_ws(" ", "src", "dst").alias("value"))
    lines.union(spark.range(1).select(F.lit("# customers"))).write.text(path)
    return graph.load_edges(spark, path, canonical=True).groupBy("src", "dst").agg(F.count("*").alias("n"))


RATINGS = "SELECT l_suppkey AS user, l_partkey % 300 AS item, l_quantity / 10.0 AS rating FROM lineitem"


def _factors(spark: SparkSession, sf_dir: str):
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ratings = item.select(F.col("l_suppkey").alias("user"), (F.col("l_partkey") % 300).alias("item"), (F.col("l_quantity") / 10.0).alias("rating"))
    # A round sums the gradients of all ratings of a vertex: the more it has, the smaller the step has to be for the error to fall.
    pairs = ratings.select("user", "item").distinct()
    most = max(pairs.groupBy(end).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1 for end in ("user", "item"))
    return graph.svd_plus_plus(ratings, rounds=4, rate=min(0.001, 0.5 / most))


def svd_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error before each gradient round, which falls, and how many users and items have factors."""
    users, items, errors = _factors(spark, sf_dir)
    falls = all(b < a for a, b in zip(errors, errors[1:]))
    counts = users.agg(F.count("*").alias("users")).join(items.agg(F.count("*").alias("items")))
    return counts.select("users", "items", F.lit(len(errors)).cast("long").alias("rounds"), F.lit(falls).alias("falls"), F.lit(round(errors[0], 2)).alias("before"))


def strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(edges(spark, sf_dir)).select("id", F.col("value").alias("component"))


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the balance of both customers: the sum that flows along each."""
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("attr"))
    found = graph.triplets(edges(spark, sf_dir), people)
    return found.groupBy("dst").agg(F.round(F.sum("src_attr"), 4).alias("got"), F.round(F.max("dst_attr"), 4).alias("own"))


QUERIES = {
    "graph_components": components,
    "graph_shortest_paths": paths,
    "graph_triangles": triangles,
    "graph_page_rank": ranks,
    "graph_label_propagation": labels,
    "graph_strong_components": strong,
    "graph_triplets": triplets,
    "graph_page_rank_converged": converged,
    "graph_loaded": loaded,
    "graph_label_rounds": spread,
    "graph_balances": balances,
    "graph_spans": spans,
    "graph_svd_plus_plus": svd_errors,
}

_BOTH = "SELECT DISTINCT a AS src, b AS dst FROM (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e) WHERE a != b"
_RANK = "SELECT v.id, 0.15 + 0.85 * coalesce(sum(r.value / o.n), 0) AS value FROM v LEFT JOIN e ON e.dst = v.id LEFT JOIN {0} r ON r.id = e.src LEFT JOIN o ON o.src = e.src GROUP BY v.id"
_V = "SELECT src AS id FROM e UNION SELECT dst FROM e"
_RANKS = ", ".join(f"r{k + 1} AS MATERIALIZED ({_RANK.format(f'r{k}')})" for k in range(60))
_LEAST = ", ".join(f"c{k + 1} AS MATERIALIZED (SELECT c.id, least(c.value, coalesce(min(n.value), c.value)) AS value FROM c{k} c LEFT JOIN w ON w.dst = c.id LEFT JOIN c{k} n ON n.id = w.src GROUP BY c.id, c.value)" for k in range(12))
_LABELS = ", ".join(
    f"""l{k + 1} AS MATERIALIZED (SELECT l.id, coalesce(b.label, l.value) AS value FROM l{k} l LEFT JOIN (
        SELECT id, label FROM (SELECT w.dst AS id, n.value AS label, count(*) AS c FROM w JOIN l{k} n ON n.id = w.src GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, label) = 1) b USING (id))""" for k in range(5))
_SPANS = ", ".join(f"s{k + 1} AS MATERIALIZED (SELECT s.id, least(s.low, coalesce(min(n.low), s.low)) AS low, greatest(s.high, coalesce(max(n.high), s.high)) AS high FROM s{k} s LEFT JOIN w ON w.dst = s.id LEFT JOIN s{k} n ON n.id = w.src GROUP BY s.id, s.low, s.high)" for k in range(3))
SQL = {
    "graph_components": f"""WITH e AS ({EDGES}), w AS MATERIALIZED ({_BOTH}), v AS ({_V}), c0 AS (SELECT id, id AS value FROM v), {_LEAST}
        SELECT id, value AS component FROM c12""",
    "graph_shortest_paths": f"""WITH RECURSIVE e AS ({EDGES}), v AS ({_V}),
        walk AS (SELECT CAST(7 AS BIGINT) AS id, CAST(0 AS BIGINT) AS steps UNION SELECT e.src, walk.steps + 1 FROM walk JOIN e ON e.dst = walk.id WHERE walk.steps < 12)
        SELECT v.id, min(walk.steps) AS steps FROM v LEFT JOIN walk ON walk.id = v.id GROUP BY v.id""",
    "graph_triangles": f"""WITH e AS ({EDGES}), w AS ({_BOTH}), t AS (SELECT a.src AS x, b.src AS y, b.dst AS z FROM w a JOIN w b ON a.dst = b.src JOIN w c ON c.src = b.dst AND c.dst = a.src WHERE a.src < b.src AND b.src < b.dst)
        SELECT unnest([x, y, z]) AS id, count(*) AS n FROM t GROUP BY 1""",
    "graph_page_rank": f"""WITH e AS ({EDGES}), v AS ({_V}), o AS (SELECT src, count(*) AS n FROM e GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE AS value FROM v),
        r1 AS ({_RANK.format('r0')}), r2 AS ({_RANK.format('r1')}) SELECT id, round(value, 9) AS rank FROM r2""",
    "graph_label_propagation": f"WITH e AS ({EDGES}), w AS ({_BOTH}) SELECT dst AS id, min(src) AS label FROM w GROUP BY dst",
    "graph_page_rank_converged": f"""WITH e AS MATERIALIZED ({EDGES}), v AS MATERIALIZED ({_V}), o AS MATERIALIZED (SELECT src, count(*) AS n FROM e GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE AS value FROM v), {_RANKS}
        SELECT id, round(value, 5) AS rank FROM r60""",
    "graph_label_rounds": f"WITH e AS ({EDGES}), w AS MATERIALIZED ({_BOTH}), v AS ({_V}), l0 AS (SELECT id, id AS value FROM v), {_LABELS} SELECT id, value AS label FROM l5",
    "graph_balances": f"""WITH m AS (SELECT src, dst, a.c_acctbal::DOUBLE - b.c_acctbal::DOUBLE AS gap FROM ({EDGES}) JOIN customer a ON a.c_custkey = src JOIN customer b ON b.c_custkey = dst
            WHERE a.c_acctbal > 0 OR b.c_acctbal > 0),
        got AS (SELECT src AS id, gap FROM m UNION ALL SELECT dst, -gap FROM m)
        SELECT id, round(sum(gap) FILTER (gap > 0), 4) AS above, round(max(-gap) FILTER (gap < 0), 4) AS below FROM got WHERE gap != 0 GROUP BY id""",
    "graph_spans": f"WITH e AS ({EDGES}), w AS MATERIALIZED ({_BOTH}), v AS ({_V}), s0 AS (SELECT id, id AS low, id AS high FROM v), {_SPANS} SELECT id, low, high FROM s3",
    "graph_loaded": f"SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*) AS n FROM ({EDGES}) GROUP BY 1, 2",
    "graph_svd_plus_plus": f"""WITH r AS (SELECT "user", item, avg(rating) AS rating FROM ({RATINGS.replace('AS user', 'AS "user"')}) GROUP BY ALL)
        SELECT count(DISTINCT "user") AS users, count(DISTINCT item) AS items, 4::BIGINT AS rounds, true AS falls, round(stddev_pop(rating), 2) AS before FROM r""",
    "graph_triplets": f"SELECT dst, round(sum(a.c_acctbal), 4) AS got, round(max(b.c_acctbal), 4) AS own FROM ({EDGES}) JOIN customer a ON a.c_custkey = src JOIN customer b ON b.c_custkey = dst GROUP BY dst",
}
