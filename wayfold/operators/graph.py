"""Graph operators over an edge table (src, dst), as joins and aggregations in rounds.

Vertices are longs. Each round's table is written to the shared folder, so that
lineage and plans stay short. Loops stop when nothing changes.

Edges are dealt by a two-dimensional vertex cut (``cut``): the hash of the source
names a row of a square of parts, that of the destination a column. So the edges
of a hub lie in about the root of all parts, and a routing table (``routes``)
holds for each vertex the few parts that its value has to be sent to. Messages
combine within the tasks before they go to the vertex that they are for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.shared import discard, materialize

#: Parts of a vertex cut, a square number.
PARTS = 256
#: Which edges a round looks at: those with an active source, destination, either or both.
DIRECTIONS = {"out": "src_active", "in": "dst_active", "either": "src_active OR dst_active", "both": "src_active AND dst_active"}


def _meet(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that sends neither side whole to the driver: ranks and labels of millions of vertices can lie in a file that is small enough for Spark to broadcast it, in every round."""
    return a.join(b.hint("merge"), on, how)


def load_edges(spark: SparkSession, path: str, canonical: bool = False) -> DataFrame:
    """Edges from text, two vertices to a line apart by white space; lines that begin with # are left out. With
    ``canonical`` each edge runs from its smaller vertex."""
    fields = F.split(F.trim("value"), r"\s+")
    found = spark.read.text(path).where("value NOT LIKE '#%' AND trim(value) != ''").select(fields[0].cast("long").alias("src"), fields[1].cast("long").alias("dst"))
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")) if canonical else found


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once; loops go."""
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").union(flipped).where("src != dst").distinct()


def triplets(edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """Edges beside the attributes (id, attr) of both ends."""
    a, b = attributes.select(F.col("id").alias("src"), F.col("attr").alias("src_attr")), attributes.select(F.col("id").alias("dst"), F.col("attr").alias("dst_attr"))
    return _meet(_meet(edges, a, "src"), b, "dst").select("src", "dst", "src_attr", "dst_attr")


def cut(edges: DataFrame, parts: int = PARTS) -> DataFrame:
    """The edges with the part that each lies in."""
    side = max(1, math.isqrt(parts))
    place = lambda c, seed: F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(side))
    return edges.withColumn("part", (place("src", 1) * side + place("dst", 2)).cast("int"))


def routes(placed: DataFrame) -> DataFrame:
    """(id, part): the parts that hold edges of a vertex."""
    return placed.select(F.col("src").alias("id"), "part").union(placed.select("dst", "part")).distinct()


def edge_contexts(placed: DataFrame, routed: DataFrame, state: DataFrame, direction: str = "out", both_ends: bool = True) -> DataFrame:
    """Edges of a cut beside src_value and dst_value, of those that ``direction`` names by the state's column ``active``.

    Values go to the parts by the routing table, and meet the edges by part and vertex. Without ``both_ends`` there is no dst_value.
    """
    sent = _meet(routed, state, "id")
    at = lambda end: sent.select("part", F.col("id").alias(end), F.col("value").alias(f"{end}_value"), F.col("active").alias(f"{end}_active"))
    if not both_ends:
        if direction != "out":
            raise ValueError("a direction other than out needs both ends")
        return _meet(placed, at("src").where("src_active"), ["part", "src"])
    return _meet(_meet(placed, at("src"), ["part", "src"]), at("dst"), ["part", "dst"]).where(DIRECTIONS[direction])


def aggregate_messages(contexts: DataFrame, combine, to_dst: Column | None = None, to_src: Column | None = None) -> DataFrame:
    """(id, got): messages of edges, given as columns of src_value, dst_value and the edge, combined at the vertices; a null sends nothing."""
    ways = [F.struct(F.col(end).alias("id"), m.alias("m")) for end, m in (("dst", to_dst), ("src", to_src)) if m is not None]
    return contexts.select(F.inline(F.array(*ways))).where("m IS NOT NULL").groupBy("id").agg(combine(F.col("m")).alias("got"))


def pregel(
    edges: DataFrame, state: DataFrame, message: Column | None, combine, update: Column, rounds: int | None = None, back: Column | None = None, direction: str = "out", both_ends: bool = False
) -> DataFrame:
    """Supersteps over (id, value): ``message`` goes along each edge and ``back`` against it, both columns of src_value
    (with ``both_ends`` also of dst_value) and the edge; ``combine`` aggregates what a vertex receives as ``got``,
    ``update`` (of value and got, null without messages) is its next value. Ends when no value changes, or after
    ``rounds``; a round looks at the edges that ``direction`` names by the vertices that changed last."""
    placed = materialize(cut(edges), "pregel-edges")
    routed = materialize(routes(placed), "pregel-routes")
    state = materialize(state.select("id", "value", F.lit(True).alias("active")), "pregel-0")
    k = 0
    while rounds is None or k < rounds:
        k += 1
        got = aggregate_messages(edge_contexts(placed, routed, state, direction, both_ends), combine, message, back)
        new = _meet(state, got, "id", "left").select("id", F.col("value").alias("old"), update.alias("value"))
        old, state = state, materialize(new.select("id", "value", (~F.col("value").eqNullSafe(F.col("old"))).alias("active")), f"pregel-{k}")
        discard(old)
        if rounds is None and state.where("active").isEmpty():
            break
    discard(placed, routed)
    return state.select("id", "value")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, value): the smallest vertex that each can reach, edges taken in both directions."""
    start = vertices(edges).select("id", F.col("id").alias("value"))
    return pregel(both_ways(edges), start, F.col("src_value"), F.min, F.least("value", "got"))


def shortest_paths(edges: DataFrame, landmark: int) -> DataFrame:
    """(id, value): number of edges from each vertex to the landmark; null where there is no way."""
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = vertices(edges).select("id", F.when(F.col("id") == landmark, 0).cast("long").alias("value"))
    return pregel(flipped, start, F.col("src_value") + 1, F.min, F.least("value", "got"))


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """(id, value): each round a vertex takes its neighbours' commonest label, the smallest of equals; one without neighbours keeps its own."""
    placed = materialize(cut(both_ways(edges)), "labels-edges")
    routed = materialize(routes(placed), "labels-routes")
    labels = materialize(vertices(edges).select("id", F.col("id").alias("value")), "labels-0")
    for k in range(rounds):
        near = edge_contexts(placed, routed, labels.withColumn("active", F.lit(True)), both_ends=False)
        seen = near.groupBy("dst", F.col("src_value").alias("label")).agg(F.count("*").alias("n"))
        best = seen.groupBy(F.col("dst").alias("id")).agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("best"))
        old, labels = labels, materialize(_meet(labels, best, "id", "left").select("id", F.coalesce("best", "value").alias("value")), f"labels-{k + 1}")
        discard(old)
    discard(placed, routed)
    return labels


def triangle_count(edges: DataFrame) -> DataFrame:
    """(id, n): triangles at each vertex. Edges run from the end of fewer neighbours, so that a hub begins few paths."""
    way = materialize(both_ways(edges), "triangle-edges")
    degree = way.groupBy("src").agg(F.count("*").alias("degree"))
    d = lambda end: degree.select(F.col("src").alias(end), F.col("degree").alias(f"{end}_degree"))
    directed = _meet(_meet(way, d("src"), "src"), d("dst"), "dst").where("struct(src_degree, src) < struct(dst_degree, dst)").select("src", "dst")
    directed = materialize(directed, "triangle-directed")
    a = directed.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    b = directed.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    closing = directed.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    found = _meet(_meet(a, b, "a"), closing, ["b", "c"])
    return found.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def page_rank(edges: DataFrame, rounds: int | None = None, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(id, value): ranks that start at 1; after each round a vertex has 1 - damping and what its neighbours share out.
    Without ``rounds``, until no rank moves by more than the tolerance.

    A vertex that no edge leads to has 1 - damping from the first round on, so what such vertices give is
    summed once, and a round looks at the other vertices and at the edges between them."""
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    reached = materialize(edges.select(F.col("dst").alias("id")).distinct(), "rank-reached")
    still = materialize(_meet(vertices(edges), reached, "id", "left_anti"), "rank-still")
    shared = _meet(edges.select("src", "dst"), out, "src")
    placed = materialize(cut(_meet(shared, reached.withColumnRenamed("id", "src"), "src")), "rank-edges")
    routed = materialize(routes(placed), "rank-routes")
    from_still = _meet(shared, still.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(1 / F.col("out")).alias("still"))
    start = _meet(reached, from_still, "id", "left").select("id", F.coalesce("still", F.lit(0.0)).alias("still"), F.lit(1.0).alias("value"))
    ranks, k, rest = materialize(start, "rank-0"), 0, 1.0
    moving = damping if rounds is None and not still.isEmpty() else 0.0  # by so much the ranks of the others move in the first round
    while rounds is None or k < rounds:
        k += 1
        near = edge_contexts(placed, routed, ranks.select("id", "value", F.lit(True).alias("active")), both_ends=False)
        given = aggregate_messages(near, F.sum, F.col("src_value") / F.col("out"))
        value = F.lit(1 - damping) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("still") * rest)
        new = _meet(ranks, given, "id", "left").select("id", "still", F.col("value").alias("old"), value.alias("value"))
        old, ranks, rest = ranks, materialize(new, f"rank-{k}"), 1 - damping
        discard(old)
        if rounds is None and max(moving, ranks.agg(F.max(F.abs(F.col("value") - F.col("old")))).first()[0] or 0.0) <= tolerance:
            break
        moving = 0.0
    discard(placed, routed, reached)
    return ranks.select("id", "value").union(still.select("id", F.lit(rest).alias("value")))


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, value): the smallest vertex of each strongly connected component.

    Vertices take the smallest id that reaches them; within such a colour, those
    that reach its root backwards form the root's component and go. The rest goes on.
    """
    left = materialize(edges.select("src", "dst").where("src != dst").distinct(), "strong-edges")
    ids, done = materialize(vertices(edges), "strong-ids"), None
    while not ids.isEmpty():
        colour = pregel(left, ids.select("id", F.col("id").alias("value")), F.col("src_value"), F.min, F.least("value", "got"))
        c = lambda end: colour.select(F.col("id").alias(end), F.col("value").alias(f"{end}_colour"))
        inside = _meet(_meet(left, c("src"), "src"), c("dst"), "dst").where("src_colour = dst_colour")
        start = colour.select("id", F.when(F.col("id") == F.col("value"), F.col("value")).alias("value"))
        back = pregel(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, F.col("src_value"), F.min, F.coalesce("value", "got"))
        found = materialize(back.where("value IS NOT NULL"), "strong-found")
        done = found if done is None else done.union(found)
        ids = materialize(_meet(ids, found, "id", "left_anti"), "strong-ids")
        left = materialize(_meet(_meet(left, ids.withColumnRenamed("id", "src"), "src"), ids.withColumnRenamed("id", "dst"), "dst").select("src", "dst"), "strong-edges")
    return done if done is not None else ids.select("id", F.col("id").alias("value"))


def svd_plus_plus(ratings: DataFrame, factors: int = 4, rounds: int = 5, rate: float = 0.005, decay: float = 0.02) -> tuple[DataFrame, DataFrame, list[float]]:
    """Factors of ratings (user, item, rating) with implicit feedback: users, items, and the root mean square error before each round.

    A rating is estimated as mean + user bias + item bias + q . (p + the sum of the
    y of all items that the user has rated, over the root of their number). Each
    round takes one gradient step from all ratings: an edge sends the steps of p and
    the user's bias to its user and those of q, y and the item's bias to its item.
    Factors start from hashes of the ids. Vectors are columns, so all is done by
    joins and sums; ratings are written once, cut in two dimensions like edges.
    """
    each = lambda name: [f"{name}{k}" for k in range(factors)]
    start = lambda c, seed: ((F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(2001)) - 1000) / 10_000.0)
    grouped = ratings.where("user IS NOT NULL AND item IS NOT NULL AND rating IS NOT NULL").groupBy("user", "item").agg(F.avg("rating").alias("rating"))
    placed = materialize(cut(grouped.select(F.col("user").alias("src"), F.col("item").alias("dst"), "rating")), "svd-ratings")
    mean = placed.agg(F.avg("rating")).first()[0]
    zero = F.lit(0.0)
    users = placed.groupBy(F.col("src").alias("user")).agg((1 / F.sqrt(F.count("*"))).alias("norm"))
    users = materialize(users.select("user", "norm", zero.alias("bu"), *(start("user", k).alias(c) for k, c in enumerate(each("p")))), "svd-users")
    items = placed.select(F.col("dst").alias("item")).distinct()
    seeds = [(c, 100 * (1 + n) + k) for n, name in enumerate("qy") for k, c in enumerate(each(name))]
    items = materialize(items.select("item", zero.alias("bi"), *(start("item", k).alias(c) for c, k in seeds)), "svd-items")
    ends = materialize(placed.select(F.col("src").alias("id"), "part", F.lit(True).alias("user")).union(placed.select("dst", "part", F.lit(False))).distinct(), "svd-routes")
    sent = lambda table, key, end: _meet(ends.where("user" if key == "user" else "NOT user").select("part", F.col("id").alias(end)), table.withColumnRenamed(key, end), end)
    errors = []
    for k in range(rounds):
        implicit = _meet(placed, sent(items.select("item", *each("y")), "item", "dst"), ["part", "dst"]).groupBy(F.col("src").alias("user")).agg(*(F.sum(c).alias(f"s{c}") for c in each("y")))
        whole = _meet(users, implicit, "user").select("user", "bu", "norm", *each("p"), *((F.col(p) + F.col("norm") * F.col(f"s{y}")).alias(f"z{i}") for i, (p, y) in enumerate(zip(each("p"), each("y")))))
        met = _meet(_meet(placed, sent(whole, "user", "src"), ["part", "src"]), sent(items, "item", "dst"), ["part", "dst"])
        product = sum((F.col(q) * F.col(z) for q, z in zip(each("q"), each("z"))), F.lit(0.0))
        met = materialize(met.withColumn("e", F.col("rating") - (F.lit(mean) + F.col("bu") + F.col("bi") + product)), f"svd-{k}")
        errors.append(met.agg(F.sqrt(F.avg(F.col("e") * F.col("e")))).first()[0])
        step = lambda gradient, own: F.sum(gradient - decay * F.col(own)) * rate
        to_user = met.groupBy(F.col("src").alias("user")).agg(step(F.col("e"), "bu").alias("dbu"), *(step(F.col("e") * F.col(q), p).alias(f"d{p}") for p, q in zip(each("p"), each("q"))))
        to_item = met.groupBy(F.col("dst").alias("item")).agg(
            step(F.col("e"), "bi").alias("dbi"),
            *(step(F.col("e") * F.col(z), q).alias(f"d{q}") for q, z in zip(each("q"), each("z"))),
            *(step(F.col("e") * F.col("norm") * F.col(q), y).alias(f"d{y}") for y, q in zip(each("y"), each("q"))),
        )
        moved = lambda table, by, key, kept, names: _meet(table, by, key).select(key, *kept, *((F.col(n) + F.col(f"d{n}")).alias(n) for n in names))
        new_users = materialize(moved(users, to_user, "user", ["norm"], ["bu", *each("p")]), f"svd-users-{k}")
        new_items = materialize(moved(items, to_item, "item", [], ["bi", *each("q"), *each("y")]), f"svd-items-{k}")
        discard(users, items, met)
        users, items = new_users, new_items
    discard(placed, ends)
    return users, items, errors
