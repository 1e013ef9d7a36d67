"""Similarity search and range search over a trajectory column.

Null and empty trajectories match nothing. Ties of a nearest-neighbour search
go to the smaller id, a null one last. A search over a frame that has an index reads the tiles
that the query can't be too far from, and their summary columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.distance import DELTA, EPS, box_bound, check_name, distance_to, lower_bound_sql
from wayfold.operators.index import PIVOTS, PREFIX, lookup


def literal(query: list[list[float]]) -> str:
    """SQL text of a trajectory."""
    if not query:
        return "CAST(array() AS ARRAY<ARRAY<DOUBLE>>)"
    return "array(" + ", ".join("array(" + ", ".join(f"{float(c)!r}D" for c in p) + ")" for p in query) + ")"


def _box_gap(p: list[float], low: list[float], high: list[float]) -> float:
    """Distance of a point from a box."""
    return math.sqrt(sum(max(a - c, c - b, 0.0) ** 2 for c, a, b in zip(p, low, high)))


def tile_bound(tile, query: list[list[float]], name: str, bar: float = math.inf, eps: float = EPS, levels: int = 3) -> float:
    """A bound that no trajectory of the tile has a smaller distance than, by the first ``levels`` of the tree.

    The levels are first points, last points and pivots. Each leaves the next
    what it hasn't used of the bar; once that is spent the descent ends.
    """
    edit = name in ("EDR", "LCSS")
    boxes = [(query[0], "first"), (query[-1], "last"), *((None, f"pivot{j}") for j in range(min(PIVOTS, tile["pivots"] or 0)))]
    if tile["least"] == 1 and (edit or len(query) == 1):
        del boxes[1]  # the last point may be the first
    by_length = max(tile["least"] - len(query), len(query) - tile["most"], 0) if edit else 0
    spent = 0.0
    for end, level in boxes:
        if levels < 3 and level[:5] not in ("first", "last", "pivot")[:levels]:
            continue
        low, high = tile[f"{level}_low"], tile[f"{level}_high"]
        if edit or end is None:  # any point of the query may be the one that it is matched with
            gap = min(_box_gap(q, low, high) for q in query)
            gap = float(gap > eps * (1 + 1e-12)) if edit else gap
        else:
            gap = _box_gap(end, low, high)
        spent = max(spent, gap) if name == "FRECHET" else spent + gap
        if spent > bar:
            break
    # Sums of rounded distances, which a distance itself may fall short of by a little.
    return max(spent, by_length) if edit else spent * (1 - 1e-12)


def _pivot_bound(query: list[list[float]], name: str, eps: float) -> Column:
    """What the pivots of a row add to a distance beyond its ends: each is matched with some point of the query, or costs an edit."""
    dims = len(query[0])
    points = F.array(*(F.array(*(F.lit(float(c)) for c in p)) for p in query))

    def nearest(p: Column) -> Column:
        def squared(q: Column) -> Column:
            terms = [(p[k] - q[k]) * (p[k] - q[k]) for k in range(dims)]
            return sum(terms[1:], terms[0])

        return F.sqrt(F.array_min(F.transform(points, squared)))

    own, start = F.col(f"{PREFIX}pivots"), F.lit(0.0)
    if name == "DTW":
        return F.aggregate(own, start, lambda s, p: s + nearest(p))
    if name == "FRECHET":
        return F.aggregate(own, start, lambda s, p: F.greatest(s, nearest(p)))
    return F.aggregate(own, start, lambda s, p: s + F.when(nearest(p) > eps, 1.0).otherwise(0.0))


def _pruned(df: DataFrame, column: str, query: list[list[float]], name: str, bar: float, eps: float) -> DataFrame:
    """Rows that the lower bounds leave: of an index the tiles, boxes, ends and pivots; then ends and box of the query."""
    dims = len(query[0])
    low, high = [min(p[k] for p in query) for k in range(dims)], [max(p[k] for p in query) for k in range(dims)]
    ends = F.expr(lower_bound_sql(name, column, literal(query), dims))
    found = lookup(df, column)
    if found is not None:
        df = found.rows(lambda t: tile_bound(t, query, name, bar, eps) <= bar)
        if name in ("DTW", "FRECHET"):
            # Plain comparisons, which reach the files' statistics.
            for k in range(dims):
                wide = bar * (1 + 1e-9) + 1e-9
                for end, q in (("first", query[0]), ("last", query[-1])):
                    df = df.where(F.col(f"{PREFIX}{end}{k}").between(q[k] - wide, q[k] + wide))
                df = df.where((F.col(f"{PREFIX}high{k}") >= low[k] - wide) & (F.col(f"{PREFIX}low{k}") <= high[k] + wide))
        else:
            df = df.where(F.col(f"{PREFIX}points").between(len(query) - bar, len(query) + bar))
        level = _pivot_bound(query, name, eps)
        # The ends' cost is spent before the pivots are looked at; edits of pivots count by themselves.
        df = df.where((ends <= bar) & (level <= bar - ends * (1 - 1e-12) + 1e-9 if name == "DTW" else level <= bar))
    df = df.where(f"size({column}) > 0").where(ends <= bar)
    return df.where(box_bound(name, column, low, high, eps) <= bar)


def threshold_search(df: DataFrame, query: list[list[float]], column: str, name: str, bar: float, eps: float = EPS, delta: int = DELTA) -> DataFrame:
    """Rows whose distance to the query is at most ``bar``, with the distance as the last column."""
    name = check_name(name)
    if not query:
        return df.where("false").withColumn("distance", F.lit(None).cast("double"))
    near = _pruned(df, column, query, name, bar, eps)
    return near.withColumn("distance", distance_to(name, F.col(column), query, eps, delta)).where(F.col("distance") <= bar).select(*df.columns, "distance")


def knn_search(df: DataFrame, query: list[list[float]], column: str, name: str, k: int, id_col: str = "id", eps: float = EPS, delta: int = DELTA) -> DataFrame:
    """The k nearest rows by (distance, id).

    The k rows of the least lower bounds give a distance that the k-th nearest
    can't exceed; only rows whose bounds stay within it are measured.
    """
    name = check_name(name)
    if not query or k <= 0:
        return df.where("false").withColumn("distance", F.lit(None).cast("double"))
    found_index = lookup(df, column)
    whole = (df if found_index is None else found_index.data).where(f"size({column}) > 0")
    bound = F.expr(lower_bound_sql(name, column, literal(query), len(query[0])))
    likely = whole.select(column, bound.alias("bound"), F.col(id_col).alias("id")).orderBy("bound", F.col("id").asc_nulls_last()).limit(k)
    found = likely.select(distance_to(name, F.col(column), query, eps, delta).alias("d")).agg(F.max("d").alias("bar"), F.count("d").alias("n")).first()
    if found["n"] >= k:
        whole = _pruned(df, column, query, name, found["bar"] * (1 + 1e-12), eps)
    return whole.withColumn("distance", distance_to(name, F.col(column), query, eps, delta)).orderBy("distance", F.col(id_col).asc_nulls_last()).limit(k).select(*df.columns, "distance")


def _each(column: str, test, mode: str) -> Column:
    if mode not in ("contains", "intersects"):
        raise ValueError("mode is contains or intersects")
    return (F.size(column) > 0) & (F.forall(column, test) if mode == "contains" else F.exists(column, test))


def mbr_range_search(df: DataFrame, low: list[float], high: list[float], column: str, mode: str = "contains") -> DataFrame:
    """Rows whose points all lie in the box, borders included; mode "intersects": any point."""

    def inside(p: Column) -> Column:
        test = p[0].between(low[0], high[0])
        for k in range(1, len(low)):
            test = test & p[k].between(low[k], high[k])
        return test

    found, source = lookup(df, column), df
    if found is not None:
        sides = ("first_low", "first_high") if mode == "contains" else ("low", "high")
        source = found.rows(lambda t: all(t[sides[0]][k] <= high[k] and t[sides[1]][k] >= low[k] for k in range(len(low))))
        for k in range(len(low)):
            least, most = F.col(f"{PREFIX}low{k}"), F.col(f"{PREFIX}high{k}")
            source = source.where((least >= low[k]) & (most <= high[k]) if mode == "contains" else (most >= low[k]) & (least <= high[k]))
    return source.where(_each(column, inside, mode)).select(*df.columns)


def circle_range_search(df: DataFrame, centre: list[float], radius: float, column: str, mode: str = "contains") -> DataFrame:
    """Rows whose points all lie within the radius, border included; mode "intersects": any point."""

    def inside(p: Column) -> Column:
        terms = [(p[k] - centre[k]) * (p[k] - centre[k]) for k in range(len(centre))]
        return F.sqrt(sum(terms[1:], terms[0])) <= radius

    found, source = lookup(df, column), df
    if found is not None:
        sides = ("first_low", "first_high") if mode == "contains" else ("low", "high")
        source = found.rows(lambda t: _box_gap(centre, t[sides[0]], t[sides[1]]) <= radius * (1 + 1e-12))
        for k in range(len(centre)):
            source = source.where((F.col(f"{PREFIX}low{k}") <= centre[k] + radius) & (F.col(f"{PREFIX}high{k}") >= centre[k] - radius))
    return source.where(_each(column, inside, mode)).select(*df.columns)
