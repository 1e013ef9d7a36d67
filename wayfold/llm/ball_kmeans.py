"""Ball k-means over whole-number vectors.

Vectors with exactly ``dims`` components, none of them null or non-finite, are
turned into whole numbers, floor(scale * x), and clustered by a fixed number of
rounds; all comparisons are of whole numbers, so results are exact and the same
for any partitioning. Ties go to the smaller cluster number.

1. *Balls.* After a first assignment every vector is written with its cluster.
   The members of a cluster form a ball: the cluster's present centroid, and a
   radius that no member lies beyond, namely the greatest distance when they
   were assigned and the way that the centroid has moved since, rounded up.
2. *Neighbours.* Another centroid can take a member only if it is not farther
   from the ball's centroid than twice the radius; the others are left out for
   the whole ball.
3. *Core and annuli.* Neighbours stand in the order of their distance. A member
   is in the stable core, and keeps its cluster, if twice its own distance is
   less than that of the first neighbour. Otherwise it lies in an annulus, and
   is compared exactly with just those neighbours that are not farther from the
   centroid than twice its own distance.
4. *Rounds.* Each round reads the vectors, and every task sends a count and the
   sums of its vectors for each cluster. Balls need not be those of the last
   round for the result to be exact, so vectors are written again only when more
   than ``MOVED`` of them have left their ball.

The driver holds ``clusters`` centroids and sums, whatever the table's size.

Vectors that are not kept give no row. Rows that repeat an id or a vector count
each; a row without an id takes part, but is no starting centroid. With fewer
than ``clusters`` rows with ids, as many clusters are used; without any the
result is empty. Among equal hashes the smaller vector starts first. A whole
number beyond a long saturates at its ends; a distance or inertia beyond a long
is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import discard, materialize, ship

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10
#: Share of the vectors that may lie outside their ball before balls are made anew.
MOVED = 0.25
#: Whole numbers below this are compared in longs, others as Python's numbers.
SAFE = 1 << 27
LONG = 1 << 63
WHOLE = pa.decimal128(38, 0)


def whole_numbers(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, v) of the kept vectors."""
    v = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("x")).where(
        (F.size("x") == dims) & F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    )
    return kept.select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


class Balls:
    """Centroids, and what the members of each ball are compared with."""

    def __init__(self, centroids: list[list[int]], anchors: list[list[int]] | None = None, radii: list[int] | None = None):
        self.centroids, self.anchors, self.radii = centroids, anchors, radii
        self.wide = any(abs(c) >= SAFE for own in centroids for c in own)
        k = len(centroids)
        apart = [[sum((a - b) ** 2 for a, b in zip(x, y)) for y in centroids] for x in centroids]
        self.neighbours = []
        for i in range(k):
            near = sorted((apart[i][j], j) for j in range(k) if j != i)
            if radii is not None:  # no member lies beyond the radius of its cluster's first ball and the way of its centroid since
                radius = radii[i] + _up(sum((a - b) ** 2 for a, b in zip(centroids[i], anchors[i])))
                near = [(d, j) for d, j in near if d <= 4 * radius * radius]
            self.neighbours.append(near)

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector and its squared distance; ``own`` is the ball that it is a member of, or -1."""
        wide = self.wide or bool(len(x)) and max(abs(int(x.max())), abs(int(x.min()))) >= SAFE
        x = x.astype(object) if wide else x
        c = np.array(self.centroids, dtype=x.dtype)
        far = lambda rows, k: ((x[rows] - c[k]) ** 2).sum(1)
        cluster, best = own.copy(), np.zeros(len(x), x.dtype)
        loose = np.flatnonzero(own < 0)
        if len(loose):
            cluster[loose], best[loose] = 0, far(loose, 0)
            for j in range(1, len(c)):
                d = far(loose, j)
                closer = d < best[loose]
                cluster[loose[closer]], best[loose[closer]] = j, d[closer]
        for i in np.unique(own[own >= 0]).tolist():
            members = np.flatnonzero(own == i)
            mine = far(members, i)
            best[members] = mine
            for apart, j in self.neighbours[i]:
                reached = mine >= -(-apart // 4)  # the rest is nearer to the centroid than half way to this neighbour
                if not reached.any():
                    break
                rows = members[reached]
                d = far(rows, j)
                closer = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
                cluster[rows[closer]], best[rows[closer]] = j, d[closer]
        return cluster, best


def _up(square: int) -> int:
    """The root of a whole number, rounded up."""
    root = math.isqrt(square)
    return root + (root * root < square)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dims)


def _longs(values: np.ndarray) -> pa.Array:
    """Longs; null where a number is beyond."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(x) if x < LONG else None for x in values], pa.int64())


def assigned(rows: DataFrame, balls: Balls, dims: int, keep_vector: bool) -> DataFrame:
    """Rows (id[, v], cluster, distance) under the present centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).to_numpy() if batch.num_columns > 2 else np.full(batch.num_rows, -1)
            cluster, best = balls.assign(_matrix(batch.column(1), dims), own.astype(np.int64))
            kept = [batch.column(0), batch.column(1)] if keep_vector else [batch.column(0)]
            columns = [*kept, pa.array(cluster, pa.int32()), _longs(best)]
            yield pa.RecordBatch.from_arrays(columns, ["id", *["v"] * keep_vector, "cluster", "distance"])

    columns = ["id", "v", "cluster"] if "cluster" in rows.columns else ["id", "v"]
    return rows.select(*columns).mapInArrow(run, f"id long, {'v array<long>, ' * keep_vector}cluster int, distance long")


def moments(rows: DataFrame, balls: Balls, dims: int) -> tuple[dict[int, tuple[int, list[int]]], int, int]:
    """Of each cluster under the present centroids the count and the sums; how many vectors left their ball; how many there are."""
    k = len(balls.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, moved = [0] * k, [[0] * dims for _ in range(k)], 0
        for batch in batches:
            x, own = _matrix(batch.column(0), dims), batch.column(1).to_numpy().astype(np.int64)
            cluster, _ = balls.assign(x, own)
            moved += int((cluster != own).sum())
            # In halves of 32 bits, whose sums over a batch stay exact.
            high, low = x >> 32, x & 0xFFFFFFFF
            for j in np.unique(cluster).tolist():
                mine = cluster == j
                n[j] += int(mine.sum())
                for d, (a, b) in enumerate(zip(high[mine].sum(0).tolist(), low[mine].sum(0).tolist())):
                    sums[j][d] += (a << 32) + b
        used = [j for j in range(k) if n[j]]
        rest = [moved] + [0] * (len(used) - 1)
        whole = [[Decimal(s) for s in sums[j]] for j in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([n[j] for j in used], pa.int64()), pa.array(rest[: len(used)], pa.int64()), pa.array(whole, pa.list_(WHOLE))],
            ["cluster", "n", "moved", "sums"],
        )

    each = rows.select("v", "cluster").mapInArrow(run, "cluster int, n long, moved long, sums array<decimal(38,0)>")
    total = each.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved"), *(F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dims)))
    found = total.collect()  # a row for each cluster
    sums = {r["cluster"]: (r["n"], [int(r[f"s{d}"]) for d in range(dims)]) for r in found}
    return sums, sum(r["moved"] for r in found), sum(r["n"] for r in found)


def _radii(rows: DataFrame, k: int) -> list[int] | None:
    """The greatest distance in each cluster, rounded up; none where one isn't known."""
    found = {r["cluster"]: r for r in rows.groupBy("cluster").agg(F.max("distance").alias("d"), F.bool_or(F.col("distance").isNull()).alias("beyond")).collect()}
    if any(r["beyond"] for r in found.values()):
        return None
    return [_up(found[j]["d"]) if j in found else 0 for j in range(k)]


def starting_centroids(rows: DataFrame, k: int, prefix: str = "3:") -> list[list[int]]:
    """The vectors of the k smallest hashes of prefix and id."""
    named = rows.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")).cast("binary"), 256).alias("h"), "v")
    return [list(r["v"]) for r in named.orderBy("h", "v").limit(k).collect()]


def ball_kmeans(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE
) -> tuple[DataFrame, list[list[int]]]:
    """Rows (id, cluster, distance) after the rounds and a last assignment, and the final centroids."""
    spark = vectors.sparkSession
    ship(spark)
    plain = whole_numbers(vectors, dims, scale, id_col, vector_col)
    centroids = starting_centroids(plain, clusters)
    if not centroids:
        return spark.createDataFrame([], "id long, cluster int, distance long"), []
    rows, balls, stale = plain, Balls(centroids), True
    for _ in range(rounds):
        if stale:
            old, rows = rows, materialize(assigned(rows, balls, dims, True), "balls")
            if old is not plain:
                discard(old)
            balls = Balls(centroids, centroids, _radii(rows, len(centroids)))
        sums, moved, n = moments(rows, balls, dims)
        centroids = [[s // sums[j][0] for s in sums[j][1]] if j in sums else own for j, own in enumerate(centroids)]
        balls, stale = Balls(centroids, balls.anchors, balls.radii), moved > MOVED * n
    out = materialize(assigned(rows, balls, dims, False), "clusters")
    if rows is not plain:
        discard(rows)
    return out, centroids


def cluster_digests(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, centroids = ball_kmeans(vectors, id_col, vector_col)
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.bool_or(F.col("distance").isNull()).alias("beyond")).collect()
    inertia = {r["cluster"]: None if r["beyond"] else int(r["d"]) for r in sums}  # a row for each cluster
    total = None if None in inertia.values() else sum(inertia.values())
    long = lambda x: F.lit(x if x is not None and x < LONG else None).cast("long")
    own = lambda values, kind: F.element_at(F.array(*values) if values else F.array().cast(f"array<{kind}>"), F.col("cluster") + 1)
    digests = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]
    return rows.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        own([long(inertia.get(j, 0)) for j in range(len(centroids))], "long").alias("cluster_inertia"),
        long(total).alias("inertia"),
        own(digests, "string").alias("centroid_sha256"),
    )
