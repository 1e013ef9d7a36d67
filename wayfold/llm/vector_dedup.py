"""Near duplicates of embeddings by an inverted multi-index.

1. Vectors that are null, empty, zero, or hold a null or non-finite component
   link with nothing. Equal vectors form a class, so copies cost nothing
   further. Vectors link with those of their own dimension: each dimension of
   more than ``FEW`` classes has its own index, one of fewer is one cell.
2. *Codebooks.* The halves of unit vectors are clustered apart from each other,
   on a bounded sample (``SAMPLE`` classes by hash of the value). A pair of centres
   is a cell of the product grid; the number of centres follows the root of the
   number of vectors, so a cell's size does not grow with the table, up to
   ``CENTRES``, that is 16.8 million classes; beyond, cells grow and are met in
   more blocks. Every vector is indexed in the cell of its two nearest centres.
3. *Traversal.* A vector visits cells in the order of the summed squared
   distances of its halves to the cells' centres, by the multi-sequence
   algorithm, up to a margin above the distance of its own cell. The margin is
   the largest of several, each of which lets ``RECALL`` of some pairs meet:
   pairs made at the bar exactly, and for each of the ``BANDS`` of cosines the
   pairs that ``QUERIES`` vectors form with all rows of the table. So a band
   with many pairs can't set the margin for the others.
4. *Verification.* Visitors and members of a cell meet in blocks of bounded
   size; cosines are computed in double precision. A pair counts if either
   visits the other's cell, and counts once for each. Blocks send each vector's
   number of links and a label of its component in the block, never pairs.

Other columns are ignored; an empty table gives an empty result. A row whose id
is null links with nothing. Rows that repeat an id count each by its vector;
their component is named by the smallest id that it holds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import materialize, ship
from wayfold.llm.components import connected

#: Classes of a dimension from which it has an index of its own.
FEW = 256
SAMPLE, RECALL, CELL, CENTRES, BLOCK = 8192, 0.999, 64, 512, 2048
#: Vectors that are held against all rows; bands of the cosine from the bar to 1; pairs from which a band counts; steps of a margin of 1.
QUERIES, BANDS, LEAST_PAIRS, STEPS = 512, 4, 100, 256


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, v): the components as they came, null for a vector that links with nothing."""
    for batch in batches:
        out = []
        kind = _kind(pa.types.is_float32(batch.schema.field(1).type.value_type))
        for v in batch.column(1).to_pylist():
            ok = v is not None and len(v) and None not in v
            a = np.array(v, kind) if ok else None
            out.append(a.tobytes() if ok and np.isfinite(a).all() and a.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])


def _kind(single: bool) -> str:
    return "<f4" if single else "<f8"


def unit(rows: list[bytes], kind: str) -> np.ndarray:
    a = np.frombuffer(b"".join(rows), kind).astype("<f8").reshape(len(rows), -1)
    top = np.abs(a).max(1, keepdims=True)
    a = a / top  # squares neither overflow nor vanish
    return a / np.sqrt((a * a).sum(1, keepdims=True))


def centres(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means; an emptied centre moves to the point farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        near = d.argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        far = np.argsort(-(d.min(1) + (x * x).sum(1)), kind="stable")
        c[n == 0] = x[far[: (n == 0).sum()]]
    return c


class MultiIndex:
    def __init__(self, sample: np.ndarray, k: int, bar: float):
        self.half = sample.shape[1] // 2
        k = min(k, len(sample))
        self.books = (centres(sample[:, : self.half], k, 1), centres(sample[:, self.half :], k, 2))
        self.k = k
        self.margin = self._at_the_bar(sample, bar)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = (x[:, : self.half], x[:, self.half :])
        return tuple((p * p).sum(1)[:, None] + (c * c).sum(1) - 2 * p @ c.T for p, c in zip(parts, self.books))

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.k + b.argmin(1)

    def traverse(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """The cells of one vector up to the margin, by the multi-sequence algorithm."""
        order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        da, db = a[order_a].tolist(), b[order_b].tolist()
        most = da[0] + db[0] + self.margin
        heap, seen, out = [(da[0] + db[0], 0, 0)], {(0, 0)}, []
        while heap and (heap[0][0] <= most):
            _, i, j = heapq.heappop(heap)
            out.append(int(order_a[i] * self.k + order_b[j]))
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < len(da) and q < len(db) and (p, q) not in seen:
                    seen.add((p, q))
                    heapq.heappush(heap, (da[p] + db[q], p, q))
        return out

    def needed(self, q: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray], qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
        """For pairs of two sets, by their distances: the margin at which one of the pair visits the other's cell."""

        def above(mine, other, m, o):
            to = mine[0][m, other[0].argmin(1)[o]] + mine[1][m, other[1].argmin(1)[o]]
            return to - (mine[0].min(1) + mine[1].min(1))[m]

        return np.minimum(above(q, x, qi, xi), above(x, q, xi, qi))

    def _at_the_bar(self, x: np.ndarray, bar: float) -> float:
        """The RECALL quantile over pairs of a vector of the sample and one made at the bar from it."""
        rng = np.random.default_rng(3)
        x = np.concatenate([x[:2048]] * -(-2048 // min(len(x), 2048)))
        r = rng.normal(size=x.shape)
        r -= (r * x).sum(1, keepdims=True) * x
        y = bar * x + np.sqrt(1 - bar * bar) * r / np.maximum(np.sqrt((r * r).sum(1, keepdims=True)), 1e-12)
        own = np.arange(len(x))
        return self.widened(self.needed(self.distances(x), self.distances(y), own, own))

    @staticmethod
    def widened(margins: np.ndarray) -> float:
        return float(np.quantile(margins, RECALL, method="higher")) + 1e-9


def _margins(rows: DataFrame, index: MultiIndex, ids: np.ndarray, queries: np.ndarray, bar: float, kind: str) -> float:
    """The largest margin that any band of cosines needs, over the pairs of the queries with all rows (rep, n, v)."""
    own = index.distances(queries)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            reps, values = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for s in range(0, len(reps), 2048):
                x = unit([bytes(v) for v in values[s : s + 2048]], kind)
                cosine = queries @ x.T
                q, m = np.nonzero(cosine >= bar)
                other = ids[q] != reps[s + m]
                q, m = q[other], m[other]
                band = np.minimum((cosine[q, m] - bar) / max(1 - bar, 1e-12) * BANDS, BANDS - 1).astype(np.int64)
                step = np.ceil(index.needed(own, index.distances(x), q, m) * STEPS).astype(np.int64)
                for (b, t), n in zip(*(v.tolist() for v in np.unique(np.stack((band, step), 1), axis=0, return_counts=True))):
                    total[b, t] = total.get((b, t), 0) + n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total]), pa.array(list(total.values()))], ["band", "step", "n"])

    found = rows.mapInArrow(count, "band long, step long, n long").groupBy("band", "step").agg(F.sum("n").alias("n")).collect()
    most = 0.0
    for band in range(BANDS):
        steps = sorted((r["step"], r["n"]) for r in found if r["band"] == band)
        n = np.cumsum([c for _, c in steps])
        if len(n) and n[-1] >= LEAST_PAIRS:
            most = max(most, steps[int(np.searchsorted(n, RECALL * n[-1]))][0] / STEPS)
    return most


def _labels(q: np.ndarray, m: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each vertex reaches over edges between places q and m."""
    label = ids.copy()
    while True:
        old = label.copy()
        np.minimum.at(label, q, label[m])
        np.minimum.at(label, m, label[q])
        if (label == old).all():
            return label


def _meet(bar: float, kind: str):
    def meet(block: pd.DataFrame) -> pd.DataFrame:
        """Of one block of a cell's members and one of its visitors: number of links and component of each that has some."""
        mine, guest = block[block["inside"]], block[~block["inside"]]
        if not len(mine) or not len(guest):
            return pd.DataFrame({"id": [], "links": [], "label": []}).astype("int64")
        x, y = unit([bytes(v) for v in guest["v"]], kind), unit([bytes(v) for v in mine["v"]], kind)
        q, m = np.nonzero(x @ y.T >= bar)
        qi, mi = guest["id"].to_numpy(), mine["id"].to_numpy()
        other = qi[q] != mi[m]
        q, m = q[other], m[other]
        links = np.zeros(len(qi) + len(mi), np.int64)
        np.add.at(links, q, mine["n"].to_numpy()[m])
        lists = mine["visits"].tolist()
        table = np.full((len(lists), max(map(len, lists))), -1, np.int64)
        for k, v in enumerate(lists):
            table[k, : len(v)] = v
        back = np.zeros(len(q), bool)  # the member finds this visitor itself
        for s in range(0, len(q), 1 << 18):
            back[s : s + (1 << 18)] = (table[m[s : s + (1 << 18)]] == guest["home"].to_numpy()[q[s : s + (1 << 18)]][:, None]).any(1)
        np.add.at(links, len(qi) + m[~back], guest["n"].to_numpy()[q[~back]])
        ids = np.concatenate((qi, mi))
        label = _labels(q, len(qi) + m, ids)
        some = (links > 0) | (label != ids)
        return pd.DataFrame({"id": ids[some], "links": links[some], "label": label[some]})

    return meet


PLACED = "id long, n long, v binary, width long, home long, visits array<long>"


def _indexed(own: DataFrame, width: int, total: int, bar: float, kind: str) -> DataFrame:
    """The classes of one dimension in the cells of an index made for it, as PLACED."""
    sample = [(r["id"], bytes(r["v"])) for r in own.orderBy(F.xxhash64("v")).limit(SAMPLE).collect()]
    points = unit([v for _, v in sample], kind)
    index = MultiIndex(points, min(CENTRES, max(2, int(np.ceil(np.sqrt(total / CELL))))), bar)
    some = np.random.default_rng(4).permutation(len(sample))[:QUERIES]
    index.margin = max(index.margin, _margins(own, index, np.array([i for i, _ in sample])[some], points[some], bar, kind))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit([bytes(v) for v in batch.column(2).to_pylist()], kind)
            a, b = index.distances(x)
            home = a.argmin(1) * index.k + b.argmin(1)
            visits = [index.traverse(a[k], b[k]) for k in range(len(x))]
            columns = [*batch.columns, pa.array(np.full(len(x), width)), pa.array(home), pa.array(visits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "v", "width", "home", "visits"])

    return own.mapInArrow(assign, PLACED)


def vector_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", bar: float = 0.9) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = _kind(single)
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("e"))
    clean = materialize(slim.mapInArrow(_clean, "vec_id long, v binary"), "vector-clean")
    usable = clean.where("v IS NOT NULL AND vec_id IS NOT NULL")
    classes = usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("id"), "n", "v", "rep"), "vector-classes")
    own = classes.select("id", "n", "v")
    # One row for each dimension that has an index of its own.
    large = {r["bytes"]: r["n"] for r in classes.groupBy(F.length("v").alias("bytes")).agg(F.count("*").alias("n")).where(F.col("n") > FEW).collect()}
    rest = own.where(~F.length("v").isin(list(large))) if large else own
    placed = rest.select("id", "n", "v", F.length("v").cast("long").alias("width"), F.lit(0).cast("long").alias("home"), F.array(F.lit(0).cast("long")).alias("visits"))
    for width, total in large.items():
        placed = placed.unionByName(_indexed(own.where(F.length("v") == width), width, total, bar, kind))
    placed = materialize(placed, "vector-cells")
    blocks = lambda n: F.ceil(F.count("*") / BLOCK).alias(n)
    members = placed.groupBy("width", F.col("home").alias("cell")).agg(blocks("members")).where("members > 1")
    visitors = placed.select("width", F.explode("visits").alias("cell")).groupBy("width", "cell").agg(blocks("visitors")).where("visitors > 1")
    crowded = materialize(members.join(visitors, ["width", "cell"], "full"), "vector-crowded")  # a row for each BLOCK vectors or visits at most
    salt = F.xxhash64("id")
    m, v = (F.coalesce(c, F.lit(1).cast("long")) for c in ("members", "visitors"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    inside = placed.withColumn("cell", F.col("home")).join(crowded, ["width", "cell"], "left")
    inside = inside.withColumn("mb", F.pmod(salt, m)).withColumn("vb", every(v)).withColumn("inside", F.lit(True))
    guests = placed.withColumn("cell", F.explode("visits")).join(crowded, ["width", "cell"], "left")
    guests = guests.withColumn("vb", F.pmod(salt, v)).withColumn("mb", every(m)).withColumn("inside", F.lit(False))
    guests = guests.withColumn("visits", F.lit(None).cast("array<long>"))
    names = ["width", "cell", "mb", "vb", "inside", "id", "n", "v", "home", "visits"]
    met = inside.select(names).unionByName(guests.select(names)).groupBy("width", "cell", "mb", "vb")
    parts = materialize(met.applyInPandas(_meet(bar, kind), "id long, links long, label long"), "vector-links")
    found = connected(parts.where("id != label").select(F.col("id").alias("a"), F.col("label").alias("b")), "vector-components")
    named = found.join(classes.select("id", "rep"), "id")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("id", "component_id")
    counted = parts.groupBy("id").agg(F.sum("links").alias("links"))
    linked = classes.join(counted, "id", "left").join(named, "id", "left")
    total = (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    linked = materialize(linked.select("v", total, F.coalesce("component_id", "rep").alias("component_id")), "vector-result")
    out = clean.join(linked, "v", "left")
    out = out.select(
        "vec_id",
        F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("n_links")), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("component_id")), F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
