"""Similarity joins of two trajectory frames over the tiles of two indexes.

Copies of a trajectory are joined as one row that holds their ids, or as a row
for about every ``COPIES`` of them, so that the distances are measured once for
all; pairs of rows become pairs of ids only in what reads the result.

Each side has tiles: those of its index, or of a table made for the join. Small
tiles next to each other are taken together, to ``NEAR_RIGHT`` rows or ``NEAR_POINTS``
points, and larger ones are cut into blocks by row number, so repeated ids neither
count as one nor share a block; the left side's blocks are smaller. A block is one
row that holds its rows as an Arrow table. Blocks meet in a product of both sides'
partitions: each task reads the blocks of one partition of either side, so no row is
sent more than once, however many blocks it meets, and the disk grows with the rows.
Pairs of tiles that no pair of rows can join between are left out by their boxes, on
the driver, of at most ``MOST_TILES`` tiles a side, and rows by their ends and lengths
where they meet; a sieve drops most of the other pairs in some ten nanoseconds each.

A threshold join of a side with itself meets each pair of rows once and turns it over
where both orders are wanted. A nearest join first measures each left row against a
sample of right rows, which gives a distance that its k-th nearest can't exceed: its
bar. Where a left block meets several right ones in a task, the bars come down with
each of them.

Null and empty trajectories join with nothing. The pairs of a threshold join may be
far more than the rows, so they are written nowhere: the tables of both sides stay
in the shared folder, and each reading of the result meets them anew. The nearest
rows are written there, and what that join has written for itself is deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from wayfold.functions.distance import DELTA, EPS, _points, check_name
from wayfold.functions.shared import discard, materialize
from wayfold.functions.sieve import kth_distances, near_chunks
from wayfold.operators.index import PIVOTS, ROW, TILE, TrieIndex, build, lookup, merged

#: Ids of copies that a row holds, about; right rows of a block at least, where a side has more than RIGHTS times as many.
COPIES, BLOCK, RIGHTS = 64, 1024, 4
#: Rows, points and ids of a block at most, about; left blocks, where they have LEAST_POINTS points.
NEAR_LEFT, NEAR_RIGHT, NEAR_POINTS, NEAR_IDS = 4096, 16_384, 1 << 20, 1 << 18
SPREAD, LEAST_POINTS = 32, 1 << 13
#: Partitions of the left and of the right blocks.
PARTS = 64, 16
#: Most and least right rows that all left rows are measured against first, about, and their share of all.
SEEDS, SEED_ROWS, SEED_SHARE = 16_384, 1024, 16
#: Pairs of ids that are made at once.
EXPANDED = 1 << 19


def _gap(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """Distance of boxes from boxes, each of a from each of b."""
    apart = np.maximum(np.maximum(low_a[:, None, :] - high_b[None], low_b[None] - high_a[:, None, :]), 0.0)
    return np.sqrt((apart * apart).sum(2))


def _boxes(side: TrieIndex, name: str) -> tuple[np.ndarray, np.ndarray]:
    return side.array(f"{name}_low"), side.array(f"{name}_high")


def tile_distances(a: TrieIndex, b: TrieIndex, name: str, eps: float) -> np.ndarray:
    """A bound for each pair of tiles that no pair of their rows has a smaller distance than."""
    whole = lambda x: (x.array("low"), x.array("high"))
    out = np.zeros((len(a.tiles), len(b.tiles)))
    if name in ("EDR", "LCSS"):
        longer = lambda x, y: x.array("least")[:, None] - y.array("most")[None]
        out = np.maximum(np.maximum(longer(a, b), longer(b, a).T), 0.0)
        apart = lambda x, y, n: (_gap(*_boxes(x, n), *whole(y)) > eps * (1 + 1e-9)).astype(float)
        return np.maximum(out, np.maximum(apart(a, b, "first"), apart(b, a, "first").T))
    first, last = (_gap(*_boxes(a, end), *_boxes(b, end)) for end in ("first", "last"))
    single = (a.array("least") == 1)[:, None] & (b.array("least") == 1)[None]
    out = np.maximum(first, last) if name == "FRECHET" else np.where(single, np.maximum(first, last), first + last)
    sides = []
    for x, y in ((a, b), (b, a)):
        inner = np.zeros((len(x.tiles), len(y.tiles)))
        for j in range(PIVOTS):  # a pivot of one side is matched with some point of the other
            has = (x.array("pivots") > j)[:, None]
            own = np.where(has, _gap(*_boxes(x, f"pivot{j}"), *whole(y)), 0.0)
            inner = np.maximum(inner, own) if name == "FRECHET" else inner + own
        sides.append(inner if x is a else inner.T)
    inner = np.maximum(*sides)
    return np.maximum(out, inner) if name == "FRECHET" else out + inner


def row_distances(rows: dict[str, np.ndarray], b: TrieIndex, tiles: np.ndarray, name: str, eps: float) -> np.ndarray:
    """The same for some rows (their first and last points and lengths) and some tiles of the other side."""
    at = lambda n: tuple(x[tiles] for x in _boxes(b, n))
    first, last, n = rows["first"], rows["last"], rows["points"][:, None]
    least, most = b.array("least")[tiles][None], b.array("most")[tiles][None]
    if name in ("EDR", "LCSS"):
        low, high = b.array("low")[tiles], b.array("high")[tiles]
        apart = (_gap(first, first, low, high) > eps * (1 + 1e-9)).astype(float)
        return np.maximum(np.maximum(np.maximum(least - n, n - most), 0.0), apart)
    x, y = _gap(first, first, *at("first")), _gap(last, last, *at("last"))
    if name == "FRECHET":
        return np.maximum(x, y)
    return np.where((n == 1) & (least == 1), np.maximum(x, y), x + y)


def _plain(b: TrieIndex) -> TrieIndex:
    """The tiles alone, as a task gets them."""
    for name in ("least", "most", "n", "low", "high", "first_low", "first_high", "last_low", "last_high"):
        b.array(name)
    return TrieIndex("", ("", ""), "", None, [None] * len(b.tiles), b.dims, _arrays=dict(b._arrays))  # type: ignore[arg-type]


def _near_tiles(a: TrieIndex, b: TrieIndex, name: str, bar: float, eps: float) -> np.ndarray:
    """Pairs of tiles whose rows may lie within a bar; what is no number tells nothing."""
    return ~(tile_distances(a, b, name, eps) > bar * (1 + 1e-9) + 1e-9)


def _near_rows(x: pa.Array, b: TrieIndex, tile: int, bars: np.ndarray, name: str, eps: float) -> np.ndarray:
    """Places of the left rows that may have a row of a tile within their bars."""
    points, start, size = _points(x)
    rows = {"first": points[start], "last": points[start + size - 1], "points": size}
    return np.flatnonzero(~(row_distances(rows, b, np.array([tile]), name, eps)[:, 0] > bars * (1 + 1e-9) + 1e-9))


def _bundled(side: TrieIndex) -> TrieIndex:
    """Neighbouring tiles as one, of ``NEAR_RIGHT`` rows and ``NEAR_POINTS`` points at most where a tile alone has no more; numbered from 0."""
    number, rows, points, of_tile = -1, 0, 0, {}
    most = min(NEAR_RIGHT, max(BLOCK, -(-sum(t["n"] for t in side.tiles) // RIGHTS)))
    for t in side.tiles:  # numbers next to each other are tiles next to each other
        if number < 0 or rows + t["n"] > most or points + t["points"] > NEAR_POINTS:
            number, rows, points = number + 1, 0, 0
        rows, points = rows + t["n"], points + t["points"]
        of_tile[t[TILE]] = number
    bundle = _of_tile([of_tile.get(t) for t in range(max(of_tile) + 1)])
    return TrieIndex("", ("", ""), side.column, side.data.withColumn(TILE, bundle), merged([], [t | {TILE: of_tile[t[TILE]]} for t in side.tiles]), side.dims)


def _of_tile(values: list) -> Column:
    return F.expr(f"CAST(get(array({', '.join('NULL' if v is None else str(v) for v in values)}), {TILE}) AS INT)")


def _packed(rows: DataFrame, blocks: list[int]) -> tuple[DataFrame, int]:
    """A row for each block, and how many there are: its tile, its number in the tile, and its rows as one Arrow table; ``blocks`` has the number of each tile's."""

    def pack(t: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t)
        return pa.table({"tile": t[TILE][:1], "block": t["block"][:1], "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    placed = rows.withColumn("block", F.pmod(F.xxhash64("row"), _of_tile(blocks)).cast("int"))
    return placed.groupBy(TILE, "block").applyInArrow(pack, "tile int, block int, rows binary"), sum(blocks)


def _lefts(tiles: list[dict], rows: DataFrame) -> tuple[DataFrame, int]:
    total = sum(t["points"] for t in tiles)
    points = min(max(-(-total // SPREAD), LEAST_POINTS), NEAR_POINTS)
    return _packed(rows, [int(max(-(-t["n"] // NEAR_LEFT), -(-t["points"] // points), -(-t["ids"] // NEAR_IDS))) for t in tiles])


def _rights(tiles: list[dict], rows: DataFrame) -> tuple[DataFrame, int]:
    return _packed(rows, [int(max(-(-t["n"] // NEAR_RIGHT), -(-t["points"] // NEAR_POINTS), -(-t["ids"] // NEAR_IDS))) for t in tiles])


Meeting = tuple[int, int, pa.Table, int, pa.Table]


def _met(
    left: tuple[DataFrame, int], right: tuple[DataFrame, int], near: list[list[int]] | None, matched: Callable[[Iterator[Meeting]], Iterator[pa.Table]], schema: StructType
) -> DataFrame:
    """What ``matched`` makes of the blocks that meet: tile, number and rows of a left one, tile and rows of a right one. ``near`` has the right tiles of each left tile."""
    (a, n), (b, m) = left, right
    condition = F.lit(True)
    if near is not None:

        @F.arrow_udf("array<int>")
        def chosen(tile: pa.Array) -> pa.Array:
            return pa.array([near[t] for t in tile.to_pylist()], pa.list_(pa.int32()))

        a, condition = a.withColumn("near", chosen("tile")), F.expr("array_contains(near, right_tile)")
    a = a.withColumnsRenamed({"tile": "left_tile", "block": "left_block", "rows": "left_rows"}).repartition(min(n, PARTS[0]))
    b = b.select(F.col("tile").alias("right_tile"), F.col("rows").alias("right_rows")).repartition(min(m, PARTS[1]))
    pairs = a.join(b.hint("shuffle_replicate_nl"), condition)
    opened = lambda x: pa.ipc.open_stream(x.as_buffer()).read_all().combine_chunks()
    arrow = to_arrow_schema(schema)

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[Meeting]:
        for batch in batches:
            tile, block, x, other, y = batch.columns
            for k in range(len(tile)):
                yield tile[k].as_py(), block[k].as_py(), opened(x[k]), other[k].as_py(), opened(y[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in matched(meetings(batches)):
            yield from found.cast(arrow).to_batches()

    return pairs.select("left_tile", "left_block", "left_rows", "right_tile", "right_rows").mapInArrow(run, schema)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """Half up in decimals, as Spark's round does it; numbers near a half are looked at by their digits."""
    scaled = d * 10.0**digits
    out = np.rint(scaled) / 10.0**digits
    out = np.where(np.abs(scaled) < 2.0**50, out, d)
    for k in np.flatnonzero((np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-3) | (np.abs(scaled) >= 2.0**50)).tolist():
        out[k] = float(Decimal(repr(float(d[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if np.isfinite(d[k]) else d[k]
    return out


def _expanded(x: pa.Array, y: pa.Array, i: np.ndarray, j: np.ndarray, d: np.ndarray, once: np.ndarray | None) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """The pairs of ids of some pairs of rows, which hold lists of them; of the pairs under ``once``, those of two copies once."""
    own, other = x.flatten().field(0), y.flatten().field(0)
    n, m = (np.asarray(c.value_lengths()).astype(np.int64) for c in (x, y))
    at, to = np.cumsum(n) - n, np.cumsum(m) - m
    ends, start = np.cumsum(n[i] * m[j]), 0
    while start < len(i):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + EXPANDED, "right")))
        a, b = i[start:stop], j[start:stop]
        count = n[a] * m[b]
        pair = np.repeat(np.arange(len(a)), count)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        p, q = place // m[b][pair], place % m[b][pair]
        if once is not None:
            kept = np.flatnonzero(~once[start:stop][pair] | (p < q))
            pair, p, q = pair[kept], p[kept], q[kept]
        yield own.take(pa.array(at[a][pair] + p)), other.take(pa.array(to[b][pair] + q)), d[start:stop][pair]
        start = stop


def _rows(side: TrieIndex) -> DataFrame:
    """Tile, row number, ids and trajectory of a side's rows."""
    return side.data.select(TILE, F.col(ROW).alias("row"), "ids", F.col(side.column).alias("traj"))


def _pair_schema(a_side: TrieIndex, b_side: TrieIndex) -> StructType:
    kinds = [StructField(n, x.data.schema["ids"].dataType.elementType["id"].dataType) for n, x in (("left_id", a_side), ("right_id", b_side))]
    return StructType([*kinds, StructField("distance", DoubleType())])


def _none(spark: SparkSession, a_side: TrieIndex, b_side: TrieIndex) -> DataFrame:
    return spark.createDataFrame([], _pair_schema(a_side, b_side))


def numbered(df: DataFrame, column: str, *names: str) -> tuple[DataFrame, TrieIndex | None]:
    """A frame's rows that have points, with row numbers: those of its index, or written for this join (the named columns, or all)."""
    found = lookup(df, column)
    if found is not None:
        return found.data, found
    kept = df.where(F.size(column) > 0)
    kept = kept.select(*dict.fromkeys((*names, column))) if names else kept
    return materialize(kept.withColumn(ROW, F.monotonically_increasing_id()), "join-rows"), None


def gathered(rows: DataFrame, found: TrieIndex | None, column: str, own: Column, by_length: bool) -> TrieIndex:
    """A side of a join: a row with the ids (``own``) of a trajectory's copies, or of some of them, in the tiles of its index or in tiles of its own."""
    keys = [column, TILE] if found is not None else [column]
    rows = rows.select(*keys, ROW, F.struct(own.alias("id")).alias("own"))  # within a struct a null is kept
    many = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > COPIES)
    some = F.coalesce(F.pmod(F.xxhash64(ROW), F.ceil(F.col("n") / COPIES)), F.lit(0).cast("long"))
    copies = rows.join(many, keys, "left").groupBy(*keys, some.alias("some")).agg(F.collect_list("own").alias("ids")).drop("some")
    if found is None:
        copies = materialize(copies, "join-copies")
        data, tiles, dims = build(copies, column, by_length)
        discard(copies)
    else:
        data, tiles, dims = materialize(copies.withColumn(ROW, F.monotonically_increasing_id()), "join-copies"), found.tiles, found.dims
    held = data.groupBy(TILE).agg(F.count("*").alias("n"), F.sum(F.size(column).cast("long")).alias("points"), F.sum(F.size("ids").cast("long")).alias("ids"))
    counts = {t[TILE]: t.asDict() for t in held.collect()}  # a row for each tile
    return TrieIndex("", ("", ""), column, data, [t | counts[t[TILE]] for t in tiles if t[TILE] in counts], dims)


def sides(left: DataFrame, right: DataFrame, c1: str, c2: str, name: str, id1: str, id2: str) -> tuple[TrieIndex, TrieIndex]:
    """Both sides with their tiles, written for this join. A frame joined with itself is gathered once."""

    def side(df: DataFrame, column: str, id_col: str) -> TrieIndex:
        rows, found = numbered(df, column, id_col)
        own = gathered(rows, found, column, F.col(id_col), name in ("EDR", "LCSS"))
        if found is None:
            discard(rows)
        return own

    a = side(left, c1, id1)
    same = (c1, id1) == (c2, id2) and (left is right or left.sameSemantics(right))
    return a, a if same else side(right, c2, id2)


def _alike(a: TrieIndex, b: TrieIndex) -> None:
    if a.tiles and b.tiles and a.dims != b.dims:
        raise ValueError("the points of both sides have to have the same number of coordinates")


def threshold_pairs(a_side: TrieIndex, b_side: TrieIndex, name: str, bar: float, eps: float = EPS, delta: int = DELTA, once: bool = False, digits: int | None = None) -> DataFrame:
    """(left_id, right_id, distance) of all pairs within ``bar``; distances are rounded once for all copies."""
    if once and a_side is not b_side:
        raise ValueError("pairs come once in the join of a frame with itself")
    _alike(a_side, b_side)
    if not a_side.tiles or not b_side.tiles:
        return _none(a_side.data.sparkSession, a_side, b_side)
    half = a_side is b_side
    a_side = _bundled(a_side)
    b_side = a_side if half else _bundled(b_side)
    near = _near_tiles(a_side, b_side, name, bar, eps)
    near = np.triu(near) if half else near
    a, b, schema, tiles = _rows(a_side), _rows(b_side), _pair_schema(a_side, b_side), _plain(b_side)
    digits = None if name in ("EDR", "LCSS") else digits  # those are whole numbers

    def matched(meetings: Iterator[Meeting]) -> Iterator[pa.Table]:
        for p, _, x, q, y in meetings:
            l, r, bars = _one(x["traj"]), _one(y["traj"]), np.full(len(x), bar)
            at = _near_rows(l, tiles, q, bars, name, eps)
            if not len(at):
                continue
            numbers = (np.asarray(x["row"])[at], np.asarray(y["row"])) if half and p == q else None
            own, other = _one(x["ids"]), _one(y["ids"])
            for i, j, d in near_chunks(name, l.take(pa.array(at)), r, bars[at], eps, delta, numbers):
                same = numbers[0][i] == numbers[1][j] if numbers else np.zeros(len(i), bool)
                i, d = at[i], d if digits is None else _rounded(d, digits)
                for left, right, far in _expanded(own, other, i, j, d, same if once else None):
                    yield pa.table([left, right, pa.array(far)], schema.names)
                if half and not once:  # distances are the same in either order
                    turned = np.flatnonzero(~same)
                    for left, right, far in _expanded(own, other, i[turned], j[turned], d[turned], None):
                        yield pa.table([right, left, pa.array(far)], schema.names)

    return _met(_lefts(a_side.tiles, a), _rights(b_side.tiles, b), [np.flatnonzero(x).tolist() for x in near], matched, schema)


def threshold_join(
    left: DataFrame, right: DataFrame, c1: str, c2: str, name: str, bar: float, id1: str = "id", id2: str = "id", eps: float = EPS, delta: int = DELTA, once: bool = False,
    digits: int | None = None,
) -> DataFrame:
    """(left_id, right_id, distance) of all pairs within ``bar``. With ``once``, for a frame joined with itself, two different
    rows are a pair once, either of them on the left, and no row is a pair with itself."""
    name = check_name(name)
    return threshold_pairs(*sides(left, right, c1, c2, name, id1, id2), name, bar, eps, delta, once, digits)


def _with_bars(left: tuple[DataFrame, int], b: DataFrame, n: int, name: str, k: int, eps: float, delta: int) -> tuple[DataFrame, int]:
    """The left blocks, each row with its k-th least distance from some of the ``n`` right rows."""
    wanted = max(min(max(n // SEED_SHARE, SEED_ROWS), SEEDS), 8 * k)
    seeds = b.where(F.pmod(F.xxhash64("row"), F.lit(max(1, n // wanted))) == 0).select(F.lit(0).alias(TILE), "row", "traj")

    def measured(meetings: Iterator[Meeting]) -> Iterator[pa.Table]:
        for tile, block, x, _, y in meetings:
            bars = kth_distances(name, _one(x["traj"]), _one(y["traj"]), k, eps, delta)
            sink = pa.BufferOutputStream()
            x = x.set_column(x.schema.get_field_index("bar"), "bar", pa.array(bars, pa.float64()))
            with pa.ipc.new_stream(sink, x.schema) as out:
                out.write_table(x)
            yield pa.table([pa.array([tile], pa.int32()), pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["tile", "block", "rows"])

    schema = StructType.fromDDL("tile int, block int, rows binary")
    return _met(left, _packed(seeds, [1]), None, measured, schema), left[1]


def knn_pairs(a_side: TrieIndex, b_side: TrieIndex, name: str, k: int, eps: float = EPS, delta: int = DELTA) -> DataFrame:
    """(left_id, right_id, distance): for each left row the k nearest right rows by (distance, id)."""
    _alike(a_side, b_side)
    if k <= 0 or not a_side.tiles or not b_side.tiles:
        return _none(a_side.data.sparkSession, a_side, b_side)
    half = a_side is b_side
    a_side = _bundled(a_side)
    b_side = a_side if half else _bundled(b_side)
    a, b, tiles = _rows(a_side).withColumn("bar", F.lit(float("inf"))), _rows(b_side), _plain(b_side)
    # Of a right row's copies the first k, nulls last; its place among rows of the same distance is that of the first.
    ordered = F.slice(F.array_sort("ids", lambda x, y: F.when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).when(x["id"].isNull() & y["id"].isNotNull(), 1).when(x["id"].isNotNull() & y["id"].isNull(), -1).otherwise(0)), 1, k)
    b = b.withColumn("ids", ordered).withColumn("least", F.col("ids")[0]["id"])
    own = lambda n, df, of: StructField(n, df.schema[of].dataType)
    schema = StructType([own("left_row", a, "row"), own("left_ids", a, "ids"), own("right_row", b, "row"), own("right_ids", b, "ids"), own("least", b, "least"), StructField("distance", DoubleType())])
    order = [("i", "ascending"), ("distance", "ascending"), ("least", "ascending"), ("right_row", "ascending")]

    def nearest(found: pa.Table) -> pa.Table:
        """The k nearest of each left row, each of which has one id at least."""
        found = found.sort_by(order)
        rows = np.asarray(_one(found["i"]))
        return found.filter(pa.array(np.arange(len(rows)) - np.searchsorted(rows, rows) < k))

    def matched(meetings: Iterator[Meeting]) -> Iterator[pa.Table]:
        at: tuple[int, int] | None = None
        x = held = None
        bars = np.zeros(0)

        def result() -> pa.Table:
            places = held["i"]
            return pa.table([x["row"].take(places), x["ids"].take(places), held["right_row"], held["right_ids"], held["least"], held["distance"]], schema.names)

        for tile, block, rows, q, y in meetings:
            if at != (tile, block):
                if held is not None:
                    yield result()
                at, x, held, bars = (tile, block), rows, None, np.asarray(rows["bar"], float).copy()
                l = _one(x["traj"])
            some = _near_rows(l, tiles, q, bars, name, eps)
            if not len(some):
                continue
            for i, j, d in near_chunks(name, l.take(pa.array(some)), _one(y["traj"]), bars[some] * (1 + 1e-9), eps, delta):
                places = pa.array(j)
                found = pa.table([pa.array(some[i]), y["row"].take(places), y["ids"].take(places), y["least"].take(places), pa.array(d)], ["i", "right_row", "right_ids", "least", "distance"])
                held = nearest(found if held is None else pa.concat_tables([held, found]))
            if held is not None:
                rows_, d = np.asarray(_one(held["i"])), np.asarray(_one(held["distance"]))
                last = np.flatnonzero(np.arange(len(rows_)) - np.searchsorted(rows_, rows_) == k - 1)
                bars[rows_[last]] = np.minimum(bars[rows_[last]], d[last])
        if held is not None:
            yield result()

    rows = Window.partitionBy("left_row").orderBy("distance", F.col("least").asc_nulls_last(), "right_row")
    best = Window.partitionBy("left_row").orderBy("distance", F.col("right_id").asc_nulls_last())
    lefts = _with_bars(_lefts(a_side.tiles, a), b, sum(t["n"] for t in b_side.tiles), name, k, eps, delta)
    rights = _rights([t | {"ids": min(t["ids"], k * t["n"])} for t in b_side.tiles], b)
    met = _met(lefts, rights, None, matched, schema).withColumn("at", F.row_number().over(rows)).where(F.col("at") <= k)
    met = met.select("left_row", "left_ids", F.explode("right_ids").alias("y"), "distance").withColumn("right_id", F.col("y.id"))
    met = met.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k)
    out = met.select(F.explode("left_ids").alias("x"), "right_id", "distance").select(F.col("x.id").alias("left_id"), "right_id", "distance")
    return materialize(out, "nearest-join")


def knn_join(
    left: DataFrame, right: DataFrame, c1: str, c2: str, name: str, k: int, id1: str = "id", id2: str = "id", eps: float = EPS, delta: int = DELTA
) -> DataFrame:
    """(left_id, right_id, distance): for each left row the k nearest right rows by (distance, id)."""
    name = check_name(name)
    a, b = sides(left, right, c1, c2, name, id1, id2)
    out = knn_pairs(a, b, name, k, eps, delta)
    discard(*{id(x): x.data for x in (a, b)}.values())
    return out
