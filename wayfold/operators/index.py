"""Named indexes on trajectory columns.

An index is a table in the shared folder with a folder for each tile. A row's key
is its first point, its last point, and its first pivot (the interior points that
lie farthest from their predecessors are its pivots, ``PIVOTS`` at most); the
tiles are the leaves of a tree that cuts keys level under level
(``wayfold.operators.tiling``), fitted on a sample of about ``SAMPLE`` keys. Beside
the frame's columns, the table has a row number and summary columns: coordinates
of first and last point, box, number of points, pivots.

The global part is a row for each tile, at most ``MOST_TILES``: boxes of first
points, last points, each pivot, and of all points; least and most points; counts.
A search descends the levels first, last, pivots with what each leaves of the
threshold, and reads the folders of the tiles that stay.

An index belongs to a frame's plan and to the files that it read. A frame whose
files have changed since (files added, removed, or of other size or time) doesn't
find the index: it is searched without. ``create_index`` and ``refresh_index`` then
bring it up to date: where files were only added and each row of the frame comes
from one row of one file (filters and projections over a single table of files),
only the added files are read, their rows go to the tiles of the tree as it is, and
the tiles' rows take them in; else, and once the rows are more than ``GROWTH`` times
those that the tree was fitted to, it is built anew.
Row numbers tell rows apart; ids play no part.

An index made with a path outlives the application: ``open_index`` finds it there.
Its rows lie in a folder for each extension, and a manifest that is written after
them tells which of these count, so that what a lost driver leaves behind is never read.
"""

from __future__ import annotations

import hashlib
import json
import logging
import math
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from wayfold.functions.distance import point_distance
from wayfold.functions.shared import shared_dir
from wayfold.functions.shipping import ship
from wayfold.operators.tiling import Tiling, tiling

PREFIX, TILE, ROW, PART = "__", "__tile", "__row", "__part"
PIVOTS = 3
#: Rows that tiles are fitted on; tiles of an index, and of one that a join makes for itself; bytes and rows that a tile is made for.
SAMPLE = 65_536
LEAST_TILES, MOST_TILES = 32, 4096
TILE_BYTES, TILE_ROWS = 64 << 20, 256
#: Rows of an index, as a multiple of those that its tree was fitted to, and added files, beyond which it is built anew.
GROWTH, MOST_ADDED = 2, 10_000
#: Indexes of this process by frame and column; the rows are in the shared folder.
_indexes: dict[tuple[str, str], TrieIndex] = {}


@dataclass
class TrieIndex:
    name: str
    key: tuple[str, str]
    column: str
    data: DataFrame
    tiles: list
    dims: int
    source: DataFrame | None = None
    files: frozenset[str] = frozenset()
    where: str = ""
    first: int = 0  # the parts first .. parts - 1 of the folder hold the rows
    parts: int = 0
    fitted: Tiling | None = None
    fitted_rows: int = 0
    _arrays: dict[str, np.ndarray] = field(default_factory=dict)

    def rows(self, keep) -> DataFrame:
        """The rows of the tiles that ``keep`` (of a tile's row) leaves."""
        return self.of_tiles([t[TILE] for t in self.tiles if keep(t)])

    def of_tiles(self, tiles: list[int]) -> DataFrame:
        return self.data.where(F.col(TILE).isin(tiles) if len(tiles) < len(self.tiles) else F.lit(True))

    def array(self, name: str) -> np.ndarray:
        """A column of the tiles' rows."""
        if name not in self._arrays:
            self._arrays[name] = np.array([t[name] for t in self.tiles], float)
        return self._arrays[name]


def _key(source: DataFrame, column: str) -> tuple[str, str]:
    return f"{source.sparkSession.sparkContext.applicationId}:{source.semanticHash()}", column


def _listed(df: DataFrame) -> dict[str, str]:
    """The files that a frame reads, by a digest of path, size and time."""
    jvm, seen = df.sparkSession.sparkContext._jvm, {}
    every = getattr(getattr(jvm.scala.collection.immutable, "Nil$"), "MODULE$")
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for k in range(leaves.size()):
        try:
            location = leaves.apply(k).relation().location()
        except Exception:  # no relation of files: rows in memory, a range, another source
            continue
        try:
            if "CatalogFileIndex" in location.getClass().getName():
                location = location.filterPartitions(every)
            text = location.allFiles().mkString("\n")
        except Exception:  # a location that lists no files: told by its paths and bytes
            text = "\n".join([*df.inputFiles(), str(location.sizeInBytes())])
        for line in text.split("\n"):
            found = re.search(r"path=(.*?); isDirectory=.*?; length=(\d+);.*?modification_time=(\d+)", line)
            seen[hashlib.sha256("|".join(found.groups() if found else (line,)).encode()).hexdigest()] = found[1] if found else ""
    return seen


def files_of(df: DataFrame) -> frozenset[str]:
    """A digest of each file that a frame reads, with its size and time."""
    return frozenset(_listed(df))


def _nodes(plan):
    yield plan
    below = plan.children()
    for k in range(below.size()):
        yield from _nodes(below.apply(k))


def _added(df: DataFrame, files: frozenset[str], listed: dict[str, str]) -> DataFrame | None:
    """A frame's rows of the listed files beside ``files``; None if these aren't all listed any more or rows don't come from one file each."""
    plan = df._jdf.queryExecution().analyzed()
    by_row = all(n.nodeName() in ("Project", "Filter", "SubqueryAlias", "LogicalRelation") for n in _nodes(plan))
    new = [path for digest, path in listed.items() if digest not in files]
    if not by_row or not plan.deterministic() or not plan.subqueriesAll().isEmpty() or not files <= listed.keys() or len(new) > MOST_ADDED or not all(new):
        return None
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    # A path as Spark's metadata column writes it; the filter on it prunes the listing.
    return df.where(df.metadataColumn("_metadata")["file_path"].isin([path(p).toUri().toString() for p in new]))


def _frame(source: DataFrame | str, spark: SparkSession | None) -> DataFrame:
    return source if isinstance(source, DataFrame) else (spark or SparkSession.active()).table(source)


def pivots(column: str, dims: int):
    """The interior points that lie farthest from the point before them."""
    step = point_distance(f"{column}[i]", f"{column}[i - 1]", dims)
    far = f"sort_array(transform(sequence(1, size({column}) - 2), i -> struct({step} AS d, i AS i, {column}[i] AS p)), false)"
    none = "CAST(array() AS ARRAY<ARRAY<DOUBLE>>)"
    return F.expr(f"CASE WHEN size({column}) > 2 THEN transform(slice({far}, 1, {PIVOTS}), x -> x.p) ELSE {none} END")


def summary(column: str, dims: int) -> dict:
    """First and last point, box, number of points and pivots of a trajectory, as columns."""
    axis = lambda k: F.transform(column, lambda p: p[k])
    out = {}
    for k in range(dims):
        out[f"{PREFIX}first{k}"] = F.get(column, F.lit(0))[k]
        out[f"{PREFIX}last{k}"] = F.try_element_at(column, F.lit(-1))[k]
        out[f"{PREFIX}low{k}"], out[f"{PREFIX}high{k}"] = F.array_min(axis(k)), F.array_max(axis(k))
    return out | {f"{PREFIX}points": F.size(column), f"{PREFIX}pivots": pivots(column, dims)}


def axes(dims: int, by_length: bool) -> tuple[list, list[int]]:
    """The key of a row as columns, and how many of them each level of tiles has."""
    ends = [[F.col(f"{PREFIX}{end}{k}") for k in range(dims)] for end in ("first", "last")]
    if by_length:
        return [F.col(f"{PREFIX}points").cast("double"), *ends[0]], [1, dims]
    pivot = [F.get(F.get(f"{PREFIX}pivots", F.lit(0)), F.lit(k)) for k in range(dims)]
    return [*ends[0], *ends[1], *pivot], [dims, dims, dims]


def dimensions(df: DataFrame, column: str) -> int:
    """Coordinates of a point, of the first trajectory that has any."""
    first = df.where(f"size({column}) > 0").select(F.size(F.col(column)[0])).head()
    return first[0] if first else 2


def fit(df: DataFrame, columns: list, tiles: int, levels: list[int], rows: int) -> Tiling:
    """Tiles for the keys of a frame of so many rows. The sample goes to the driver: about SAMPLE keys, whatever the frame's size."""
    if tiles <= 1:
        return tiling(np.zeros((0, len(columns))), 1, levels)
    sampled = df if rows <= SAMPLE else df.sample(SAMPLE / rows, 11)
    found = sampled.select(*(c.alias(f"k{k}") for k, c in enumerate(columns))).toArrow()
    return tiling(np.stack([np.asarray(c.cast(pa.float64()).fill_null(np.nan)) for c in found.columns], 1), tiles, levels)


def tile_points(df: DataFrame, columns: list, tiles: int, name: str = "tile") -> DataFrame:
    """A column with the number of each row's tile, of tiles over the coordinates in ``columns`` (recursive, half open, of about equal counts)."""
    ship(df.sparkSession)
    return df.withColumn(name, tile_of(fit(df, columns, tiles, [len(columns)], df.count()), columns))


def tile_of(fitted: Tiling, columns: list):
    @F.arrow_udf("int")
    def place(*parts: pa.Array) -> pa.Array:
        points = np.stack([np.asarray(p.cast(pa.float64()).fill_null(np.nan)) for p in parts], 1)
        return pa.array(fitted.place(points), pa.int32())

    return place(*columns)


def _summed(df: DataFrame, column: str, dims: int) -> DataFrame:
    return df.where(f"size({column}) > 0").withColumns(summary(column, dims))


def _fitted(df: DataFrame, column: str, tiles: int | None, folders: bool, by_length: bool) -> tuple[DataFrame, Tiling, list, int, int]:
    """The rows with summary columns and row numbers, their tiling, its keys, the dimensions, the number of rows."""
    ship(df.sparkSession)
    usable = df.where(f"size({column}) > 0")
    dims = dimensions(df, column)
    kept = _summed(df, column, dims)
    keys, levels = axes(dims, by_length)
    size = usable.select(F.count("*").alias("n"), F.sum(F.size(column)).alias("points")).first()
    if tiles is None:
        tiles = max(LEAST_TILES, 16 * dims * (size["points"] or 0) // TILE_BYTES) if folders else size["n"] // TILE_ROWS
    tiles = min(max(tiles, 1), MOST_TILES)
    return kept.withColumn(ROW, F.monotonically_increasing_id()), fit(kept, keys, tiles, levels, size["n"]), keys, dims, size["n"]


def build(df: DataFrame, column: str, by_length: bool = False) -> tuple[DataFrame, list, int]:
    """Tiles for one join: the rows with summary columns, row numbers and tiles, written without folders; a row for each tile; the dimensions."""
    spark = df.sparkSession
    kept, fitted, keys, dims, _ = _fitted(df, column, None, False, by_length)
    placed = kept.withColumn(TILE, tile_of(fitted, keys))
    path = _own(spark)
    placed.write.option("compression", "zstd").parquet(path)
    data = spark.read.schema(placed.schema).parquet(path)
    return data, _tile_rows(data, dims), dims


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/wayfold/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"


def _write(placed: DataFrame, where: str, part: int) -> None:
    """Rows with tiles as one part of an index, a folder for each tile; what an attempt left there goes."""
    # A rebalance splits a tile of many rows among tasks; a repartition would give it to one.
    dealt = placed.hint("rebalance", TILE).write.option("compression", "zstd").option("partitionOverwriteMode", "static").mode("overwrite")
    dealt.partitionBy(TILE).parquet(f"{where}/rows/{PART}={part}")


def _read(spark: SparkSession, schema: StructType, where: str, parts: range) -> DataFrame:
    rows = spark.read.option("basePath", f"{where}/rows").schema(schema)
    return rows.parquet(*(f"{where}/rows/{PART}={k}" for k in parts))


def _schema(placed: DataFrame) -> StructType:
    return StructType([*(f for f in placed.schema.fields if f.name != TILE)]).add(PART, IntegerType()).add(TILE, IntegerType())


def _tile_rows(data: DataFrame, dims: int) -> list:
    """A row for each tile: what every row of it lies within."""
    of = lambda f, name: F.array(*(f(F.col(f"{PREFIX}{name}{k}")) for k in range(dims)))
    ends = {f"{end}_{side}": of(f, end) for end in ("first", "last") for side, f in (("low", F.min), ("high", F.max))}
    ends |= {"low": of(F.min, "low"), "high": of(F.max, "high")}
    for j in range(PIVOTS):
        pivot = [F.get(F.get(f"{PREFIX}pivots", F.lit(j)), F.lit(k)) for k in range(dims)]
        ends |= {f"pivot{j}_{side}": F.array(*(F.coalesce(f(p), F.lit(0.0)) for p in pivot)) for side, f in (("low", F.min), ("high", F.max))}
    points = F.col(f"{PREFIX}points")
    counts = {"n": F.count("*"), "least": F.min(points), "most": F.max(points), "points": F.sum(points.cast("long")), "pivots": F.min(F.size(f"{PREFIX}pivots")), "top": F.max(ROW)}
    found = data.groupBy(TILE).agg(*(c.alias(n) for n, c in (counts | ends).items())).orderBy(TILE).collect()  # a row for each tile
    return [t.asDict() for t in found]


def _bound(a: float | None, b: float | None, of) -> float | None:
    """The lower or upper of two coordinates as an aggregate takes it: nulls aside, NaN above all others."""
    return of((x for x in (a, b) if x is not None), key=lambda x: (math.isnan(x), x), default=None)


def merged(old: list[dict], new: list[dict]) -> list[dict]:
    """Tiles' rows of two parts as one list: what the rows of both lie within."""
    found = {t[TILE]: t for t in old}
    for t in new:
        own = found.get(t[TILE])
        if own is None:
            found[t[TILE]] = t
            continue
        both = {TILE: t[TILE]}
        for name in (n for n in t if n != TILE):
            a, b = own[name], t[name]
            if name in ("n", "points", "ids"):
                both[name] = a + b
            elif isinstance(a, list):
                both[name] = [_bound(x, y, min if name.endswith("low") else max) for x, y in zip(a, b)]
            else:
                both[name] = (max if name in ("most", "top") else min)(a, b)
        found[t[TILE]] = both
    return [found[k] for k in sorted(found)]


def create_index(source: DataFrame | str, column: str, name: str, tiles: int | None = None, spark: SparkSession | None = None, path: str | None = None) -> None:
    """Build and keep an index now, of about ``tiles`` tiles (by default as its bytes need).

    One on the same frame and column stays as it is, with a warning; if the frame's
    files have changed it is brought up to date, under the new name and in its place.
    With a ``path``, in a folder that driver and executors share, the index outlives
    the application; an index that lies there already is an error.
    """
    df = _frame(source, spark)
    if column not in df.columns:
        raise AnalysisException(f"Column {column} does not exist.")
    key = _key(df, column)
    if lookup(df, column) is not None:
        logging.getLogger(__name__).warning("an index on this column exists: %s", _indexes[key].name)
        return
    if path is not None and _manifests(df.sparkSession, path):
        raise ValueError(f"an index lies in {path}; open_index finds it")
    known = _indexes.get(key)
    if known is not None and known.source.sameSemantics(df) and path is None and tiles is None:
        known.name = name
        refresh_index(df, column)
        return
    if known is not None:
        _forget(key)
    _indexes[key] = _built(df, column, name, tiles, path or _own(df.sparkSession), bool(path), 0)


def _built(df: DataFrame, column: str, name: str, tiles: int | None, where: str, outlives: bool, part: int) -> TrieIndex:
    """An index whose rows are the one part ``part`` of its folder."""
    spark, files = df.sparkSession, files_of(df)
    kept, fitted, keys, dims, n = _fitted(df, column, tiles, True, False)
    placed = kept.withColumn(TILE, tile_of(fitted, keys))
    _write(placed, where, part)
    data = _read(spark, _schema(placed), where, range(part, part + 1))
    found = TrieIndex(name, _key(df, column), column, data, _tile_rows(data, dims), dims, df, files, where, part, part + 1, fitted, n)
    _log_sizes(found)
    if outlives:
        _keep(found)
    return found


def _log_sizes(found: TrieIndex) -> None:
    n = [t["n"] for t in found.tiles] or [0]
    logging.getLogger(__name__).info("index %s: %d tiles, rows of a tile by quarters %s", found.name, len(found.tiles), np.percentile(n, [0, 25, 50, 75, 100]).tolist())


def refresh_index(source: DataFrame | str, column: str, spark: SparkSession | None = None) -> str:
    """Bring a frame's index up to date with its files: "same", "extended" by the rows of added files, or "built" anew."""
    df = _frame(source, spark)
    key = _key(df, column)
    known = _indexes.get(key)
    if known is None or not known.source.sameSemantics(df):
        raise ValueError("no index on this column")
    listed = _listed(df)
    if listed.keys() == known.files:
        return "same"
    outlives = bool(_manifests(df.sparkSession, known.where))
    added = _added(df, known.files, listed)
    if added is None or not known.tiles or not _extend(known, df, added, frozenset(listed), outlives):
        old = range(known.first, known.parts)
        _indexes[key] = _built(df, column, known.name, None, known.where, outlives, known.parts)
        _remove(df.sparkSession, *(f"{known.where}/rows/{PART}={k}" for k in old))
        return "built"
    return "extended"


def _extend(known: TrieIndex, df: DataFrame, added: DataFrame, files: frozenset[str], outlives: bool) -> bool:
    """Take rows of added files into an index; False if the rows are too many for its tree."""
    spark, part = df.sparkSession, known.parts
    ship(spark)
    before = sum(t["n"] for t in known.tiles)
    if before + added.where(f"size({known.column}) > 0").count() > GROWTH * known.fitted_rows:
        return False
    keys, _ = axes(known.dims, False)
    above = max(t["top"] for t in known.tiles) + 1
    numbered = _summed(added, known.column, known.dims).withColumn(ROW, F.monotonically_increasing_id() + F.lit(above))
    placed = numbered.withColumn(TILE, tile_of(known.fitted, keys))
    _write(placed, known.where, part)
    schema = known.data.schema
    own = _tile_rows(_read(spark, schema, known.where, range(part, part + 1)), known.dims)
    known.data, known.tiles = _read(spark, schema, known.where, range(known.first, part + 1)), merged(known.tiles, own)
    known.parts, known.files, known.source = part + 1, files, df
    known._arrays.clear()
    _log_sizes(known)
    if outlives:
        _keep(known)
    return True


def _plan(df: DataFrame) -> str:
    """A frame's plan without what differs between sessions."""
    return df._jdf.queryExecution().optimizedPlan().canonicalized().toString()


def _keep(found: TrieIndex) -> None:
    """Write the manifest of an index that outlives the application: its tree, its tiles' rows, the parts that count, its frame's files."""
    spark = found.data.sparkSession
    about = {"name": found.name, "column": found.column, "dims": found.dims, "first": found.first, "parts": found.parts, "fitted_rows": found.fitted_rows}
    about |= {"plan": _plan(found.source), "schema": found.data.schema.json(), "fans": found.fitted.fans, "cuts": [c.tolist() for c in found.fitted.cuts], "tiles": found.tiles}
    where = f"{found.where}/manifest-{found.parts:08d}"
    lines = [json.dumps(about), *sorted(found.files)]
    spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "k long, line string").coalesce(1).write.mode("overwrite").parquet(where)
    _remove(spark, *(f"{found.where}/{m}" for m in _manifests(spark, found.where) if m < where.rsplit("/", 1)[1]))


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, where: str) -> list[str]:
    """Names of the whole manifests in an index's folder, the latest last."""
    at, system = _folder(spark, where)
    names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
    return sorted(n for n in names if n.startswith("manifest-") and system.exists(_folder(spark, f"{where}/{n}/_SUCCESS")[0]))


def _remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at, system = _folder(spark, path)
        system.delete(at, True)


def open_index(source: DataFrame | str, path: str, spark: SparkSession | None = None) -> str:
    """Find an index that an earlier application left at ``path``; its name.

    The frame has to be the one that the index was made for: a frame of another plan
    or other columns is an error. Files that were added since are told as always, and
    ``refresh_index`` takes them in.
    """
    df = _frame(source, spark)
    own = df.sparkSession
    names = _manifests(own, path)
    if not names:
        raise ValueError(f"no index in {path}")
    lines = [r["line"] for r in own.read.parquet(f"{path}/{names[-1]}").orderBy("k").collect()]
    about = json.loads(lines[0])
    schema = StructType.fromJson(json.loads(about["schema"]))
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    if about["plan"] != _plan(df) or any(kinds.get(f.name) != f.dataType.simpleString() for f in df.schema.fields):
        raise ValueError(f"the index in {path} belongs to another frame")
    data = _read(own, schema, path, range(about["first"], about["parts"]))
    fitted = Tiling(about["fans"], [np.array(c, float).reshape(len(c), fan - 1) for c, fan in zip(about["cuts"], about["fans"])])
    key = _key(df, about["column"])
    if key in _indexes and _indexes[key].where != path:
        _forget(key)
    found = (about["name"], key, about["column"], data, about["tiles"], about["dims"], df, frozenset(lines[1:]), path, about["first"], about["parts"], fitted, about["fitted_rows"])
    _indexes[key] = TrieIndex(*found)
    return about["name"]


def close_index(source: DataFrame | str, column: str, spark: SparkSession | None = None) -> None:
    """Forget an index that was made with a path, and leave its files to ``open_index``."""
    df = _frame(source, spark)
    found = _indexes.get(_key(df, column))
    if found is not None:
        if not _manifests(df.sparkSession, found.where):
            raise ValueError("this index was made without a path")
        del _indexes[found.key]


def lookup(df: DataFrame, column: str) -> TrieIndex | None:
    """The index of a frame's column, if its files are those that the index was built from."""
    found = _indexes.get(_key(df, column)) if _indexes else None
    if found is None or not found.source.sameSemantics(df):
        return None
    if files_of(df) != found.files:
        logging.getLogger(__name__).warning("index %s is left out: the files of its frame have changed", found.name)
        return None
    return found


def _forget(key: tuple[str, str]) -> None:
    """Forget an index and delete its files."""
    found = _indexes.pop(key)
    spark = found.data.sparkSession
    _remove(spark, *(f"{found.where}/{m}" for m in _manifests(spark, found.where)), f"{found.where}/rows")


def drop_index(source: DataFrame | str, column: str | None = None, name: str | None = None, spark: SparkSession | None = None) -> None:
    """Drop by name, or by frame and column; an unknown column is an error, an unknown index isn't."""
    df = _frame(source, spark)
    if column is not None:
        if column not in df.columns:
            raise AnalysisException(f"Column {column} does not exist.")
        keys = [_key(df, column)]
    else:
        keys = [k for k, i in _indexes.items() if i.name == name]
    for key in keys:
        if key in _indexes:
            _forget(key)


def show_indexes(spark: SparkSession) -> DataFrame:
    """One row for each index of this application."""
    own = f"{spark.sparkContext.applicationId}:"
    return spark.createDataFrame([(i.name,) for k, i in sorted(_indexes.items()) if k[0].startswith(own)], "index string")


def tile_statistics(df: DataFrame, column: str) -> DataFrame:
    """Rows in each tile of an index."""
    found = lookup(df, column)
    if found is None:
        raise ValueError("no index on this column")
    return df.sparkSession.createDataFrame([(t[TILE], t["n"]) for t in found.tiles], "tile int, n long")
