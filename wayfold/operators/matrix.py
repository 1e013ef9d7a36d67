"""Matrices as tables: of entries (i, j, value), and of dense blocks.

``blocks`` gathers entries into squares of ``SIDE`` rows and columns, a row
(bi, bj, data) each; a block without entries has no row. A product joins the
blocks of two matrices by the inner number, multiplies pairs of blocks in the
tasks, and adds the products of each place there, one at a time. No matrix
reaches the driver: of the singular values only ``k`` by ``k`` numbers do.
Entries that repeat a place add up; null entries and places are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.shared import discard, materialize
from wayfold.functions.shipping import ship

SIDE = 128
SCHEMA = "bi long, bj long, data binary"


def blocks(entries: DataFrame, side: int = SIDE) -> DataFrame:
    """Entries (i, j, value) as blocks."""
    ship(entries.sparkSession)
    known = entries.where("i IS NOT NULL AND j IS NOT NULL AND value IS NOT NULL")
    summed = known.groupBy("i", "j").agg(F.sum(F.col("value").cast("double")).alias("value"))
    placed = summed.select(F.floor(F.col("i") / side).alias("bi"), F.floor(F.col("j") / side).alias("bj"), F.pmod("i", F.lit(side)).alias("i"), F.pmod("j", F.lit(side)).alias("j"), "value")

    def dense(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((side, side))
        for b in batches:
            own[b.column("i").to_numpy(), b.column("j").to_numpy()] = b.column("value").to_numpy()
        yield _row(key, own)

    return placed.groupBy("bi", "bj").applyInArrow(dense, SCHEMA)


def _row(key: tuple, own: np.ndarray) -> pa.RecordBatch:
    places = [pa.array([k.as_py()], pa.int64()) for k in key]
    return pa.RecordBatch.from_arrays([*places, pa.array([own.tobytes()], pa.binary())], ["bi", "bj", "data"])


def entries(matrix: DataFrame, side: int = SIDE) -> DataFrame:
    """The entries of a matrix of blocks that aren't zero."""

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bi, bj, data in zip(*(c.to_pylist() for c in b.columns)):
                own = np.frombuffer(data).reshape(side, -1)
                i, j = np.nonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(bi * side + i), pa.array(bj * side + j), pa.array(own[i, j])], ["i", "j", "value"])

    return matrix.select("bi", "bj", "data").mapInArrow(sparse, "i long, j long, value double")


def transpose(matrix: DataFrame, side: int = SIDE) -> DataFrame:
    @F.arrow_udf("binary")
    def turned(data: pa.Array) -> pa.Array:
        return pa.array([np.ascontiguousarray(np.frombuffer(d.as_py()).reshape(side, side).T).tobytes() for d in data], pa.binary())

    return matrix.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), turned("data").alias("data"))


def multiply(a: DataFrame, b: DataFrame, side: int = SIDE) -> DataFrame:
    """The product of two matrices of blocks; the right one may have narrower blocks."""

    @F.arrow_udf("binary")
    def product(x: pa.Array, y: pa.Array) -> pa.Array:
        of = lambda d: np.frombuffer(d.as_py()).reshape(side, -1)
        return pa.array([(of(p) @ of(q)).tobytes() for p, q in zip(x, y)], pa.binary())

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            for data in batch.column("data"):
                own = np.frombuffer(data.as_py())
                whole = own.copy() if whole is None else np.add(whole, own, out=whole)
        yield _row(key, whole)

    left, right = a.select("bi", F.col("bj").alias("k"), F.col("data").alias("x")), b.select(F.col("bi").alias("k"), "bj", F.col("data").alias("y"))
    return left.join(right, "k").select("bi", "bj", product("x", "y").alias("data")).groupBy("bi", "bj").applyInArrow(added, SCHEMA)


def gram(matrix: DataFrame, side: int = SIDE) -> DataFrame:
    """The matrix's columns multiplied with each other."""
    return multiply(transpose(matrix, side), matrix, side)


def _inner(x: DataFrame, y: DataFrame, k: int, side: int) -> np.ndarray:
    """The k by k products of the columns of two matrices of k columns."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((k, k))
        for b in batches:
            for p, q in zip(b.column(0), b.column(1)):
                whole += np.frombuffer(p.as_py()).reshape(side, k).T @ np.frombuffer(q.as_py()).reshape(side, k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(whole.ravel())], ["at", "value"])

    both = x.select("bi", F.col("data").alias("x")).join(y.select("bi", F.col("data").alias("y")), "bi").select("x", "y")
    found = both.mapInArrow(partial, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(k * k)
    out[[r["at"] for r in found]] = [r["value"] for r in found]
    return out.reshape(k, k)


def _times(x: DataFrame, small: np.ndarray, side: int) -> DataFrame:
    @F.arrow_udf("binary")
    def turned(data: pa.Array) -> pa.Array:
        return pa.array([(np.frombuffer(d.as_py()).reshape(side, -1) @ small).tobytes() for d in data], pa.binary())

    return x.select("bi", "bj", turned("data").alias("data"))


def singular_values(matrix: DataFrame, k: int, rounds: int = 30, tolerance: float = 1e-9, side: int = SIDE) -> np.ndarray:
    """The ``k`` largest singular values, by rounds of a subspace under the Gram matrix. The subspace, a table of blocks of
    a few more columns than asked for, is made orthogonal by its k by k products; ends when no value moves by more than
    the tolerance's share."""
    width = k + 4
    own = materialize(gram(matrix, side), "gram")
    start = own.select("bi").distinct()

    @F.arrow_udf("binary")
    def random(at: pa.Array) -> pa.Array:
        return pa.array([np.random.default_rng([7, b.as_py()]).normal(size=(side, width)).tobytes() for b in at], pa.binary())

    x = materialize(start.select("bi", F.lit(0).cast("long").alias("bj"), random("bi").alias("data")), "subspace")
    last = np.zeros(k)
    for _ in range(rounds):
        y = materialize(multiply(own, x, side), "subspace")
        discard(x)
        # Columns of y made orthogonal: y times the inverse root of its products, dropping directions that are none.
        w, v = np.linalg.eigh(_inner(y, y, width, side))
        root = np.where(w > max(w.max(), 0) * 1e-24, 1 / np.sqrt(np.maximum(w, 1e-300)), 0.0)
        x = materialize(_times(y, v * root, side), "subspace")
        discard(y)
        values = np.sort(np.linalg.eigvalsh(_inner(x, multiply(own, x, side), width, side)))[::-1][:k]
        if np.all(np.abs(values - last) <= tolerance * max(values[0], 1e-300)):
            break
        last = values
    discard(x, own)
    return np.sqrt(np.maximum(values, 0.0))
