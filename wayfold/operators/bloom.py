"""Bloom filters that thin one side of a join.

A filter of ``n`` keys for a wanted share of false positives has -n ln(p) / ln(2)^2
bits. Every task sets the bits of its keys in an array of its own and sends it in
pieces; the pieces are joined by OR in two steps, first in groups of tasks. The
whole filter, ``MOST_BYTES`` at most, goes to the tasks of the other side, which
drop rows whose keys it doesn't hold. A filter that would be larger isn't made:
the join goes without. Null keys are never in a filter, and join with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.shipping import ship

MOST_BYTES = 32 << 20
PIECE = 1 << 16
#: Groups of tasks whose pieces are joined first.
GROUPS = 32


def hashes(keys: list[str]) -> list[Column]:
    """Two hashes of a row's keys, from which all its places follow."""
    return [F.xxhash64(*keys).alias("h1"), F.xxhash64(*keys, F.lit(7)).alias("h2")]


def places(h1: np.ndarray, h2: np.ndarray, bits: int, k: int) -> np.ndarray:
    step = (h2.view(np.uint64) | np.uint64(1))[:, None] * np.arange(k, dtype=np.uint64)
    return ((h1.view(np.uint64)[:, None] + step) % np.uint64(bits)).astype(np.int64)


@dataclass
class Bloom:
    bits: int
    k: int
    data: np.ndarray  # bytes, the lowest bit of each first

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = places(h1, h2, self.bits, self.k)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)


def shape(n: int, error: float) -> tuple[int, int]:
    """Bits (whole pieces of bytes) and hash functions for n keys."""
    bits = max(64, math.ceil(-max(n, 1) * math.log(error) / math.log(2) ** 2))
    return -(-bits // 64) * 64, max(1, round(-math.log2(error)))


def build(df: DataFrame, keys: list[str], error: float = 0.01, n: int | None = None) -> Bloom | None:
    """The filter of a frame's keys; none if it would be larger than MOST_BYTES."""
    ship(df.sparkSession)
    known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))
    bits, k = shape(known.count() if n is None else n, error)
    if bits > 8 * MOST_BYTES:
        return None

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits, k).ravel()
            np.bitwise_or.at(own, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        pieces = range(0, len(own), PIECE)
        used = [p for p in pieces if own[p : p + PIECE].any()]
        group = TaskContext.get().partitionId() % GROUPS
        columns = [pa.array([p // PIECE for p in used], pa.int32()), pa.array([group] * len(used), pa.int32()), pa.array([own[p : p + PIECE].tobytes() for p in used], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["piece", "task_group", "data"])

    def joined(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            for data in batch.column(2):
                own = np.frombuffer(data.as_py(), np.uint8)
                whole = own.copy() if whole is None else whole | own
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([whole.tobytes()], pa.binary())], ["piece", "task_group", "data"])

    schema = "piece int, task_group int, data binary"
    parts = known.select(*hashes(keys)).mapInArrow(set_bits, schema)
    parts = parts.groupBy("piece", "task_group").applyInArrow(joined, schema).groupBy("piece").applyInArrow(joined, schema)
    data = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():  # MOST_BYTES in all
        own = np.frombuffer(bytes(row["data"]), np.uint8)
        data[row["piece"] * PIECE : row["piece"] * PIECE + len(own)] = own
    return Bloom(bits, k, data)


def maybe_in(bloom: Bloom, keys: list[str]) -> Column:
    """Column: the filter may hold a row's keys; false only for keys that aren't there."""

    @F.arrow_udf("boolean")
    def test(h1: pa.Array, h2: pa.Array) -> pa.Array:
        return pa.array(bloom.holds(h1.to_numpy(), h2.to_numpy()))

    whole = F.lit(True)
    for c in keys:
        whole = whole & F.col(c).isNotNull()
    return whole & test(*hashes(keys))


def thinned_join(large: DataFrame, small: DataFrame, keys: list[str], error: float = 0.01) -> DataFrame:
    """The inner join by equal keys; rows of the large side that the small side's filter doesn't hold go before they are moved."""
    bloom = build(small.select(*keys), keys, error)
    return (large if bloom is None else large.where(maybe_in(bloom, keys))).join(small, keys)
