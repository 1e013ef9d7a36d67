"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.shared import discard, materialize, shared_dir  # noqa: F401
from wayfold.functions.shipping import ship  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    elif pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    return [b if b is not None else b"" for b in col.to_pylist()]


def code_points(data: bytes, offsets: list[int]) -> list[int]:
    """Byte offsets, in ascending order, as offsets in code points."""
    if data.isascii():
        return offsets
    out, at, n = [], 0, 0
    for o in offsets:
        n += len(data[at:o].decode("utf-8", "surrogatepass"))
        at = o
        out.append(n)
    return out


def spans_text(spans, base_only: bool = False):
    """SQL column: ``kind:start:end`` of spans in their order, comma-joined."""
    if base_only:
        spans = F.filter(spans, lambda s: s["base"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def _changes(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Places (from 1) whose first ``keys`` columns differ from the row before."""
    change = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in range(keys):
        own = batch.column(k).to_numpy(zero_copy_only=False)
        change |= own[1:] != own[:-1]
    return np.flatnonzero(change) + 1


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Of rows sorted by their first ``keys`` columns of longs: batches that hold whole groups, and where each group starts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[0].column(k)[0] == batch.column(k)[batch.num_rows - 1] for k in range(keys)):
            held.append(batch)
            continue
        cuts = _changes(batch, keys)
        cut = int(cuts[-1]) if len(cuts) else 0
        ready = [b for b in (*held, batch.slice(0, cut)) if b.num_rows]
        held = [batch.slice(cut)]
        if ready:
            out = _joined(ready)
            yield out, np.concatenate(([0], _changes(out, keys)))
    if held:
        out = _joined(held)
        yield out, np.concatenate(([0], _changes(out, keys)))


#: Members that are held against all others before the rest is taken one by one.
PIVOTS = 32


def collapse(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Components of ``n`` members as the place of each one's representative; ``near`` tells which of some places link with one.

    Some pivots are held against all members, which joins most of what belongs
    together; then each member outside the largest component is held against
    all that are in other ones. Pairs within a component need no look, and no
    list of pairs is made.
    """
    label = np.arange(n)

    def held(i: int) -> int:
        among = np.flatnonzero(label != label[i])
        found = near(i, among) if len(among) else among
        if len(found):
            joined = np.zeros(n, bool)
            joined[label[found]] = joined[label[i]] = True
            label[joined[label]] = np.flatnonzero(joined)[0]
        return len(found)

    done = np.zeros(n, bool)
    for _ in range(min(n - 1, PIVOTS)):
        largest = np.bincount(label).argmax()
        open_ = np.flatnonzero(~done & (label != largest)) if done.any() else np.arange(1)
        if not len(open_):
            break
        done[open_[0]] = True
        if held(int(open_[0])) * 64 < n and n > PIVOTS:
            break
    if n > 2:
        largest = np.bincount(label).argmax()
        for i in np.flatnonzero((label != largest) & ~done).tolist():
            if label[i] != label[largest]:
                held(i)
    return label
