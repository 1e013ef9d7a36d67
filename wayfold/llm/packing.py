"""Best-fit packing planned on the histogram of lengths.

1. Each document becomes its token ids and one separator id; one longer than a
   sequence is cut into whole sequences behind a first piece that takes the rest.
2. The lengths are counted: at most ``capacity`` rows, whatever the corpus.
3. Best fit in decreasing order runs on the counts. Sequences that are equally
   full form one group, so a step places all pieces of a length into a group at
   once; the outcome is that of best fit on the single pieces.
4. Pieces take the planned slots by their rank within their length. Ranks are
   row numbers within (length, salt) plus the sizes of the salts before, so a
   length that a third of all pieces share is ranked by many tasks. Salts come
   from a number of the row, so rows that repeat an id or have none are dealt out
   as others are, and ties go by that number.

Null counts as empty; an empty text is one piece of the separator alone. A very
long text is cut into as many pieces as it needs. Rows that repeat or have no id
are packed as often as they occur; other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.bpe import encode_text, library_codec
from wayfold.llm.common import materialize, ship

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces to a salt of a length, about, and the least number of salts.
SALT_ROWS, LEAST_SALTS = 500_000, 64


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: the first takes what whole sequences leave over."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Slots as rows (length, first rank, first sequence, pieces to a sequence, offset), by length and rank.

    The piece of a length with rank r falls under the last slot row whose first
    rank is not above r; there it is number i = r - first rank, in sequence
    first + i // pieces, at offset + (i % pieces) * length.
    """
    slots = []
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> [(first sequence, sequences)]
    rooms: list[int] = []  # rooms of groups, ascending
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not groups[room]:
                bisect.insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room = capacity
                first, n = sequences, -(-left // (capacity // length))
                sequences += n
            each = room // length
            full = min(n, left // each)
            offset = capacity - room
            if full:
                slots.append((length, rank, first, each, offset))
                put(room - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left and left < each:
                slots.append((length, rank, first, left, offset))
                put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    slots.sort()
    return np.array(slots, np.int64).reshape(-1, 5)


def tokenised(docs: DataFrame, path: str, capacity: int, separator: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of all documents."""
    end = separator.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library_codec(path)
        for batch in batches:
            rows = []
            for row, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = encode_text(text.as_py() or "", own) + end
                start = 0
                for k, n in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((row, i, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                    start += n
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES)


def pack(
    docs: DataFrame, path: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(tokenised(docs, path, capacity, separator, id_col, text_col), "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan(counts, capacity)
    salts = max(LEAST_SALTS, -(-sum(counts.values()) // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("row", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(within)).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.searchsorted(slots[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                lo, hi = starts[n], starts[n + 1]
                row[own] = lo + np.searchsorted(slots[lo:hi, 1], rank[own], "right") - 1
            _, first_rank, first, each, offset = slots[row].T
            i = rank - first_rank
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(first + i // each), pa.array(offset + i % each * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, f"{PIECES.removeprefix('row long, ')}, sequence_id long, offset long")
