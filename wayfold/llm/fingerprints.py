"""Document fingerprints by one-permutation MinHash.

A text's words (A-Z lower-cased, split at white space) give its set of 5-word
shingles, hashed to 64 bits; with fewer words, the sequence is the one member.

1. *Bins.* Each shingle is hashed once: its high bits name one of ``BINS`` bins,
   and the least hash of each bin stays.
2. *Densification.* An empty bin takes the value of another bin: every bin has
   its own fixed order of all bins, in which the first one that isn't empty is
   taken. So the lender of each empty bin is an even draw, apart from that of
   other empty bins, and two sets with the same bins filled draw alike.
3. *Packing.* Of each value the low ``BITS`` bits are kept: 128 bytes, in
   hexadecimal. The share of equal values, less the 1 in 16 that agree by
   chance, estimates the similarity (its standard error is 0.03 at 0.75).

A text without words has the empty fingerprint, whose likeness to itself is 1
and to any other 0. Equal texts have equal fingerprints, and likeness 1.

``edited_fingerprints`` puts documents in the order of their ids (ties by a
hash of the text; rows without ids first) by ranges, one range a task, so that
a task meets each row beside the next one. The last row of a task takes the
text of the first row of the next task that has rows: these are as many rows as
tasks. Texts move once. A null text counts as empty. Rows that repeat an id
count each and follow one another; a single row follows itself; an empty table
gives an empty result. Other columns are ignored. A task holds an Arrow batch of
texts and works on about a megabyte at a time; a longer text goes alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import materialize, ship
from wayfold.llm.near_dedup import shingles

BINS, BITS = 256, 4
WORDS = BINS * BITS // 64
#: For each bin the order in which it asks the others when it is empty.
LENDERS = np.random.default_rng(20240413).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)
#: Characters of text that are worked on at once.
STEP = 1 << 20
ONES = np.uint64(sum(1 << k for k in range(0, 64, BITS)))  # the lowest bit of each value
CHANCE = 1 / (1 << BITS)
PASSED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, first boolean, open boolean, text string"


def dense(values: np.ndarray, filled: np.ndarray) -> None:
    """Fill the empty bins of rows that have any other."""
    count = filled.sum(1)
    alone = np.flatnonzero(count == 1)
    values[alone] = values[alone, filled[alone].argmax(1)][:, None]
    rows, columns = np.nonzero(~filled & (count > 1)[:, None])
    for ask in range(BINS):
        if not len(rows):
            break
        lender = LENDERS[columns, ask]
        lends = filled[rows, lender]
        values[rows[lends], columns[lends]] = values[rows[lends], lender[lends]]
        rows, columns = rows[~lends], columns[~lends]


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of each text as words of 64 bits, and whether the text has words."""
    out, some = np.zeros((len(column), WORDS), np.uint64), np.zeros(len(column), bool)
    for at, to, members, bounds in shingles(column):
        n, size = to - at, np.diff(bounds)
        place = np.repeat(np.arange(n), size) * BINS + (members >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))  # a set is sorted: the first of a bin is its least
        values, filled = np.zeros(n * BINS, np.uint8), np.zeros(n * BINS, bool)
        values[place[first]] = (members[first] & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        filled[place[first]] = True
        values, filled = values.reshape(n, BINS), filled.reshape(n, BINS)
        dense(values, filled)
        for j in range(64 // BITS):
            out[at:to] |= values[:, j :: 64 // BITS].astype(np.uint64) << np.uint64(BITS * j)
        some[at:to] = size > 0
    return out, some


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Estimated similarity of the sets behind fingerprints, row by row, corrected for values that agree by chance."""
    (a, some), (b, others) = x, y
    v = a ^ b
    for shift in range(BITS.bit_length() - 1):
        v |= v >> np.uint64(1 << shift)
    share = 1 - np.bitwise_count(v & ONES).sum(-1, dtype=np.int64) / BINS
    found = np.clip((share - CHANCE) / (1 - CHANCE), 0.0, 1.0)
    return np.where(some & others, found, np.where(some | others, 0.0, 1.0))


def texts_of(prints: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Fingerprints in hexadecimal; the empty string where a text has no words."""
    whole = prints[0].astype("<u8", copy=False)
    return [row.tobytes().hex() if some else "" for row, some in zip(whole, prints[1].tolist())]


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints from their text; a null or empty one has no words."""
    rows = [bytes.fromhex(t) if t else b"" for t in column.to_pylist()]
    some = np.array([len(r) > 0 for r in rows], bool)
    return np.frombuffer(b"".join(r or bytes(8 * WORDS) for r in rows), "<u8").reshape(-1, WORDS), some


def fingerprint(text: Column | str) -> Column:
    """Column: the fingerprint of a text."""

    @F.arrow_udf("string")
    def print_(column: pa.Array) -> pa.Array:
        return pa.array(texts_of(packed(column)), pa.string())

    return print_(text)


def fingerprint_likeness(a: Column | str, b: Column | str) -> Column:
    """Column: estimated similarity of the documents of two fingerprints, 0 to 1."""

    @F.arrow_udf("double")
    def likeness_(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(likeness(_read(x), _read(y)))

    return likeness_(a, b)


def edited(text: str, other: str) -> str:
    """The text with its last quarter replaced by the beginning of another."""
    n = len(text) // 4
    return text[: len(text) - n] + other[:n]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= STEP):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


class _Out:
    """Rows of PASSED."""

    def __init__(self, part: int):
        self.part, self.rows = part, 0

    def batch(self, ids: list, texts: list[str], own, edits: list[str] | None, prints, near_next, first: bool) -> pa.RecordBatch:
        n = len(ids)
        open_ = edits is None
        none = lambda kind: pa.nulls(n, kind)
        shown = [t if open_ or (first and k == 0) else None for k, t in enumerate(texts)]
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            none(pa.string()) if open_ else pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
            pa.array(texts_of(own), pa.string()),
            none(pa.string()) if open_ else pa.array(texts_of(prints), pa.string()),
            none(pa.float64()) if open_ else pa.array(likeness(own, prints)),
            none(pa.float64()) if open_ else pa.array(near_next),
            pa.array([self.part] * n, pa.int32()),
            pa.array([first and k == 0 for k in range(n)], pa.bool_()),
            pa.array([open_] * n, pa.bool_()),
            pa.array(shown, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PASSED.split(", ")])


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) in order as PASSED: all but the last meet the next; the first and the last of a task keep their text."""
    out, held, first = _Out(TaskContext.get().partitionId()), None, True
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, to in _chunks(texts):
            own_ids, own = ids[at:to], texts[at:to]
            if held is not None:
                own_ids, own = [held[0], *own_ids], [held[1], *own]
            prints = packed(pa.array(own, pa.large_string()))
            if len(own) > 1:
                edits = [edited(a, b) for a, b in zip(own, own[1:])]
                head, tail = tuple(p[:-1] for p in prints), tuple(p[1:] for p in prints)
                yield out.batch(own_ids[:-1], own[:-1], head, edits, packed(pa.array(edits, pa.large_string())), likeness(head, tail), first)
                first = False
            held = own_ids[-1], own[-1]
    if held is not None:
        yield out.batch([held[0]], [held[1]], packed(pa.array([held[1]], pa.large_string())), None, None, None, first)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, next text) as PASSED."""
    out = _Out(0)
    for batch in batches:
        for i, a, b in zip(*(batch.column(k).to_pylist() for k in range(3))):
            own, other, new = (packed(pa.array([t], pa.large_string())) for t in (a, b, edited(a, b)))
            yield out.batch([i], [a], own, [edited(a, b)], new, likeness(own, other), False)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    passed = materialize(ordered.mapInArrow(_beside, PASSED), "fingerprints")
    heads = passed.where("first").select(F.col("part").alias("head_part"), F.col("text").alias("head"))
    tasks = Window.orderBy("head_part")  # a row for each task
    links = heads.select("head_part").withColumns({"after": F.lead("head_part").over(tasks), "least": F.first("head_part").over(tasks)})
    links = links.select(F.col("head_part").alias("part"), F.coalesce("after", "least").alias("head_part"))
    lasts = passed.where("open").select("part", "doc_id", "text").join(links, "part").join(heads, "head_part")
    closed = lasts.select("doc_id", "text", "head").mapInArrow(_across, PASSED)
    return passed.where("NOT open").unionByName(closed).drop("part", "first", "open", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each document."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(text).alias("fingerprint"))
