"""Exact deduplication by skew-safe combining.

1. *Local.* Each input partition keeps one winner (the largest id) for each
   distinct text that it holds; texts with equal digests are compared in full.
2. *Salted.* Only winners whose digest occurs in more than one local group move
   their text. They are grouped by (digest, salt, text), so a text with very
   many copies is spread over ``salts`` groups.
3. *Global.* One winner of each salt group is grouped by (digest, text).

The text is part of the grouping key in steps 2 and 3, so that equality of
whole texts, not of digests, decides. After step 1 a text occurs at most once
for each input partition, whatever the number of its copies.

The winners go back to the local groups by digest and checksum, two numbers for
each salt or group and never lists of members.

Nulls count as empty texts; all empty texts are equal. Rows are told apart by a
key of their own, not by their ids. A null id never wins over another id; where
a group has null ids only, keep_id is null. ``exact_groups`` counts a repeated
row as often as it occurs, and marks every row as kept whose id wins;
``drop_exact`` leaves exactly one row of each group. Columns other than id and
text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import materialize, ship, utf8

#: Bytes of distinct text and of rows that a task holds before it starts anew; later steps join what this parts.
HOLD_BYTES = 64 << 20
#: What a row costs beside its text, when it is held and when it is sent.
MEMBER_BYTES = 400
LOCAL = "row long, doc_id long, group long, lead boolean, digest string, crc long, copies long"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, list] = {}  # digest -> [(text, members)] for each distinct text
    size, group = 0, TaskContext.get().partitionId() << 40

    def flush(group: int):
        out = [[], [], [], [], [], [], []]
        for digest, same in held.items():
            h = digest.hex()
            for text, members in same:
                n, crc = len(members), zlib.crc32(text)
                top = max(range(n), key=lambda k: (members[k][1] is not None, members[k][1] or 0))
                for k, (row, i) in enumerate(members):
                    for column, value in zip(out, (row, i, group, k == top, h, crc, n)):
                        column.append(value)
                group += 1
        held.clear()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64())
        columns = [pa.array(x, k) for x, k in zip(out, kinds)]
        return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "group", "lead", "digest", "crc", "copies"]), group

    for batch in batches:
        for row, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
            text = text.lower()  # of bytes: A-Z only
            same = held.setdefault(hashlib.sha256(text).digest(), [])
            for whole, members in same:
                if whole == text:
                    members.append((row, i))
                    break
            else:
                same.append((text, [(row, i)]))
                size += len(text)
            size += MEMBER_BYTES
        if size > HOLD_BYTES:
            out, group = flush(group)
            yield out
            size = 0
    if held:
        yield flush(group)[0]


def normalised(text):
    """Column: null as empty, A-Z lower-cased and nothing else."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _grouped(texts: DataFrame, salts: int) -> DataFrame:
    """Of rows (row, doc_id, text): row, doc_id, keep_id, group_size, digest, and winner, the row that stays of the group."""
    local = materialize(texts.select("row", "doc_id", "text").mapInArrow(_local, LOCAL), "exact-local")
    leads = local.where("lead")
    shared = leads.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    moving = leads.join(shared, "digest", "left_semi").select("row", "group", "digest", "copies")
    bodies = texts.select("row", "doc_id", normalised(F.col("text")).alias("body")).join(moving, "row")
    best = lambda row, key: F.coalesce(F.max_by(row, key), F.max(row)).alias("winner")
    salted = bodies.groupBy("digest", F.pmod(F.xxhash64("group"), F.lit(salts)).alias("salt"), "body").agg(
        F.max("doc_id").alias("best"), best("row", "doc_id"), F.sum("copies").alias("copies")
    )
    merged = salted.groupBy("digest", "body").agg(F.max("best").alias("keep_id"), best("winner", "best"), F.sum("copies").alias("group_size"))
    found = materialize(merged.select("digest", F.crc32(F.col("body").cast("binary")).alias("crc"), "keep_id", "winner", "group_size"), "exact-groups")
    alone = leads.select("group", "digest", "crc", F.col("doc_id").alias("lead_id"), F.col("row").alias("lead_row"))
    winners = materialize(alone.join(found, ["digest", "crc"], "left").drop("digest", "crc"), "exact-winners")
    one = F.col("winner").isNull()
    return local.join(winners, "group").select(
        "row",
        "doc_id",
        F.when(one, F.col("lead_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("winner", "lead_row").alias("winner"),
        F.coalesce("group_size", "copies").alias("group_size"),
        "digest",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    ship(docs.sparkSession)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = _grouped(materialize(texts, "exact-texts"), salts)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return out.select("doc_id", "keep_id", "group_size", kept, F.col("digest").alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """Of each group of equal texts the row that stays, with all its columns."""
    ship(docs.sparkSession)
    own = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "exact-documents")
    found = _grouped(own.select(F.col("__row").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), salts)
    gone = found.where("row != winner").select(F.col("row").alias("__row"))
    return own.join(gone, "__row", "left_anti").select(docs.columns)
