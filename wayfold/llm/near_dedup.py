"""Near duplicates by b-bit MinHash.

1. *Sets.* A text's words (A-Z lower-cased, split at white space) give its set
   of 5-word shingles, hashed to 64 bits; with fewer words, the sequence is the
   one member. Documents whose whole sets have one cryptographic digest form a
   class, and the row of its smallest id stands for it from here on, so copies
   cost nothing further.
2. *Signatures.* 128 minima. Bands of 4 give 32 bucket keys; of each minimum,
   mixed anew for each function, 4 bits are kept, packed into eight 64-bit
   words. A pair at similarity 0.75 misses all buckets with probability 5e-6.
3. *Candidates.* Members of a bucket are compared in blocks of bounded size.
   The share of equal 4-bit values, counted by XOR and bit counts and corrected
   for the 1 in 16 that agree by chance, estimates the similarity; pairs five
   standard errors below the bound are no candidates. A block emits for each
   member the component of candidates that it belongs to, never pairs, and the
   components of all blocks together are the clusters of candidates.
4. *Confirmation.* The full sets of a cluster's members meet in blocks of
   bounded size, each set once for each block. All pairs of a block that aren't
   joined yet and whose estimate allows it are compared on their full sets;
   again a block emits components, never pairs.

So each step's rows grow with the number of documents (and of blocks, in a
group larger than one block), whatever the size of a group of near copies and
however many of its pairs fall just short of the bound. Every candidate pair is
either confirmed, refuted, or within a component that other pairs confirm.

A text without words, or null, has an empty set and links with nothing; its row
always stays. Rows are told apart by a key of their own: rows that repeat an id
count each by its text. A row without an id takes part, but its id names no
component as long as another one can; a component of such rows has a null
component_id. ``near_groups`` marks every row as kept whose id is that of its
component; ``drop_near`` leaves exactly one row of each component. Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import collapse, discard, materialize, ship, whole_groups
from wayfold.llm.components import connected
from wayfold.llm.words import C3, NOT_SPACE, mix, slices, words

SHINGLE, HASHES, BAND, BITS = 5, 128, 4, 4
BANDS = HASHES // BAND
PACKED = HASHES * BITS // 64
PERCENT = 75
#: Five standard errors of the estimate at the bound, in equal values of HASHES.
LEAST_EQUAL = int(HASHES * (0.75 + 0.25 / 16) - 5 * (HASHES * 0.766 * 0.234) ** 0.5)
#: Members of a bucket, and bytes of full sets, in a block; two blocks meet at a time.
BLOCK, BLOCK_BYTES = 1 << 14, 16 << 20

_RNG = np.random.default_rng(20240229)
MULTIPLY = _RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
SIGN = [f"s{k}" for k in range(PACKED)]
SIGNATURE = "row long, doc_id long, n_shingles long, d0 long, d1 long, bands array<long>, " + ", ".join(f"{s} long" for s in SIGN)


def shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first, one past the last, all sets in order (each sorted), and where each set starts and ends."""
    for at, to, own, ends in slices(column):
        h, upto = words(own, ends, NOT_SPACE)
        from_ = np.concatenate(([0], upto))
        count = np.diff(from_)
        n = len(h) - SHINGLE + 1
        if n > 0:
            g = h[:n].copy()
            for j in range(1, SHINGLE):
                g = mix(g * C3 + h[j : j + n])
        else:
            n, g = 0, np.zeros(0, np.uint64)
        parts, sizes = [], np.zeros(to - at, np.int64)
        for k in range(to - at):
            if count[k] >= SHINGLE:
                s = np.sort(g[from_[k] : from_[k + 1] - SHINGLE + 1])
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif count[k]:
                s = np.array([count[k]], np.uint64) * C3
                for x in h[from_[k] : from_[k + 1]]:
                    s = mix(s * C3 ^ x)
            else:
                continue
            parts.append(s)
            sizes[k] = len(s)
        yield at, to, np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate(([0], sizes.cumsum()))


def minima(members: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least value of each hash function over each non-empty set: one row for each set."""
    own = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(own), HASHES), np.uint32)
    low = (members >> np.uint64(32)).astype(np.uint32)
    step = 1 << 15
    k = 0
    while k < len(own):  # rows of about so many members at a time stay in the cache
        to = max(k + 1, int(np.searchsorted(bounds[own + 1], bounds[own[k]] + step, "right")))
        a, b = bounds[own[k]], bounds[own[to - 1] + 1]
        part, starts = low[a:b], bounds[own[k:to]] - a
        value = np.empty_like(part)
        for j in range(HASHES):
            np.multiply(part, MULTIPLY[j], out=value)
            value += ADD[j]
            out[k:to, j] = np.minimum.reduceat(value, starts)
        k = to
    return out


def packed_bits(least: np.ndarray) -> np.ndarray:
    """BITS of each row's minima in 64-bit words. The minima are mixed first, differently for each
    function: low bits of a*x+b with odd a agree for all functions or for none."""
    per = 64 // BITS
    salt = np.arange(HASHES, dtype=np.uint64) * C3
    out = np.zeros((len(least), PACKED), np.uint64)
    for k in range(0, len(least), 512):
        low = mix(least[k : k + 512].astype(np.uint64) + salt) & np.uint64((1 << BITS) - 1)
        for j in range(per):
            out[k : k + 512] |= low[:, j::per] << np.uint64(BITS * j)
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, doc_id, text) as SIGNATURE."""
    names = ["row", "doc_id", "n_shingles", "d0", "d1", "bands", *SIGN]
    for batch in batches:
        for at, to, members, bounds in shingles(batch.column(2)):
            n, size = to - at, np.diff(bounds)
            own = np.flatnonzero(size)
            digest = np.zeros((n, 2), np.int64)
            bands, packed = np.zeros((n, BANDS), np.uint64), np.zeros((n, PACKED), np.uint64)
            if len(own):
                raw = memoryview(members).cast("B")
                for k in own.tolist():
                    digest[k] = np.frombuffer(hashlib.blake2b(raw[8 * bounds[k] : 8 * bounds[k + 1]], digest_size=16).digest(), "<i8")
                least = minima(members, bounds)
                wide = least.astype(np.uint64)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(own), BANDS)).copy()
                for j in range(BAND):
                    key = mix(key * C3 + wide[:, j::BAND])
                bands[own] = key
                packed[own] = packed_bits(least)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(np.where(size > 0, BANDS, 0)))), pa.int32()), pa.array(bands[own].ravel().view(np.int64))
            )
            columns = [batch.column(0)[at:to], batch.column(1)[at:to], pa.array(size), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), lists]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(packed[:, k].copy().view(np.int64)) for k in range(PACKED))], names)


ONES = np.uint64(sum(1 << k for k in range(0, 64, BITS)))  # the lowest bit of each value
SHIFTS = [np.uint64(1 << k) for k in range(BITS.bit_length() - 1)]


def agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the packed values of rows agree."""
    v = x ^ y
    for shift in SHIFTS:
        v |= v >> shift
    v &= ONES
    return HASHES - np.bitwise_count(v).sum(-1, dtype=np.int64)


def _signs(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.stack([batch.column(at + k).to_numpy() for k in range(PACKED)], 1).view(np.uint64)


def _labelled(batches: Iterator[pa.RecordBatch], component, pairs) -> Iterator[pa.RecordBatch]:
    """Rows (group, lo, hi, row, ..) as links (a, b) of each row to the representative of its component in the group.

    ``pairs(batch, places)`` tells for groups of two, which are most, whether they link.
    """
    for batch, start in whole_groups(batches, 3):
        ids = batch.column(3).to_numpy()
        size = np.diff(np.append(start, len(ids)))
        two = start[size == 2]
        two = two[pairs(batch, two)]
        a, b = [ids[two]], [ids[two + 1]]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            label = component(batch.slice(s, n))
            own = np.flatnonzero(label != np.arange(n))
            a.append(ids[s + own])
            b.append(ids[s + label[own]])
        if sum(map(len, a)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, lo, hi, row, s0, ..): links between candidates."""

    def component(group: pa.RecordBatch) -> np.ndarray:
        sign = _signs(group, 4)
        return collapse(len(sign), lambda i, among: among[agree(sign[i], sign[among]) >= LEAST_EQUAL])

    def pairs(batch: pa.RecordBatch, two: np.ndarray) -> np.ndarray:
        sign = _signs(batch, 4)
        return agree(sign[two], sign[two + 1]) >= LEAST_EQUAL

    return _labelled(batches, component, pairs)


class FullSets:
    """The sets of a block: which members are similar enough to one of them."""

    #: Elements of candidates that are searched one by one; more are counted through an index of the block.
    FEW = 1 << 15

    def __init__(self, sign: np.ndarray, sets: pa.Array):
        ends = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1].astype(np.int64)
        self.sign, self.members = sign, np.frombuffer(sets.buffers()[2], np.uint64, (ends[-1] - ends[0]) // 8, ends[0])
        self.bounds = (ends - ends[0]) // 8
        self.size = np.diff(self.bounds)
        self.hot = None

    def own(self, i: int) -> np.ndarray:
        return self.members[self.bounds[i] : self.bounds[i + 1]]

    def near(self, i: int, among: np.ndarray) -> np.ndarray:
        n = self.size[among]
        among = among[(PERCENT * np.maximum(n, self.size[i]) <= 100 * np.minimum(n, self.size[i])) & (agree(self.sign[i], self.sign[among]) >= LEAST_EQUAL)]
        if not len(among):
            return among
        both = self._searched(i, among) if self.size[among].sum() <= self.FEW else self._indexed(i)[among]
        return among[100 * both >= PERCENT * (self.size[among] + self.size[i] - both)]

    def _searched(self, i: int, among: np.ndarray) -> np.ndarray:
        own, rest = self.own(i), np.concatenate([self.own(j) for j in among.tolist()])
        place = np.minimum(np.searchsorted(own, rest), len(own) - 1)
        return np.add.reduceat((own[place] == rest).astype(np.int64), np.cumsum(self.size[among]) - self.size[among])

    def _indexed(self, i: int) -> np.ndarray:
        """Sizes of the intersections with all members: of elements that many have by a matrix, of others by lists of owners."""
        if self.hot is None:
            owner = np.repeat(np.arange(len(self.size)), self.size)
            order = np.argsort(self.members, kind="stable")
            sorted_ = self.members[order]
            first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
            count = np.diff(np.append(first, len(sorted_)))
            self.owners, self.first, self.count = owner[order], first, count
            element = np.empty(len(order), np.int64)
            element[order] = np.repeat(np.arange(len(first)), count)
            self.element = element
            self.column = np.full(len(first), -1)
            hot = np.flatnonzero(count > len(self.size) // 4)
            self.column[hot] = np.arange(len(hot))
            self.hot = np.zeros((len(self.size), len(hot)), np.float32)
            some = self.column[element] >= 0
            self.hot[owner[some], self.column[element[some]]] = 1
        both = (self.hot @ self.hot[i]).astype(np.int64)
        rare = self.element[self.bounds[i] : self.bounds[i + 1]]
        rare = rare[(self.column[rare] < 0) & (self.count[rare] > 1)]
        n = self.count[rare]
        place = np.arange(n.sum()) + np.repeat(self.first[rare] - (np.cumsum(n) - n), n)
        return both + np.bincount(self.owners[place], minlength=len(self.size))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, lo, hi, row, s0, .., full set): links that the full sets confirm."""

    def component(group: pa.RecordBatch) -> np.ndarray:
        sets = FullSets(_signs(group, 4), group.column(4 + PACKED))
        return collapse(len(sets.size), sets.near)

    def pairs(batch: pa.RecordBatch, two: np.ndarray) -> np.ndarray:
        sets = FullSets(_signs(batch, 4), batch.column(4 + PACKED))
        other = np.array([1])
        found = [len(FullSets.near(sets, k, k + other)) > 0 for k in two.tolist()]
        return np.array(found, bool)

    return _labelled(batches, component, pairs)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, blocks, row, s0, .., text) with the bytes of the full set in the place of the text."""
    for batch in batches:
        for at, to, members, bounds in shingles(batch.column(batch.num_columns - 1)):
            sets = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer((8 * bounds).astype(np.int32)), pa.py_buffer(members)])
            yield pa.RecordBatch.from_arrays([*(c[at:to] for c in batch.columns[:-1]), sets], [*batch.schema.names[:-1], "members"])


def _met(rows: DataFrame, group: str) -> DataFrame:
    """Each row once for each pair of its block with a block of its group, dealt out by pair."""
    own = F.pmod(F.xxhash64("row"), F.col("blocks"))
    other = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    named = other.select(group, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *(c for c in rows.columns if c not in (group, "blocks")))
    # By row, so that the blocks that a member is in tend to name the same representative for it.
    return named.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", "row")


def _grouped(texts: DataFrame) -> DataFrame:
    """Of rows (row, doc_id, text): row, doc_id, n_shingles, component_id, and winner, the row that stays of the component."""
    signed = materialize(texts.select("row", "doc_id", "text").mapInArrow(_signatures, SIGNATURE), "near-signatures")
    first = lambda key: F.coalesce(F.min_by(key, "doc_id"), F.min(key))
    digest = ["d0", "d1", "n_shingles"]
    classes = signed.where("n_shingles > 0").groupBy(digest).agg(first("row").alias("rep"), F.min("doc_id").alias("rep_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    whole = signed.join(materialize(classes, "near-classes"), digest, "left")
    whole = whole.withColumns({"rep_id": F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("rep_id")), "rep": F.coalesce("rep", "row")})
    lone = (F.col("row") == F.col("rep")) & (F.col("n_shingles") > 0)
    members = materialize(whole.select("row", "doc_id", "n_shingles", "rep", "rep_id", F.when(lone, F.col("bands")).alias("bands"), *SIGN), "near-members")
    discard(signed)
    signs = members.where("bands IS NOT NULL").select("row", "n_shingles", *SIGN)
    rows = members.where("bands IS NOT NULL").select(F.explode("bands").alias("key"), "row")
    counts = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = materialize(rows.join(counts, "key"), "near-shared")
    alike = _met(shared.join(signs.drop("n_shingles"), "row"), "key").mapInArrow(_alike, "a long, b long")
    clusters = connected(alike, "near-clusters").withColumnRenamed("id", "row").withColumnRenamed("component", "cluster")
    signed = clusters.join(signs, "row")
    sizes = signed.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(8 * F.sum("n_shingles") / BLOCK_BYTES)).alias("blocks"))
    wanted = materialize(signed.join(sizes, "cluster").select("cluster", "blocks", "row", *SIGN), "near-wanted")
    schema = "cluster long, blocks long, row long, " + ", ".join(f"{s} long" for s in SIGN) + ", members binary"
    sets = wanted.join(texts.select("row", "text"), "row").select("cluster", "blocks", "row", *SIGN, "text").mapInArrow(_full_sets, schema)
    found = connected(_met(sets, "cluster").mapInArrow(_confirmed, "a long, b long"), "near-components")
    named = found.join(members.select("row", "doc_id"), found["id"] == members["row"]).select("id", "component", "doc_id")
    best = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), first("id").alias("winner"))
    placed = materialize(found.join(best, "component").select(F.col("id").alias("rep"), "component_id", "winner"), "near-placed")
    out = members.select("row", "doc_id", "n_shingles", "rep", "rep_id").join(placed, "rep", "left")
    named = F.when(F.col("winner").isNull(), F.col("rep_id")).otherwise(F.col("component_id"))
    return out.select("row", "doc_id", "n_shingles", named.alias("component_id"), F.coalesce("winner", "rep").alias("winner"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    ship(docs.sparkSession)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = _grouped(materialize(texts, "near-texts"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns."""
    ship(docs.sparkSession)
    own = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "near-documents")
    found = _grouped(own.select(F.col("__row").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    gone = found.where("row != winner").select(F.col("row").alias("__row"))
    return own.join(gone, "__row", "left_anti").select(docs.columns)
