"""Removal of repeated passages, exact to the byte.

Each byte covered by a ``length``-byte string that also starts earlier in the
corpus (smaller id, or earlier in the same document) is removed. Strings are
judged on the input; they may overlap and never cross documents.

*Dealing.* A window of ``length`` bytes belongs to the least hash among its
40-byte strings, so equal windows belong to equal keys wherever they stand.
Successive windows of one key form a segment. A first pass sends only keys and
ids and finds the keys that occur twice; only segments of those keys then send
their bytes, each distinct segment once for each slice of a task. A passage
that stands in a third of all documents therefore reaches its key's task once
for each slice, not once for each document. A key that more than ``HOT``
documents share, such as a common line between ever other neighbours, is not
sent as segments: each of its windows goes by a digest of its whole 100 bytes,
again each distinct one once for each slice, so that no task holds a key whole.

*Deciding.* The segments of a set of keys, apart by a separator that UTF-8
lacks, form one text. Its suffixes are ordered by their first 128 bytes, and
from the Burrows-Wheeler transform the borders between suffixes are found by
threshold-bounded interval expansion: starting with the interval of the empty
string, intervals are extended backward by one character, breadth first, so
common prefixes are derived by increasing length; an interval that sets no new
border is not followed, and at ``length`` the expansion stops. Suffixes that no
border parts share their first ``length`` bytes; of each such class all but the
earliest are removed.

Null counts as empty. Texts shorter than ``length`` bytes lose nothing. Rows are
told apart by id and text: of two rows with one id and different texts, the one
whose text has the smaller hash comes first; rows equal in both are one document
given twice, and each gets its result. A row without an id takes no part and
keeps its text. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import materialize, ship, utf8
from wayfold.llm.words import C3, mix

LENGTH, GRAM = 100, 40
#: Bytes of text in which a task combines before it sends, and that it decides at once.
SLICE = 8 << 20
SHARD = 2 << 20
#: Documents that share a key; the windows of a key of more are dealt one by one.
HOT = 16384
SEPARATOR = 0xFF


def sliding(values: np.ndarray, width: int, of=np.minimum, fill: int = 2**64 - 1) -> np.ndarray:
    """The least (or largest) of each run of ``width`` values: prefixes and suffixes of blocks, in two passes."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, fill, values.dtype)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = of.accumulate(blocks, axis=1).ravel()
    behind = of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment: first window, one past the last, key, and whether its key string stands in it twice."""
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none, none, none, np.zeros(0, bool)
    own = np.frombuffer(text, np.uint8)
    view = np.ndarray((len(own) - 7,), "<u8", text, strides=(1,))
    grams = len(own) - GRAM + 1
    h = mix(view[:grams] + C3)
    for k in range(8, GRAM, 8):
        h = mix(h ^ view[k : k + grams])
    width = length - GRAM + 1
    least = sliding(h, width)
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    start, stop = np.concatenate(([0], cut)), np.concatenate((cut, [len(least)]))
    key = least[start]
    # Strings that are the least of a window, and the values that two of them close by share.
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    place = np.flatnonzero(h == sliding(padded, width, np.maximum, 0))
    value = h[place]
    order = np.lexsort((place, value))
    v, p = value[order], place[order]
    twice = np.unique(v[1:][(v[1:] == v[:-1]) & (p[1:] - p[:-1] <= width)])
    return start, stop, key.view(np.int64), np.isin(key, twice)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows in lists of about SLICE bytes of text."""
    rows, size = [], 0
    for batch in batches:
        rest = [c.to_pylist() for c in batch.columns[2:]]
        for row in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), *rest):
            rows.append(row)
            size += len(row[1])
            if size >= SLICE:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _keys(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (text_id, text) as (key, text_id, known): known if the key occurs twice in the slice; one row of a key in a slice is never known."""
        for rows in _sliced(batches):
            keys, ids, again = [], [], []
            for i, text in ((r[0], r[1]) for r in rows):
                _, _, key, twice = segments(text, length)
                if len(key):
                    one, n = np.unique(key, return_counts=True)
                    keys.append(one)
                    ids.append(np.full(len(one), i, np.int64))
                    again.append((n > 1) | np.isin(one, key[twice]))
            if not keys:
                continue
            key, doc, more = np.concatenate(keys), np.concatenate(ids), np.concatenate(again)
            order = np.argsort(key, kind="stable")
            key, doc, more = key[order], doc[order], more[order]
            same = key[1:] == key[:-1]
            first = np.concatenate(([True], ~same))
            known = more.copy()
            known[1:] |= same
            known[:-1] |= same
            # The first row of a key stands for the slice, and is sent as known besides.
            out_key = np.concatenate((key[first], key[known]))
            out_doc = np.concatenate((doc[first], doc[known]))
            out_known = np.concatenate((np.zeros(first.sum(), bool), np.ones(known.sum(), bool)))
            yield pa.RecordBatch.from_arrays([pa.array(out_key), pa.array(out_doc), pa.array(out_known)], ["key", "text_id", "known"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, text_id, known) by key, those known and those whose key another row shares."""
    held, shared = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        key, doc, known = new if held is None else (np.concatenate((x, y)) for x, y in zip(held, new))
        hit = known.copy()
        same = (key[1:] == key[:-1]) & ~known[1:] & ~known[:-1]
        hit[1:] |= same
        hit[:-1] |= same
        if held is not None and shared:
            hit[0] = True
        shared = bool(hit[-1])
        out = hit[:-1]
        held = [x[-1:] for x in (key, doc, known)]
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[:-1][out]), pa.array(key[:-1][out])], ["text_id", "key"])
    if held is not None and shared:
        yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[0])], ["text_id", "key"])


PIECE = "kind int, key long, sub long, doc_id long, text_id long, start long, stop long, twice boolean, bytes binary"
SEGMENT, REPEAT, WINDOW = 0, 1, 2


def _runs(own: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of successive numbers."""
    if not len(own):
        return []
    cut = np.flatnonzero(np.diff(own) > 1)
    return list(zip(own[np.concatenate(([0], cut + 1))].tolist(), own[np.concatenate((cut, [len(own) - 1]))].tolist()))


def _pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (text_id, text, doc_id, keys, hot keys) as PIECE: segments with their bytes, windows of hot keys by
        their digest (key and sub), and repeats, whose windows from start to stop the slice has already."""
        names = [c.split()[0] for c in PIECE.split(", ")]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        for rows in _sliced(batches):
            seen: set[bytes] = set()
            out: list[list] = [[] for _ in names]

            def put(*values) -> None:
                for column, value in zip(out, values):
                    column.append(value)

            last = None
            for r, text, i, keys, hot in sorted(rows, key=lambda x: (x[2], x[0])):
                if (i, r) == last:  # the same document once more
                    continue
                last = (i, r)
                start, stop, key, twice = segments(text, length)
                chosen = np.flatnonzero(np.isin(key, np.array(keys, np.int64)))
                for s, e, k, t in zip(start[chosen].tolist(), stop[chosen].tolist(), key[chosen].tolist(), twice[chosen].tolist()):
                    piece = text[s : e + length - 1]
                    if piece in seen:
                        put(REPEAT, k, 0, i, r, s, e, t, None)
                    else:
                        seen.add(piece)
                        put(SEGMENT, k, 0, i, r, s, e, t, piece)
                again: list[int] = []
                for k in np.flatnonzero(np.isin(key, np.array(hot, np.int64))).tolist() if hot else ():
                    for s in range(int(start[k]), int(stop[k])):
                        digest = hashlib.blake2b(text[s : s + length], digest_size=16).digest()
                        if digest in seen:
                            again.append(s)
                        else:
                            seen.add(digest)
                            put(WINDOW, *np.frombuffer(digest, "<i8").tolist(), i, r, s, s + 1, False, None)
                for s, e in _runs(np.array(again, np.int64)):
                    put(REPEAT, s, 0, i, r, s, e + 1, False, None)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return run


def suffix_order(text: np.ndarray, depth: int = 128) -> np.ndarray:
    """Places of the suffixes by their first ``depth`` bytes."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    word = np.ndarray((n,), ">u8", padded.data, strides=(1,)).astype(np.uint64)
    order = np.argsort(word, kind="stable")
    w = word[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(w[1:] != w[:-1])))
    got = 8
    while got < depth and rank[order[-1]] < n - 1:
        ahead = np.full(n, -1, np.int64)
        ahead[: n - got] = rank[got:] if got < n else ahead[:0]
        pair = rank * (n + 1) + ahead + 1
        order = np.argsort(pair, kind="stable")
        p = pair[order]
        rank[order] = np.concatenate(([0], np.cumsum(p[1:] != p[:-1])))
        got *= 2
    return order


def expand_intervals(bwt: np.ndarray, length: int) -> np.ndarray:
    """Whether a border stands before each suffix in order: its common prefix with the one before is shorter than ``length``."""
    n = len(bwt)
    psi = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[psi] = np.arange(n)
    char = bwt[psi]
    after, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)  # the next and the last place of the same character
    same = char[1:] == char[:-1]
    after[psi[:-1][same]] = psi[1:][same]
    before[psi[1:][same]] = psi[:-1][same]
    border = np.zeros(n + 1, bool)
    lo, hi = np.array([0]), np.array([n])
    for level in range(length):
        size = hi - lo
        total = int(size.sum())
        if not total:
            break
        ends = np.cumsum(size)
        place = np.arange(total) + np.repeat(lo - (ends - size), size)
        if level:
            keep = bwt[place] != SEPARATOR
            first = place[keep & (before[place] < np.repeat(lo, size))]
            last = place[keep & (after[place] >= np.repeat(hi, size))]
        else:
            first, last = place[before[place] < 0], place[after[place] >= n]
        new_lo, new_hi = np.sort(lf[first]), np.sort(lf[last]) + 1
        fresh = ~border[new_hi]
        border[new_hi[fresh]] = True
        lo, hi = new_lo[fresh], new_hi[fresh]
    border[0] = True
    return border[:n]


def repeated_windows(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each piece, the windows that start earlier too; pieces in the order of the corpus."""
    text = np.frombuffer(b"".join(x for p in pieces for x in (p, b"\xff")), np.uint8)
    ends = np.cumsum([len(p) + 1 for p in pieces])
    starts = np.concatenate(([0], ends[:-1]))
    order = suffix_order(text)
    group = np.cumsum(expand_intervals(text[order - 1], length))
    whole = np.zeros(len(text), bool)
    for s, e in zip(starts, ends):
        whole[s : max(s, e - length)] = True
    own = whole[order]
    place, group = order[own], group[own]
    if not len(place):
        return [np.zeros(0, np.int64) for _ in pieces]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.minimum.reduceat(place, first)
    again = np.sort(place[place != np.repeat(least, np.diff(np.append(first, len(group))))])
    cuts = np.searchsorted(again, np.concatenate((starts, ends[-1:])))
    return [again[a:b] - s for a, b, s in zip(cuts[:-1], cuts[1:], starts)]


def _decide(length: int):
    names = ["doc_id", "text_id", "start", "stop"]
    place = slice(3, 6)  # doc_id, text_id, start: the order of the corpus

    def decide(rows: list[tuple], out: list) -> None:
        """Rows as PIECE of whole keys, segments only."""
        rows.sort(key=lambda r: (r[1], *r[place]))
        active, k = [], 0
        while k < len(rows):
            distinct: dict[bytes, tuple] = {}
            j = k
            while j < len(rows) and rows[j][1] == rows[k][1]:
                r = rows[j]
                if r[8] not in distinct:
                    distinct[r[8]] = r
                elif distinct[r[8]][place] != r[place]:
                    out.append((*r[place], r[6] + length - 1))
                j += 1
            if len(distinct) > 1 or rows[k][7]:
                active += distinct.values()
            k = j
        if not active:
            return
        active.sort(key=lambda r: r[place])
        for r, again in zip(active, repeated_windows([r[8] for r in active], length)):
            out += [(r[3], r[4], r[5] + a, r[5] + b + length) for a, b in _runs(again)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, window, out = [], 0, None, None, []

        def emitted():
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names)
            out.clear()
            return batch

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[0] == REPEAT:
                    out.append((*r[place], r[6] + length - 1))
                elif r[0] == WINDOW:  # in the order of the corpus within its digest
                    if window is None or window[1:3] != r[1:3]:
                        window = r
                    elif window[place] != r[place]:
                        out.append((*r[place], r[6] + length - 1))
                else:
                    if size >= SHARD and r[1] != last:
                        decide(held, out)
                        held, size = [], 0
                    held.append(r)
                    size += len(r[8])
                    last = r[1]
            if len(out) >= 50_000:
                yield emitted()
        decide(held, out)
        if out:
            yield emitted()

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text_id, text, doc_id, starts, stops) as (doc_id, text_id, removed runs, kept bytes)."""
    for batch in batches:
        spans, kept = [], []
        for text, starts, stops in zip(utf8(batch.column(1)), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            runs: list[list[int]] = []
            for s, e in sorted(zip(starts, stops)):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            rest, at = [], 0
            for s, e in runs:
                rest.append(text[at:s])
                at = e
            spans.append([{"start": s, "end": e} for s, e in runs])
            kept.append(b"".join([*rest, text[at:]]))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [batch.column(2), batch.column(0), pa.array(spans, kind), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_id", "spans", "kept"])


def _rest(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The slim table, and doc_id, text_id, spans (removed runs in bytes) and kept bytes of the documents that lose something."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # A hash of id and text names a row while keys are sought: two rows that share it only send keys in vain.
    slim = slim.select(F.xxhash64("doc_id", "text").alias("text_id"), "text", "doc_id")
    keys = slim.where("doc_id IS NOT NULL").select("text_id", "text").mapInArrow(_keys(length), "key long, text_id long, known boolean")
    part = F.when(F.col("known"), F.xxhash64("text_id", "key")).otherwise(F.col("key"))
    dealt = keys.repartition(part).sortWithinPartitions("key", "known")
    found = materialize(dealt.mapInArrow(_repeated, "text_id long, key long"), "suffix-keys")
    hot = found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key", F.lit(True).alias("hot"))
    found = found.join(hot, "key", "left")
    lists = [F.collect_set(F.when(c, F.col("key"))).alias(n) for n, c in (("keys", F.col("hot").isNull()), ("hot", F.col("hot").isNotNull()))]
    some = slim.join(found.groupBy("text_id").agg(*lists), "text_id").where("doc_id IS NOT NULL")
    some = materialize(some.select("text_id", "text", "doc_id", "keys", "hot"), "suffix-documents")
    pieces = some.mapInArrow(_pieces(length), PIECE)
    part = F.when(F.col("kind") == REPEAT, F.xxhash64("text_id", "start")).otherwise(F.xxhash64("key", "sub"))
    dealt = pieces.repartition(part).sortWithinPartitions("key", "sub", "doc_id", "text_id", "start")
    gone = dealt.mapInArrow(_decide(length), "doc_id long, text_id long, start long, stop long").groupBy("doc_id", "text_id")
    gone = materialize(gone.agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")), "suffix-runs")
    # A document given twice is cut once.
    rows = some.select("text_id", "text", "doc_id").join(gone, ["doc_id", "text_id"]).dropDuplicates(["doc_id", "text_id"])
    rows = rows.select("text_id", "text", "doc_id", "starts", "stops")
    return slim, rows.mapInArrow(_cut, "doc_id long, text_id long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, spans (removed runs in bytes), kept (bytes that stay; characters may be cut)."""
    slim, cut = _rest(docs, length, id_col, text_col)
    whole = slim.select("doc_id", "text_id", F.coalesce(F.encode("text", "utf-8"), F.lit(b"")).alias("whole"))
    out = whole.join(cut, ["doc_id", "text_id"], "left")
    return out.select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"), F.coalesce("kept", "whole").alias("kept"))


def repeat_digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; only documents that lose something move their text."""
    slim, cut = _rest(docs, length, id_col, text_col)
    digest = F.sha2("kept", 256).alias("cut_sha")
    cut = cut.select("doc_id", "text_id", F.size("spans").cast("long").alias("n"), F.length("kept").cast("long").alias("rest"), digest)
    cut = materialize(cut, "suffix-cut")
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    base = slim.select("doc_id", "text_id", bytes_, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    return base.join(cut, ["doc_id", "text_id"], "left").select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.coalesce("rest", "n_bytes")).alias("n_removed"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("cut_sha", "sha").alias("kept_sha256"),
    )
