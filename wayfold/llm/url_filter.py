"""URL filter over a sorted digest array.

A list of entries (host and path, such as ``example.org/es/``) is kept as one
file: the 64-bit xxhash keys of the entries in ascending order, then each
entry's place, code and full text. Spark sends the file to each executor once;
all workers of a machine memory-map it, so a list costs its size once for each
machine, not once for each worker. Urls are probed a batch at a time: all
candidate keys of the batch go through one vectorised binary search, and a hit
counts only if the stored text equals the candidate.

Candidates of a url are each suffix of its host at a label border, of no more
labels or characters than the longest listed host, joined with each prefix of its
path whose length occurs in the list. So a url has as many candidates as the list
allows, however long it is. The longest entry that
fits wins (host and path together; then the longer host; then block).
Rules come before the block list; what neither holds is allowed.

A null url, and one without ``://``, has an empty host and path, no rule and
the verdict allow. Rows that repeat are judged as often as they occur; other
columns are ignored, also such as are called host, path or rule; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import re
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import ship

ALLOW, BLOCK, LISTED = 0, 1, 2
URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
OUT = "page_id long, host string, path string, rule string, verdict string, listed boolean"


def write_digest_array(entries: Iterable[tuple[str, str, int]], target: str) -> None:
    """Entries (host, path, code) as a file; of equal entries the highest code stays."""
    best: dict[tuple[str, str], int] = {}
    for host, path, code in entries:
        best[host, path] = max(code, best.get((host, path), -1))
    rows = sorted((xxhash.xxh64_intdigest(f"{h}\0{p}".encode()), f"{h}\0{p}".encode(), c) for (h, p), c in best.items())
    blob = b"".join(r[1] for r in rows)
    ends = np.cumsum([len(r[1]) for r in rows], dtype="<u8") if rows else np.zeros(0, "<u8")
    lengths = sorted({len(p) for _, p in best})
    labels, longest = max((h.count(".") for h, _ in best), default=-1) + 1, max((len(h) for h, _ in best), default=0)
    head = np.array([len(rows), len(lengths), len(blob), labels, longest], "<u8")
    with open(target, "wb") as f:
        for part in (head, np.array([r[0] for r in rows], "<u8"), ends, np.array([r[2] for r in rows], "<u8"), np.array(lengths, "<u8")):
            f.write(part.tobytes())
        f.write(blob)


class DigestArray:
    """A memory-mapped file of ``write_digest_array``."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        #: No listed host has more labels, or more characters.
        n, n_lengths, _, self.most_labels, self.longest = (int(x) for x in np.frombuffer(data, "<u8", 5))
        at = 40
        self.keys = np.frombuffer(data, "<u8", n, at)
        self.ends = np.frombuffer(data, "<u8", n, at + 8 * n)
        self.codes = np.frombuffer(data, "<u8", n, at + 16 * n)
        self.lengths = [int(x) for x in np.frombuffer(data, "<u8", n_lengths, at + 24 * n)]
        self.blob, self.base = data, at + 24 * n + 8 * n_lengths

    def text(self, i: int) -> bytes:
        start = int(self.ends[i - 1]) if i else 0
        return self.blob[self.base + start : self.base + int(self.ends[i])]

    def find(self, probes: list[bytes]) -> list[int]:
        """The place of each probe, or -1."""
        if not probes or not len(self.keys):
            return [-1] * len(probes)
        wanted = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), "<u8", len(probes))
        places = np.searchsorted(self.keys, wanted)
        hit = places < len(self.keys)
        hit[hit] = self.keys[places[hit]] == wanted[hit]
        found = np.full(len(probes), -1, np.int64)
        for k in np.nonzero(hit)[0]:
            i = int(places[k])
            while i < len(self.keys) and self.keys[i] == wanted[k]:  # entries whose keys collide
                if self.text(i) == probes[k]:
                    found[k] = i
                    break
                i += 1
        return found.tolist()


@lru_cache(maxsize=4)
def _opened(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case (A-Z only) and path."""
    m = URL.search(url) if url else None
    return (m[1].translate(UPPER), m[2]) if m else ("", "")


def candidates(host: str, path: str, array: DigestArray) -> list[tuple[str, str]]:
    """The suffixes of a host that a listed host can be as long as, with the prefixes of the path."""
    suffixes, at = [], len(host)
    while len(suffixes) < array.most_labels and at > 0 and len(host) - at <= array.longest:
        at = host.rfind(".", 0, at)
        suffixes.append(host[at + 1 :])
    return [(s, path[:n]) for s in reversed(suffixes) if s and len(s) <= array.longest for n in array.lengths if n <= len(path)]


def judge(urls: list[str | None], array: DigestArray) -> list[tuple]:
    split = [split_url(u) for u in urls]
    each = [candidates(h, p, array) for h, p in split]
    found = iter(array.find([f"{s}\0{p}".encode("utf-8", "surrogatepass") for c in each for s, p in c]))
    out = []
    for (host, path), own in zip(split, each):
        rule, listed = None, False
        for s, p in own:
            i = next(found)
            if i < 0:
                continue
            code = int(array.codes[i])
            if code == LISTED:
                listed = True
            elif rule is None or (len(s) + len(p), len(s), code) > rule[0]:
                rule = ((len(s) + len(p), len(s), code), s + p)
        block = rule[0][2] == BLOCK if rule else listed
        out.append((host, path, rule[1] if rule else None, "block" if block else "allow", listed))
    return out


def judge_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]], blocked: Iterable[tuple[str, str]] = (), id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, listed.

    ``rules`` holds (verdict, host, path); ``blocked`` holds (host, path). A
    path of "/" fits every url of a host that has a path; one of "" fits all. An
    entry may be both: the rule decides.
    """
    spark = pages.sparkSession
    ship(spark)
    entries = [(h, p, BLOCK if v == "block" else ALLOW) for v, h, p in rules]
    ruled = {(h, p) for h, p, _ in entries}
    entries += [(h, p, LISTED) for h, p in blocked if (h, p) not in ruled]
    name = f"urls-{hashlib.sha256(repr(sorted(entries)).encode()).hexdigest()[:24]}.bin"
    known = spark.sparkContext.__dict__.setdefault("_wayfold_files", set())
    if name not in known:
        target = os.path.join(tempfile.mkdtemp(prefix="wayfold-urls-"), name)
        write_digest_array(entries, target)
        spark.sparkContext.addFile(target)
        known.add(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _opened(name)
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
        names = ["page_id", "host", "path", "rule", "verdict", "listed"]
        for batch in batches:
            rows = judge(batch.column(1).to_pylist(), array)
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, OUT)
