"""Secret scan: assignments, access keys, hex keys, and runs of high entropy.

Three patterns give the base spans. Beside them, candidate strings (maximal
runs of 20 or more characters of base64 and its url-safe form) go through a
sliding window for their narrowest character class. Base spans are cut out of
them first, and so is what an allow list says only looks random: UUIDs, placeholders
(words such as ``example``). What is left goes through whole if it mixes digits and
letters of both cases, or else in its parts between separators, whatever their
case. The Shannon entropy of the
window is kept by incremental counts: a step adds one character and removes
one, and changes the sum of c*log2(c) by four looked-up terms. The windows at
or above the class's threshold, joined, are the candidate's span, kind
``entropy``. The allow list further passes over what is named a checksum (its first
``CHECKSUM`` characters), data URIs, and the path of a url (not its query).

All patterns are ASCII, so they run on UTF-8 bytes; offsets are returned in
code points. Null counts as empty; a very long text is scanned in linear time.
Each row is taken by itself: repeated rows and ids give repeated results, an
empty table gives an empty one, and other columns are ignored (``redact_secrets``
keeps them).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import code_points, ship, utf8

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
WORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(rb"[0-9A-Za-z]{20,}")
KINDS = ("assign", "access", "hex", "entropy")

#: Class: its characters, window, least entropy in bits a character.
CLASSES = (
    ("hex", re.compile(rb"[0-9a-fA-F]+"), 24, 3.0),
    ("alnum", re.compile(rb"[0-9A-Za-z]+"), 20, 3.6),
    ("base64", re.compile(rb"[0-9A-Za-z+/_=-]+"), 20, 3.6),
)
LOG = [0.0] + [c * math.log2(c) for c in range(1, 65)]
#: Characters of the longest checksum in use: 512 bits in hexadecimal.
CHECKSUM = 128
UUID = re.compile(rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
NAMED = re.compile(rb"(?:sha-?\d*|md5|checksum|digest|commit|integrity|etag|rev)[\"']?[\s:=@(-]*$", re.I)
DATA = re.compile(rb"base64,$")
URL_EDGES = [bytes([c]) for c in b" \t\n\r\v\f\"'<>"]
PLACEHOLDER = re.compile(rb"example|sample|placeholder|dummy|changeme|your[_-]|xxxx|0123456789|abcdefgh", re.I)

SPAN = "array<struct<kind:string,start:long,end:long,base:boolean>>"
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def high_entropy(run: bytes) -> tuple[int, int] | None:
    """First start and last end of the windows at or above the threshold of the run's class."""
    if not run:
        return None
    window, least = next((w, t) for _, chars, w, t in CLASSES if chars.fullmatch(run))
    if len(run) < window:
        return None
    counts = [0] * 128
    total = 0.0
    bar = window * (math.log2(window) - least)  # entropy >= least: sum of c*log2(c) <= bar
    first = last = None
    for k, c in enumerate(run):
        n = counts[c]
        counts[c] = n + 1
        total += LOG[n + 1] - LOG[n]
        if k >= window:
            c = run[k - window]
            n = counts[c]
            counts[c] = n - 1
            total += LOG[n - 1] - LOG[n]
        if k >= window - 1 and total <= bar + 1e-9:
            last = k + 1
            if first is None:
                first = k + 1 - window
    return None if first is None else (first, last)


def looks_random(run: bytes) -> bool:
    """Letters and digits mixed as in keys: words, paths and numbers alone aren't."""
    digits = sum(48 <= c <= 57 for c in run)
    upper = sum(65 <= c <= 90 for c in run)
    lower = sum(97 <= c <= 122 for c in run)
    if CLASSES[0][1].fullmatch(run):
        return digits >= 4 and upper + lower >= 4 and not (upper and lower)
    return digits >= 2 and upper >= 2 and lower >= 2


def outside(runs: list[tuple[int, int]], covered: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The pieces of runs that no span covers. Runs lie apart; both are in the order of their starts, and are walked once, side by side."""
    k, reach = 0, 0
    for start, end in runs:
        at = max(start, reach)
        while k < len(covered) and covered[k][0] < end:
            s, e = covered[k]
            if s > at:
                yield at, s
            at = max(at, e)
            reach = max(reach, e)
            k += 1
        if at < end:
            yield at, end


def tokens(text: bytes, start: int, end: int) -> list[tuple[int, int]]:
    """What goes to the entropy window: a piece of mixed characters whole, of another its letters and
    digits between separators, of any case. Only numbers and hex-like words among these do not."""
    if looks_random(text[start:end]):
        return [(start, end)]
    parts = [m.span() for m in PART.finditer(text, start, end)]
    return [(s, e) for s, e in parts if not CLASSES[0][1].fullmatch(text, s, e) or looks_random(text[s:e])]


class UrlPaths:
    """Whether places of a text, asked for in ascending order, lie in the path of a url: each byte is looked at once."""

    def __init__(self, text: bytes):
        self.text, self.at, self.scheme, self.edge, self.query = text, 0, -1, -1, -1

    def holds(self, place: int) -> bool:
        look = lambda mark, back=0: self.text.rfind(mark, max(0, self.at - back), place)
        self.scheme = max(self.scheme, look(b"://", 2))
        self.edge = max(self.edge, *map(look, URL_EDGES))
        self.query = max(self.query, look(b"?"))
        self.at = place
        return self.scheme > self.edge and self.query < self.scheme


def suspect(text: bytes, start: int, end: int, urls: UrlPaths) -> int | None:
    """Where a piece starts that the place it stands at doesn't explain."""
    before = text[max(0, start - 24) : start]
    if urls.holds(start) or DATA.search(before[-8:]):
        return None
    return min(end, start + CHECKSUM) if NAMED.search(before) else start


def harmless(text: bytes, start: int, end: int) -> list[tuple[int, int]]:
    """UUIDs and placeholders in a piece."""
    return sorted(m.span() for pattern in (UUID, PLACEHOLDER) for m in pattern.finditer(text, start, end))


def scan(text: bytes) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by start, then kind; byte offsets."""
    found = []
    if b":" in text or b"=" in text:
        low = text.lower()
        if any(w in low for w in WORDS):
            found += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    for a, b in runs:
        found += [(2, *m.span()) for m in HEX.finditer(text, a, b)]  # a run of hex lies in one candidate
    found.sort(key=lambda s: (s[1], s[0]))
    base, urls = [(s[1], s[2]) for s in found], UrlPaths(text)
    for a, b in outside(runs, base):
        if b - a < CLASSES[1][2]:
            continue
        for piece in outside([(a, b)], harmless(text, a, b)):
            for s, e in tokens(text, *piece):
                if high_entropy(text[s:e]) and (s := suspect(text, s, e, urls)) is not None and (at := high_entropy(text[s:e])):
                    found.append((3, s + at[0], s + at[1]))
    found.sort(key=lambda s: (s[1], s[0]))
    return [(KINDS[k], s, e, k < 3) for k, s, e in found]


def scan_text(text: bytes) -> list[dict]:
    spans = scan(text)
    if not spans:
        return []
    offsets = sorted({o for s in spans for o in s[1:3]})
    at = dict(zip(offsets, code_points(text, offsets)))
    return [{"kind": k, "start": at[s], "end": at[e], "base": b} for k, s, e, b in spans]


def redact(text: str, spans: list[dict], mark: str) -> str:
    """The text with each maximal run of covered characters replaced by ``mark``."""
    out, at = [], 0
    for s in spans:
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = s["end"]
    return "".join([*out, text[at:]])


def secret_spans(text):
    """Column of spans for a column of text."""

    @F.arrow_udf(SPAN)
    def spans(column: pa.Array) -> pa.Array:
        return pa.array([scan_text(b) for b in utf8(column)], ARROW_SPAN)

    return spans(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of (kind, start, end, base), by start, then kind."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), secret_spans(F.col(text_col).cast("string")).alias("spans"))


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns; spans are replaced in the text, its length column follows. Null stays null."""
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        whole = utf8(column)
        return pa.array(
            [None if not v else redact(b.decode("utf-8", "replace"), s, mark) if (s := scan_text(b)) else b.decode("utf-8", "replace") for b, v in zip(whole, column.is_valid().to_pylist())],
            pa.string(),
        )

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col in out.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast("long")))
    return out
