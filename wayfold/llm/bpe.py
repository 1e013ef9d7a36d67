"""Byte-level BPE as a streaming transducer with bounded lookahead.

*Lookahead.* Let a prefix of a pre-token be tokenised, and let more bytes come.
A border of the tokenisation can move only if some rule joins the token left of
it to what has changed on its right; that rule must come later in the merge
list than the one that caused the change there, and its right part must start
with the token that the earlier rule had on its left. So the farthest that a
change can reach back is the heaviest chain of rules of rising rank linked in
that way, each weighing the bytes of its left part. ``MergeList.lookahead``
computes that weight once, in one pass over the rules from last to first.
Tokens that end at least so many bytes before the end of what has been read are
stable: they are emitted, and the encoder keeps only what follows them.

*Memory.* The encoder holds one chunk, the unstable rest of at most one
pre-token, and caches of bounded bytes; none of it grows with the text. The
round trip takes a text chunk by chunk through encoder, decoder and both
digests; only ``encode``, whose result is the array of ids, holds all of them.

*Decoding* feeds the bytes of each token to an incremental UTF-8 state machine;
bytes that no continuation can make valid become U+FFFD.

Ids equal those of the tokenizers library for the same file, strings of special
tokens in a text included. Null counts as empty and gives no tokens. Each row is
taken by itself, so repeated rows and ids give repeated results; a null id stays
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import ship

# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRETOKEN = regex.compile(PATTERN)
#: What continues a pre-token that has outgrown the window.
RUNS = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "O": regex.compile(r"[^\s\p{L}\p{N}]*"), "S": regex.compile(r"\s*")}
SPACES = re.compile(r"\s \s")
CHUNK = 1 << 16
WINDOW = 4096
#: Bytes of keys and values in each cache (entries count OVERHEAD besides; a full cache starts anew), and characters of a key.
HELD, OVERHEAD, KEY = 96 << 20, 160, 256


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the files: itself where it is printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeList:
    """Vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table = byte_characters()
        to_bytes = lambda token: bytes(table[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.token = {i: to_bytes(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [0] * 256
        for i, t in self.token.items():
            if len(t) == 1:
                self.byte_id[t[0]] = i
        self.rules = []
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rules.append((vocab[a], vocab[b], vocab[a + b]))
        #: (left id, right id) -> rank, and rank -> id of both
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(self.rules)}
        self.made = [c for _, _, c in self.rules]

    @property
    def lookahead(self) -> int:
        """Bytes after which what is read can no longer change a token."""
        if not hasattr(self, "_lookahead"):
            left_of = {c: a for a, _, c in self.rules}
            reach: dict[int, int] = {}  # token -> heaviest chain among the later rules whose right part starts with it
            for a, b, _ in reversed(self.rules):
                weight = len(self.token[a]) + reach.get(a, 0)
                while b is not None:
                    if reach.get(b, 0) < weight:
                        reach[b] = weight
                    b = left_of.get(b)
            self._lookahead = max(reach.values(), default=0)
        return self._lookahead

    def merge(self, data: bytes) -> list[int]:
        """Ids of one whole piece: the earliest rule first, and of its places the leftmost."""
        ids = [self.byte_id[b] for b in data]
        if len(ids) > 64:
            return self._merge_long(ids)
        get, none = self.rank.get, len(self.made)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [self.made[best]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), none)
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by rounds over a heap, for pieces that are long."""
        import heapq

        get, made, n = self.rank.get, self.made, len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j, c = nxt[k], made[r]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = c, -1
            nxt[k] = j = nxt[j]
            if j < n:
                prv[j] = k
                if (r := get((c, ids[j]))) is not None:
                    heapq.heappush(heap, (r, k, c, ids[j]))
            if (p := prv[k]) >= 0 and (r := get((ids[p], c))) is not None:
                heapq.heappush(heap, (r, p, ids[p], c))
        return [i for i in ids if i >= 0]


class _Cache(dict):
    def __init__(self, fill: Callable):
        super().__init__()
        self.fill, self.size = fill, 0

    def __missing__(self, key: str) -> bytes:
        value = self.fill(key)
        if len(key) <= KEY:
            self.size += len(key) + len(value) + OVERHEAD
            if self.size > HELD:
                self.clear()
                self.size = len(key) + len(value) + OVERHEAD
            self[key] = value
        return value


class Codec:
    """Caches over a merge list; one for each worker."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.words = _Cache(self._word)
        self.units = _Cache(self._unit)

    def _word(self, word: str) -> bytes:
        return np.array(self.merges.merge(word.encode("utf-8", "replace")), "<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        """A space and what follows up to the next space."""
        return b"".join(map(self.words.__getitem__, PRETOKEN.findall(" " + unit)))

    def plain(self, text: str) -> bytes:
        """Text that starts and ends at borders of pre-tokens."""
        if SPACES.search(text):
            return b"".join(map(self.words.__getitem__, PRETOKEN.findall(text)))
        # No white space touches a space from both sides, so each space starts a pre-token or stands alone.
        first, *units = text.split(" ")
        return b"".join([*map(self.words.__getitem__, PRETOKEN.findall(first)), *map(self.units.__getitem__, units)])


class LibraryCodec(Codec):
    """The same caches, filled by a compiled encoder over the same merges."""

    def __init__(self, merges: MergeList):
        import tiktoken

        super().__init__(merges)
        if any(c != 256 + r for r, c in enumerate(merges.made)):
            raise ValueError("ids must follow the order of the merges")
        ranks = {t: i for i, t in merges.token.items() if i not in merges.special.values()}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _word(self, word: str) -> bytes:
        return np.array(self.encode(word), "<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        return self._word(" " + unit)


class StreamEncoder:
    """Text in by ``feed``, little-endian 32-bit ids out as soon as they are stable; ``finish`` gives the rest."""

    def __init__(self, codec: Codec):
        self.codec, self.merges = codec, codec.merges
        self.window = max(WINDOW, 4 * self.merges.lookahead)
        self.text = ""  # not yet cut into pre-tokens
        self.kind = ""  # of the pre-token that has outgrown the window
        self.rest = b""  # its bytes after the last stable token
        self.hold = ""  # may be the start of a special token

    def feed(self, text: str) -> bytes:
        specials = self.merges.special
        if not specials:
            return self._feed(text)
        text, out = self.hold + text, []
        while True:
            at = min(((k, s) for s in specials if (k := text.find(s)) >= 0), default=None)
            if at is None:
                break
            out += [self._feed(text[: at[0]]), self._end(), specials[at[1]].to_bytes(4, "little")]
            text = text[at[0] + len(at[1]) :]
        keep = max((n for s in specials for n in range(1, len(s)) if text.endswith(s[:n])), default=0)
        self.hold = text[len(text) - keep :]
        return b"".join([*out, self._feed(text[: len(text) - keep])])

    def finish(self) -> bytes:
        hold, self.hold = self.hold, ""
        return self._feed(hold) + self._end()

    def _grow(self, data: bytes) -> bytes:
        """More bytes of the long pre-token; its stable tokens."""
        self.rest += data
        if len(self.rest) < self.window:
            return b""
        ids = self.merges.merge(self.rest)
        stable, end, most = 0, 0, len(self.rest) - self.merges.lookahead
        for i in ids:
            if end + len(self.merges.token[i]) > most:
                break
            end += len(self.merges.token[i])
            stable += 1
        self.rest = self.rest[end:]
        return np.array(ids[:stable], "<u4").tobytes()

    def _close(self) -> bytes:
        ids = self.merges.merge(self.rest)
        self.kind, self.rest = "", b""
        return np.array(ids, "<u4").tobytes()

    def _feed(self, text: str) -> bytes:
        out = []
        for k in range(0, len(text), CHUNK):
            out.append(self._chunk(text[k : k + CHUNK]))
        return b"".join(out)

    def _chunk(self, new: str) -> bytes:
        out = []
        text = self.text + new
        while self.kind:
            n = RUNS[self.kind].match(text).end()
            if self.kind == "S" and n:
                n -= 1  # the last one may belong to what follows
            if not n and len(text) > (self.kind == "S"):
                out.append(self._close())
                break
            out.append(self._grow(text[:n].encode("utf-8", "replace")))
            text = text[n:]
            if len(text) <= (self.kind == "S"):
                self.text = text
                return b"".join(out)
        cut = text.rfind(" ")
        while cut > 0 and text[cut - 1].isspace():
            cut = text.rfind(" ", 0, cut)
        if cut > 0:
            out.append(self.codec.plain(text[:cut]))
            text = text[cut:]
        if len(text) > self.window:
            end = 0
            for m in PRETOKEN.finditer(text):
                if m.end() > len(text) - 3:
                    break
                out.append(self.codec.words[m[0]] if m.end() - m.start() < 256 else np.array(self.merges.merge(m[0].encode("utf-8", "replace")), "<u4").tobytes())
                end = m.end()
            text = text[end:]
            if len(text) > self.window:
                body = text[1:] if text[0] == " " else text
                self.kind = next(k for k in ("L", "N", "O", "S") if RUNS[k].match(body).end())
                if self.kind == "S":
                    body = text
                lead = len(text) - len(body)
                n = lead + RUNS[self.kind].match(body).end() - (self.kind == "S")
                out.append(self._grow(text[:n].encode("utf-8", "replace")))
                text = text[n:]
        self.text = text
        return b"".join(out)

    def _end(self) -> bytes:
        """The text ends here, or a special token starts."""
        out = []
        if self.kind:
            n = RUNS[self.kind].match(self.text).end()
            if self.kind != "S" or n == len(self.text):
                out.append(self._grow(self.text[:n].encode("utf-8", "replace")))
                self.text = self.text[n:]
            out.append(self._close())
        out.append(self.codec.plain(self.text))
        self.text = ""
        return b"".join(out)


class StreamDecoder:
    """Ids in, text out: a UTF-8 state machine that holds at most an unfinished character."""

    def __init__(self, merges: MergeList):
        self.token = merges.token.__getitem__
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.token, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(MergeList(path))


@lru_cache(maxsize=2)
def library_codec(path: str) -> Codec:
    return LibraryCodec(MergeList(path))


def encode_parts(text: str, own: Codec) -> Iterator[bytes]:
    """Little-endian 32-bit ids of a text, chunk by chunk."""
    encoder = StreamEncoder(own)
    for k in range(0, len(text), CHUNK):
        yield encoder.feed(text[k : k + CHUNK])
    yield encoder.finish()


def encode_text(text: str, own: Codec) -> bytes:
    """The ids of a whole text."""
    return b"".join(encode_parts(text, own))


def decode_parts(ids: np.ndarray, merges: MergeList, step: int = 8192) -> Iterator[str]:
    decoder = StreamDecoder(merges)
    for k in range(0, len(ids), step):
        yield decoder.feed(ids[k : k + step].tolist())
    yield decoder.finish()


def _by_batch(docs: DataFrame, id_col: str, text_col: str, row: Callable, names: list[str], kinds: list, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", *names])

    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, an array of the tokens of the whole text."""
    row = lambda text: (np.frombuffer(encode_text(text or "", codec(path)), "<u4"),)
    return _by_batch(docs, id_col, text_col, row, ["ids"], [pa.list_(pa.int32())], "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text, from an array of ids; null counts as empty."""
    row = lambda ids: ("".join(decode_parts(np.array(ids or [], "<u4"), codec(path).merges)),)
    return _by_batch(tokens, id_col, ids_col, row, ["text"], [pa.string()], "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded as streams, only digests leave the task."""

    def row(text: str | None) -> tuple:
        own = codec(path)
        decoder, n, ids_digest, text_digest = StreamDecoder(own.merges), 0, hashlib.sha256(), hashlib.sha256()
        for part in encode_parts(text or "", own):
            n += len(part) // 4
            ids_digest.update(part)
            text_digest.update(decoder.feed(np.frombuffer(part, "<u4").tolist()).encode("utf-8"))
        text_digest.update(decoder.finish().encode("utf-8"))
        return n, ids_digest.hexdigest(), text_digest.hexdigest()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _by_batch(docs, id_col, text_col, row, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], schema)
