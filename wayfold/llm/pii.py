"""Personal data: base patterns, and candidates that boosted trees select.

Four patterns give the base spans: email, ip, card, phone. Beside them,
generators of high recall propose spans that may overlap each other and the
base: written-out email addresses, social security numbers, bank accounts,
national telephone numbers. Gradient-boosted trees score each from its format
and its context; probabilities are calibrated on rows apart from the training
rows, and each kind's threshold is the least at which those rows reach
``PRECISION``. Of selected spans that overlap, the likelier stays; base spans
always stay and win.

The trees are trained when the operator is called, on rows made from templates
with a fixed seed, about 6000 of them: no corpus row is used.

Patterns are ASCII and run on UTF-8 bytes in linear time; offsets are code
points. Null counts as empty. Each row is taken by itself: repeated rows and ids
give repeated results, an empty table gives an empty one, other columns are
ignored. A very long text is scanned in linear time.
"""

from __future__ import annotations

import bisect
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.boosting import BoostedTrees
from wayfold.llm.common import code_points, ship, utf8
from wayfold.llm.secrets import ARROW_SPAN, SPAN

LOCAL_PART = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# An address starts where a run of digits starts and no part gives digits back: what is possessive here fits the same spans.
IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(rb"[0-9]")
NOT_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)

#: Kinds that the trees select, and what proposes them.
PROPOSE = {
    "written_email": re.compile(rb"[ ]?(?:\[at\]|\(at\))[ ]?| at ", re.I),  # from it backwards and forwards
    "ssn": re.compile(rb"(?<![0-9])[0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4}(?![0-9])"),
    "iban": re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "national_phone": re.compile(rb"(?<![0-9])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-]?[0-9]{2,4}[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){0,2}(?![0-9])"),
}
#: What follows the mark of a written email: names apart by dots, written or not.
WRITTEN_DOMAIN = re.compile(rb"[A-Za-z0-9-]{1,63}(?:[ ]?(?:\[dot\]|\(dot\)| dot |\.)[ ]?[A-Za-z0-9-]{2,63}){1,4}", re.I)
WRITTEN_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-")
TOP = re.compile(rb"(?:\.|dot[ \])]{1,2})(?:com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|eu)$", re.I)
BASE = ("email", "ip", "card", "phone")
KINDS = BASE + tuple(PROPOSE)
PRECISION = 0.97
#: Candidates whose features are held at once.
CANDIDATES = 16384
FOR = re.compile(rb"phone|tel|call|mobile|cell|fax|contact|dial|e-?mail|mail|write to|ssn|social|iban|account|bank|transfer", re.I)
AGAINST = re.compile(rb"isbn|issn|order|invoice|version|page|serial|part|model|item|figure|row|id|no\.|ref|total|price|score|year|rfc|doi", re.I)


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = c - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(text: bytes) -> bool:
    s = text.replace(b" ", b"")
    s = s[4:] + s[:4]
    return int("".join(str(int(chr(c), 36)) for c in s)) % 97 == 1


def emails(text: bytes) -> list[tuple[int, int]]:
    """Leftmost spans of local part, @ and domain; the local part starts at the run before each @."""
    out, free, at = [], 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_PART:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find(b"@", max(at + 1, free))
    return out


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) by start, then kind."""
    found = [(0, s, e) for s, e in emails(text)] if b"@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip(b"0") for p in m[0].split(b".")]
            if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
                found.append((1, *m.span()))
        for m in CARD.finditer(text):
            d = m[0].translate(None, NOT_DIGITS)
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((2, *m.span()))
        if b"+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(m[0].translate(None, NOT_DIGITS)) <= 15:
                    found.append((3, *m.span()))
    return sorted(found, key=lambda s: (s[1], s[0]))


def written_emails(text: bytes) -> list[tuple[int, int]]:
    """Spans of a name, a written @ and names apart by dots, leftmost first and apart from each other."""
    out, free = [], 0
    for m in PROPOSE["written_email"].finditer(text):
        start = m.start()
        while start > max(free, m.start() - 64) and text[start - 1] in WRITTEN_LOCAL:
            start -= 1
        rest = WRITTEN_DOMAIN.match(text, m.end()) if start < m.start() else None
        if rest:
            out.append((start, rest.end()))
            free = rest.end()
    return out


def proposals(text: bytes) -> list[tuple[int, int, int]]:
    out = [(4, s, e) for s, e in written_emails(text)]
    if DIGIT.search(text):
        for k, name in enumerate(("ssn", "iban", "national_phone")):
            out += [(5 + k, *m.span()) for m in PROPOSE[name].finditer(text)]
    return out


def features(text: bytes, kind: int, start: int, end: int) -> list[float]:
    """Format of the span and what stands around it."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    digits = span.translate(None, NOT_DIGITS)
    parts = re.findall(rb"[0-9]+", span)
    seps = set(re.findall(rb"[ .()/-]", span))
    word = bool(re.search(rb"\[at\]|\(at\)", span, re.I)) + bool(re.search(rb"\[dot\]|\(dot\)| dot ", span, re.I))
    good = [m.end() for m in FOR.finditer(before)]
    bad = [m.end() for m in AGAINST.finditer(before)]
    nums = [int(p) for p in parts[:4]] + [0] * 4
    return [
        kind == 4, kind == 5, kind == 6, kind == 7,
        len(span), len(digits), len(parts), len(seps), word,
        kind == 4 and bool(TOP.search(span)), kind == 4 and b". " in span,
        span.startswith(b"("), len(seps - {b"(", b")"}) == 1,
        len(set(digits)), kind == 6 and mod97(span),
        nums[0], nums[1], len(parts[-1]) if parts else 0,
        kind == 5 and nums[0] not in (0, 666) and nums[0] < 900 and nums[1] > 0 and len(parts) == 3,
        (40 - len(before) + good[-1]) if good else 0, (40 - len(before) + bad[-1]) if bad else 0,
        bool(re.match(rb"[A-Za-z0-9_%$]|[.,-][0-9]", after)), bool(re.search(rb"[A-Za-z0-9_$#/.,-]$", before)),
    ]


def _iban(r: random.Random) -> str:
    country, body = r.choice(["DE", "FR", "GB", "ES", "NL"]), "".join(r.choice("0123456789") for _ in range(18))
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    s = f"{country}{98 - number % 97:02d}{body}"
    return s if r.random() < 0.5 else " ".join(s[k : k + 4] for k in range(0, len(s), 4))


def training_rows(n: int, seed: int) -> list[tuple[str, int]]:
    """Texts with one value each, and whether it is personal."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 9)))
    phone = lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"])
    ssn = lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
    at, dot = lambda: r.choice(["[at]", " [at] ", "(at)", " (at) "]), lambda: r.choice(["[dot]", " [dot] ", "(dot)", ".", " dot "])
    good = [
        lambda: f"{r.choice(['call', 'phone:', 'tel.', 'mobile', 'contact us at', 'fax'])} {phone()}",
        lambda: f"{r.choice(['', 'reach me,'])} ({d(3)}) {d(3)}-{d(4)}",
        lambda: f"{r.choice(['ssn', 'SSN:', 'social security number', 'my social'])} {ssn()}",
        lambda: f"{r.choice(['iban', 'account', 'transfer to', ''])} {_iban(r)}",
        lambda: f"{r.choice(['mail', 'write to', 'email:', ''])} {w()}{r.choice(['.', '_', ''])}{w()}{at()}{w()}{dot()}{r.choice(['com', 'org', 'net', 'de'])}",
        lambda: f"{r.choice(['mail me:', 'email'])} {w()} at {w()} dot {r.choice(['com', 'org', 'net'])}",
        lambda: f"{r.choice(['mail me:', 'email', 'write to', 'contact', ''])} {w()}{r.choice(['.' + w(), ''])} {r.choice(['at', 'AT', '[AT]', '(AT)'])} {w()}.{r.choice(['com', 'org', 'net', 'de', 'fr'])}",
        lambda: f"{r.choice(['mail', ''])} {w()} [AT] {w()} [DOT] {r.choice(['com', 'org', 'net'])}",
    ]
    bad = [
        lambda: f"{r.choice(['order', 'invoice', 'serial', 'part no.', 'ref', 'model', 'item id'])} {r.choice([phone(), ssn(), d(9), d(8) + '-' + d(2)])}",
        lambda: f"{r.choice(['ISBN', 'isbn', 'ISSN'])} {d(3)}-{d(1)}-{d(4)}-{d(4)}",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {d(2)}",
        lambda: f"{r.choice(['pages', 'years', 'rows', w(), ''])} {r.randint(1700, 2030)}-{r.randint(1700, 2030)}{r.choice(['', '.', ','])}",
        lambda: f"{w()} {d(3)}{r.choice([',', '.', ' '])}{d(3)}{r.choice([',', '.', ' '])}{d(3)} {w()}",
        lambda: f"{w()} {d(r.choice([6, 7, 8, 9, 10, 12]))} {w()}",
        lambda: f"version {d(2)}.{d(3)}.{d(4)}",
        lambda: f"{w()} {d(2)}.{d(3)} {d(2)}.{d(3)} {d(3)}",
        lambda: f"{r.choice(['code', 'model', ''])} {w()[:2].upper()}{d(2)}{''.join(r.choice('ABCDEFGH0123456789') for _ in range(16))}",
        lambda: f"we met {w()} at {w()}. {w()} dot {w()} then",
        lambda: f"the {w()} at {w()} dot {w()} of {w()}",
        lambda: f"the {w()} at {w()}. {w().title()} {w()} {w()}",
        lambda: f"{w()} {w()} at {w()}.{w()} and {w()}",
    ]
    return [(f"{w()} {w()} {r.choice(good if label else bad)()} {w()} {w()}", label) for label in (r.randint(0, 1) for _ in range(n))]


def _table(rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for text, label in rows:
        b = text.encode()
        found = proposals(b)
        for p in found:
            x.append(features(b, *p))
            # The value is the widest candidate: what lies within another, as digits of an account do, isn't one.
            y.append(label and not any(q != p and q[1] <= p[1] and p[2] <= q[2] and (q[1], q[2]) != (p[1], p[2]) for q in found))
    return np.array(x, float), np.array(y, float)


@lru_cache(maxsize=1)
def selector() -> tuple[BoostedTrees, dict[int, float]]:
    """Trained and calibrated trees, and the threshold of each kind."""
    trees = BoostedTrees().fit(*_table(training_rows(4000, 11)))
    x, y = _table(training_rows(2000, 12))
    trees.calibrate(x, y)
    p, bars = trees.probability(x), {}
    for kind in range(4, 8):
        own = x[:, kind - 4] > 0
        bars[kind] = 1.0
        for bar in np.linspace(0.5, 0.99, 50):
            chosen = own & (p >= bar)
            if chosen.any() and y[chosen].mean() >= PRECISION:
                bars[kind] = float(bar)
                break
    return trees, bars


class Apart:
    """Bytes that chosen spans cover, as runs that don't touch each other's inside; two neighbours decide whether a span is free."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def add(self, s: int, e: int) -> bool:
        """Take a span if nothing covers any of it."""
        k = bisect.bisect_left(self.starts, e)  # the runs before k start before its end
        if k and self.ends[k - 1] > s:
            return False
        self.starts.insert(k, s)
        self.ends.insert(k, e)
        return True


def scan(text: bytes, chosen: tuple[BoostedTrees, dict[int, float]]) -> list[tuple[int, int, int]]:
    trees, bars = chosen
    found = base_spans(text)
    extra = proposals(text)
    likely = []
    for at in range(0, len(extra), CANDIDATES):
        own = extra[at : at + CANDIDATES]
        p = trees.probability(np.array([features(text, *s) for s in own], float))
        likely += [(q, s) for q, s in zip(p.tolist(), own) if q >= bars[s[0]]]
    if likely:
        taken = Apart((s, e) for _, s, e in found)
        found += [s for _, s in sorted(likely, key=lambda z: (-z[0], z[1][1], z[1][0])) if taken.add(*s[1:])]
        found.sort(key=lambda s: (s[1], s[0]))
    return found


def pii_spans(text):
    """Column of spans for a column of text."""
    chosen = selector()

    @F.arrow_udf(SPAN)
    def spans(column: pa.Array) -> pa.Array:
        rows = []
        for b in utf8(column):
            found = scan(b, chosen)
            offsets = sorted({o for s in found for o in s[1:]})
            at = dict(zip(offsets, code_points(b, offsets)))
            rows.append([{"kind": KINDS[k], "start": at[s], "end": at[e], "base": k < 4} for k, s, e in found])
        return pa.array(rows, ARROW_SPAN)

    return spans(text)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of (kind, start, end, base), by start, then kind."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), pii_spans(F.col(text_col).cast("string")).alias("spans"))
