"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words (runs of letters, A-Z lower-cased), each hashed
to one of 2**18 terms. Its margin is a bias, the sum of the linear weights of
its terms, and the sum over pairs of terms of the inner product of their
factors, so a pair such as an insult and the mention of a group may weigh more
than both alone.

Learning takes a bounded sample: ``SAMPLE`` labelled ids, those with the smallest
hash, of each one document (an id that stands on several documents gives the one
with the least set of terms), and of each document at most ``TERMS`` terms, those
with the smallest hash. Of these a third calibrates the score (Platt) and the
rest fits the weights. Terms enter by a score test against the bias alone, and
then, among texts that hold such a term, by a score test against the linear
fit, which admits terms that matter only beside others. Only admitted terms
have weights; all texts of the table are scored in whole.

Null counts as empty. An empty text, and every text if no row is labelled or
all labels are equal, gets the score of the bias. Labels other than 0 and 1 are
passed over; of labels that repeat an id the larger one counts. Rows that repeat a
document's id are scored each by its own text. A row without an id is scored and
counts as not held out. A very long text is scored in whole, in runs of about a
megabyte of several texts or alone. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import ship
from wayfold.llm.words import LETTERS, slices, words

BITS, FACTORS = 18, 8
SAMPLE = 8192  #: Labelled documents that are fitted at most.
TERMS = 4096  #: Terms of a document that take part in the fit at most.
STRICT = 4.5  #: Standard errors that the gradient of a term must exceed.
LEAST = 3.0  #: And its least size: a term in fewer texts never enters.


def term_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first, one past the last, row of each distinct term, term; by row."""
    for at, to, own, ends in slices(column):
        h, upto = words(own, ends, LETTERS)
        row = np.repeat(np.arange(to - at), np.diff(upto, prepend=0))
        yield at, to, row, (h >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Machine:
    bias: float = 0.0
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))
    scale: tuple[float, float] = (1.0, 0.0)

    def margins(self, row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """Of n rows, from pairs of row and place among ``terms``, each pair once."""
        linear = np.bincount(row, self.weights[place], n)
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[place, f]
            pairs += np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n)
        return self.bias + linear + pairs / 2

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * margins + self.scale[1], -40, 40)))

    def score_column(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        place = np.full(1 << BITS, -1, np.int64)
        place[self.terms] = np.arange(len(self.terms))
        for at, to, row, term in term_sets(column):
            p = place[term]
            known = p >= 0
            key = np.unique(row[known] * max(1, len(self.terms)) + p[known])
            out[at:to] = self.scores(self.margins(key // max(1, len(self.terms)), key % max(1, len(self.terms)), to - at))
        return out


def _admit(row: np.ndarray, term: np.ndarray, error: np.ndarray, variance: np.ndarray) -> np.ndarray:
    g = np.bincount(term, error[row], 1 << BITS)
    v = np.bincount(term, variance[row], 1 << BITS)
    return np.flatnonzero(np.abs(g) > np.maximum(STRICT * np.sqrt(v), LEAST))


def fit(row: np.ndarray, term: np.ndarray, y: np.ndarray, steps: int = 300, ridge: float = 0.02, seed: int = 7) -> Machine:
    """From pairs of row and term, each once, and the labels of the rows."""
    n = len(y)
    machine = Machine()
    if not n:
        return machine
    fits = np.arange(n) % 3 != 0
    if min(y[fits].sum(), (1 - y[fits]).sum()) < 1:
        fits[:] = True
    rate = np.clip(y[fits].mean(), 0.5 / n, 1 - 0.5 / n)
    machine.bias = float(np.log(rate / (1 - rate)))
    own = fits[row]
    r, t = row[own], term[own]
    terms = _admit(r, t, np.where(fits, y - rate, 0.0), np.full(n, rate * (1 - rate)))

    def learn(terms: np.ndarray, factors: np.ndarray, steps: int) -> None:
        """Adam on all fitted rows, with a ridge in proportion to 1 / rows."""
        place = np.full(1 << BITS, -1, np.int64)
        place[terms] = np.arange(len(terms))
        known = place[t] >= 0
        rr, pp = r[known], place[t[known]]
        machine.terms, machine.factors = terms, factors
        machine.weights = np.zeros(len(terms))
        m = [np.zeros(1), np.zeros(len(terms)), np.zeros_like(factors)]
        s = [x.copy() for x in m]
        total = fits.sum()
        for k in range(1, steps + 1):
            e = np.where(fits, 1 / (1 + np.exp(-np.clip(machine.margins(rr, pp, n), -40, 40))) - y, 0.0)
            gv = np.zeros_like(factors)
            for f in range(factors.shape[1]):
                v = machine.factors[pp, f]
                around = np.bincount(rr, v, n)[rr] - v
                gv[:, f] = np.bincount(pp, e[rr] * around, len(terms))
            grads = [np.array([e.sum()]) / total, np.bincount(pp, e[rr], len(terms)) / total + ridge / 10 * machine.weights / total, gv / total + ridge * 50 * machine.factors / total]
            moves = []
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.99 * s[i] + 0.01 * g * g
                moves.append(0.05 * (m[i] / (1 - 0.9**k)) / (np.sqrt(s[i] / (1 - 0.99**k)) + 1e-9))
            machine.bias -= float(moves[0][0])
            machine.weights = machine.weights - moves[1]
            machine.factors = machine.factors - moves[2]

    learn(terms, np.zeros((len(terms), 0)), steps // 2)
    if len(terms):
        beside = np.zeros(n, bool)
        beside[r[np.isin(t, terms)]] = True
        place = np.full(1 << BITS, -1, np.int64)
        place[terms] = np.arange(len(terms))
        known = place[t] >= 0
        p = 1 / (1 + np.exp(-np.clip(machine.margins(r[known], place[t[known]], n), -40, 40)))
        near = beside[r]
        more = _admit(r[near], t[near], np.where(fits, y - p, 0.0), p * (1 - p))
        terms = np.union1d(terms, more)
        start = np.random.default_rng(seed).normal(0, 0.05, (len(terms), FACTORS))
        learn(terms, start, steps)
    kept = ~fits if (~fits).any() and 0 < y[~fits].sum() < (~fits).sum() else fits
    place = np.full(1 << BITS, -1, np.int64)
    place[machine.terms] = np.arange(len(machine.terms))
    known = place[term] >= 0
    x = machine.margins(row[known], place[term[known]], n)[kept]
    machine.scale = _platt(x, y[kept])
    return machine


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift; smoothed targets keep both finite."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - target) * x).sum() + (a - 1), (p - target).sum()])
        hess = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, c = max(0.05, a - step[0]), c - step[1]
    return float(a), float(c)


def held_out(id_col):
    """Column: the row is never learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """A machine fitted to labelled rows that aren't held out."""
    ship(docs.sparkSession)
    usable = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[bytes] = [b""] * batch.num_rows
            for at, to, row, term in term_sets(batch.column(2)):
                key = np.unique(row << BITS | term)
                upto = np.searchsorted(key >> BITS, np.arange(to - at + 1))
                own = (key & ((1 << BITS) - 1)).astype("<u4")
                for k in range(to - at):
                    sets[at + k] = own[upto[k] : min(upto[k + 1], upto[k] + TERMS)].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["id", "y", "terms"])

    rows = texts.select("id", F.col("y").cast("int").alias("y"), "text").mapInArrow(run, "id long, y int, terms binary")
    rows = rows.groupBy("id").agg(F.max("y").alias("y"), F.min("terms").alias("terms"))  # so that the driver gets a row for each id
    got = sorted((x["id"], x["y"], bytes(x["terms"])) for x in rows.toLocalIterator())
    if not got:
        return Machine(bias=-40.0)
    sets = [np.frombuffer(b, "<u4").astype(np.int64) for _, _, b in got]
    rng = np.random.default_rng(5).permutation(len(got))  # ids say nothing of the third that calibrates
    row = np.repeat(rng, [len(s) for s in sets])
    y = np.empty(len(got))
    y[rng] = [v for _, v, _ in got]
    return fit(row, np.concatenate(sets), y)


def score_udf(machine: Machine):
    """Column function: the score of a text."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(machine.score_column(column))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    score = score_udf(learn(docs, labels, id_col, text_col, label_col))
    scored = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col).cast("string")).alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bar: float = 0.5) -> DataFrame:
    """The documents whose score is below ``bar``, with all their columns."""
    score = score_udf(learn(docs, labels, id_col, text_col, label_col))
    return docs.where(score(F.col(text_col).cast("string")) < bar)
