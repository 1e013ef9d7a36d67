"""Near pairs of many trajectories with many, past bounds that never drop a pair within its bar.

The points of the right rows lie in a grid over their first two coordinates, of
about as many points to each column and row. For a left row a table says of each
cell which of the left row's points some point of the cell may match, a bit for
each point. One look-up for each right point then takes the place of a column of
the programme, for all right rows at once: the programmes of EDR, LCSS and of
Frechet's "within" run on words of bits, that of DTW becomes a sum of least
distances. Cells are taken for nearer than their points, so what is left is a
superset of the pairs within the bar; these are then measured as they are.

For EDR and LCSS left rows of more than 64 points, and for all functions rows with
coordinates that are no finite numbers, are held against the ends or lengths only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from wayfold.functions.distance import DELTA, EPS, STRIP, _points, measured_within, pairs_within

#: Columns and rows of a grid; pairs that are measured at once; rows of the first and second sample of ``kth_distances``.
GRID, MOST_PAIRS, LEVELS = 40, 1 << 20, (64, 1024)
WORDS = ((16, np.uint16), (32, np.uint32), (64, np.uint64))
ROUND = 1 + 1e-9


class Grid:
    """Right rows, the longest first, and the cell of each row's first, second, .. point."""

    def __init__(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        rows = np.flatnonzero(size > 0)
        self.rows = rows[np.argsort(-size[rows], kind="stable")]
        self.size, start = size[self.rows], start[self.rows]
        self.first, self.last = points[start].T.copy(), points[start + self.size - 1].T.copy()
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        cell = np.zeros(len(points), np.intp)
        for v in points.T[:2]:
            cuts = np.unique(np.quantile(v[:: max(1, len(v) // 20_000)], np.linspace(0, 1, GRID + 1)[1:-1]))
            self.boxes.append((np.concatenate([[v.min()], cuts]), np.concatenate([cuts, [v.max()]])))
            cell = cell * (len(cuts) + 1) + np.searchsorted(cuts, v, "right")
        #: Of each place how many rows have a point there: the first of ``rows``.
        self.held = np.searchsorted(-self.size, -np.arange(int(self.size[0]) + 1), "left")
        self.cells = [cell[start[:n] + k] for k, n in enumerate(self.held[:-1].tolist())]

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each point from each cell, from below."""
        out = np.zeros((len(x), 1))
        for v, (low, high) in zip(x.T, self.boxes):
            gap = np.maximum(np.maximum(low - v[:, None], v[:, None] - high), 0.0)
            out = (out[:, :, None] + (gap * gap)[:, None, :]).reshape(len(x), -1)
        return out

    def words(self, x: np.ndarray, reach: float) -> np.ndarray:
        """Of each cell the points of a left row within reach, as bits."""
        bits, kind = next((w, kind) for w, kind in WORDS if len(x) <= w)
        packed = np.packbits(self.gaps(x) <= (reach * ROUND) ** 2, axis=0, bitorder="little")
        out = np.zeros((packed.shape[1], bits // 8), np.uint8)
        out[:, : len(packed)] = packed.T
        return out.view(np.dtype(kind).newbyteorder("<"))[:, 0].astype(kind)

    def near(self, name: str, x: np.ndarray, bar: float, eps: float, delta: int) -> np.ndarray:
        """Places of ``rows`` that may lie within ``bar`` of a left row."""
        if not np.isfinite(bar):
            return np.arange(len(self.rows))
        return {"EDR": self._edits, "LCSS": self._common, "FRECHET": self._reached, "DTW": self._summed}[name](x, bar, eps, delta)

    def _alike(self, m: int, bar: float) -> tuple[int, int]:
        """Where the rows start and stop whose lengths differ by no more than the bar."""
        return int(np.searchsorted(-self.size, -(m + bar * ROUND), "left")), int(np.searchsorted(-self.size, -(m - bar * ROUND), "right"))

    def _edits(self, x: np.ndarray, bar: float, eps: float, delta: int) -> np.ndarray:
        """Myers' column of differences as two words: where a cell is one more, or one less, than the cell before."""
        m = len(x)
        lo, hi = self._alike(m, bar)
        if lo >= hi or m > 64 or bar >= max(m, int(self.size[lo])):
            return np.arange(lo, hi)
        table = self.words(x, eps)
        more, less = np.full(hi - lo, ~table.dtype.type(0)), np.zeros(hi - lo, table.dtype)
        across, down = np.empty_like(more), np.empty_like(more)
        for k, cells in enumerate(self.cells):
            n = min(hi, len(cells)) - lo
            if n <= 0:
                break
            p, q, h, v = more[:n], less[:n], across[:n], down[:n]
            match = table.take(cells[lo : lo + n])
            np.bitwise_and(match, p, out=h)
            h += p
            h ^= p
            h |= match
            np.bitwise_or(h, p, out=v)
            np.invert(v, out=v)
            v |= q
            h &= p
            match |= q
            v <<= 1
            v |= 1
            h <<= 1
            np.bitwise_or(match, v, out=p)
            np.invert(p, out=p)
            p |= h
            np.bitwise_and(v, match, out=q)
        own = table.dtype.type((1 << m) - 1)
        ends = self.size[lo:hi] + np.bitwise_count(more & own).astype(np.int64) - np.bitwise_count(less & own)
        return lo + np.flatnonzero(ends <= bar * ROUND)

    def _common(self, x: np.ndarray, bar: float, eps: float, delta: int) -> np.ndarray:
        """A word whose zeros count the points in common."""
        m = len(x)
        lo, hi = self._alike(m, bar)
        if lo >= hi or m > 64 or bar >= max(m, int(self.size[lo])):
            return np.arange(lo, hi)
        table = self.words(x, eps)
        word = np.full(hi - lo, ~table.dtype.type(0))
        for k, cells in enumerate(self.cells):
            n = min(hi, len(cells)) - lo
            if n <= 0 or k - delta >= m:
                break
            band = sum(1 << i for i in range(max(0, k - delta), min(m, k + delta + 1)))
            v = word[:n]
            match = table.take(cells[lo : lo + n]) & table.dtype.type(band)
            match &= v
            rest = v - match
            v += match
            v |= rest
        same = np.bitwise_count(~word & table.dtype.type((1 << m) - 1))
        return lo + np.flatnonzero(np.maximum(m, self.size[lo:hi]) - same <= bar * ROUND)

    def _ends(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the first and last points."""
        out = []
        for p, own in ((x[0], self.first), (x[-1], self.last)):
            d = own[0] - p[0]
            d *= d
            for a, b in zip(own[1:], p[1:]):
                d += (a - b) * (a - b)
            out.append(d)
        return out[0], out[1]

    def _reached(self, x: np.ndarray, bar: float, eps: float, delta: int) -> np.ndarray:
        """The left points that a walk may have come to, as bits: on from those before, and along all that are free."""
        first, last = self._ends(x)
        m, most = len(x), (bar * ROUND) ** 2
        at = np.flatnonzero((first <= most) & (last <= most))
        if not len(at):
            return at
        if m > 64:
            return self._reached_far(x, bar, at)
        table, found = self.words(x, bar), []
        come = np.zeros(len(at), table.dtype)
        for k, cells in enumerate(self.cells):
            free = table.take(cells.take(at))
            seed = free & 1 if not k else (come | (come << 1)) & free
            come = (((free + seed) ^ free) | seed) & free
            over = int(np.searchsorted(at, self.held[k + 1]))  # those from here on end with this point
            found.append(at[over:][(come[over:] >> table.dtype.type(m - 1)) & 1 > 0])
            on = np.flatnonzero(come[:over])
            at, come = at[on], come[on]
            if not len(at):
                break
        return np.concatenate(found)

    def _reached_far(self, x: np.ndarray, bar: float, at: np.ndarray) -> np.ndarray:
        """The same on several words, the carry of one in the next."""
        tables, one = [self.words(x[k : k + 64], bar).astype(np.uint64) for k in range(0, len(x), 64)], np.uint64(1)
        come, found, top = [np.zeros(len(at), np.uint64) for _ in tables], [], np.uint64((len(x) - 1) % 64)
        for k, cells in enumerate(self.cells):
            places, carry, over = cells.take(at), np.zeros(len(at), np.uint64), int(np.searchsorted(at, self.held[k + 1]))
            before = np.full(len(at), np.uint64(0 if k else 1))
            for w, table in enumerate(tables):
                free = table.take(places)
                seed = (come[w] | (come[w] << one) | before) & free
                before = come[w] >> np.uint64(63)
                total = free + seed
                beyond = total < free
                total += carry
                carry = (beyond | (total < carry)).astype(np.uint64)
                come[w] = ((total ^ free) | seed) & free
            found.append(at[over:][(come[-1][over:] >> top) & one > 0])
            on = np.flatnonzero(np.bitwise_or.reduce([w[:over] for w in come]))
            at, come = at[on], [w[on] for w in come]
            if not len(at):
                break
        return np.concatenate(found)

    def _summed(self, x: np.ndarray, bar: float, eps: float, delta: int) -> np.ndarray:
        """Every right point lies on the walk at least once, the ends with the ends."""
        table = np.sqrt(self.gaps(x).min(0)).astype(np.float32)
        total = np.zeros(len(self.rows), np.float32)
        for cells in self.cells:
            total[: len(cells)] += table.take(cells)
        if len(x) > 1:
            n = int(self.held[1])  # rows of two points or more
            first, last = self._ends(x)
            inner = total[:n] - table.take(self.cells[0][:n]) - table.take(self._last_cells()[:n])
            total[:n] = np.maximum(inner, 0.0) + np.sqrt(first[:n]) + np.sqrt(last[:n])
        scale = bar + float(table.max()) * len(self.cells)  # what the sums of single precision are off by goes with this
        return np.flatnonzero(total <= bar + 1e-5 * scale)

    def _last_cells(self) -> np.ndarray:
        if not hasattr(self, "_ended"):
            self._ended = np.zeros(len(self.rows), np.intp)
            for k, cells in enumerate(self.cells):
                own = slice(int(self.held[k + 1]), len(cells))
                self._ended[own] = cells[own]
        return self._ended


def near_chunks(
    name: str, a: pa.Array, b: pa.Array, bars: np.ndarray, eps: float = EPS, delta: int = DELTA, numbers: tuple[np.ndarray, np.ndarray] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``pairs_within`` with a bar for each row of ``a``, for many rows of ``b``, a part at a time. With ``numbers`` of
    the rows of both, pairs of no greater number on the left only."""
    left, right = _points(a), _points(b)
    bars = np.asarray(bars, float)
    if not len(left[0]) or not len(right[0]) or not (np.isfinite(left[0]).all() and np.isfinite(right[0]).all()):
        for start in range(0, len(a), STRIP):
            i, j, d = pairs_within(name, a[start : start + STRIP], b, bars[start : start + STRIP], eps, delta)
            kept = slice(None) if numbers is None else numbers[0][start + i] <= numbers[1][j]
            yield start + i[kept], j[kept], d[kept]
        return
    if left[0].shape[1] != right[0].shape[1]:
        raise ValueError("the points of both sides have to have the same number of coordinates")
    grid = Grid(*right)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    many = 0
    for row in np.flatnonzero(left[2] > 0).tolist():
        x = left[0][left[1][row] : left[1][row] + left[2][row]]
        at = grid.rows[grid.near(name, x, float(bars[row]), eps, delta)]
        at = at if numbers is None else at[numbers[1][at] >= numbers[0][row]]
        if len(at):
            waiting.append((np.full(len(at), row), at))
            many += len(at)
        if many >= MOST_PAIRS:
            yield measured_within(name, left, right, *(np.concatenate(part) for part in zip(*waiting)), bars, eps, delta)
            waiting, many = [], 0
    if waiting:
        yield measured_within(name, left, right, *(np.concatenate(part) for part in zip(*waiting)), bars, eps, delta)


def near_pairs(name: str, a: pa.Array, b: pa.Array, bars: np.ndarray, eps: float = EPS, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All parts of ``near_chunks`` as one."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    i, j, d = (np.concatenate(part) for part in zip(none, *near_chunks(name, a, b, bars, eps, delta)))
    return i, j, d


def kth_distances(name: str, a: pa.Array, b: pa.Array, k: int, eps: float = EPS, delta: int = DELTA) -> np.ndarray:
    """The k-th least distance of each row of ``a`` from rows of ``b``, infinite where there are fewer: from a few rows, then from more within that."""
    order = np.random.default_rng(7).permutation(len(b))
    best, done = np.full((len(a), k), np.inf), 0
    for to in (*(max(n, 4 * k) for n in LEVELS), len(b)):
        to = min(to, len(b))
        if to <= done:
            continue
        i, _, d = near_pairs(name, a, b.take(pa.array(order[done:to])), best[:, -1], eps, delta)
        by = np.lexsort((d, i))
        i, d = i[by], d[by]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        own = np.full((len(a), k), np.inf)
        own[i[place < k], place[place < k]] = d[place < k]
        best = np.sort(np.concatenate([best, own], 1), 1)[:, :k]
        done = to
    return best[:, -1]
