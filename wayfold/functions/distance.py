"""Distances between trajectories: DTW, discrete Frechet, EDR and LCSS.

A trajectory is an ``array<array<double>>`` of points in order. Each distance
exists twice, with equal results: as an Arrow function, which runs the dynamic
programme of a whole batch of pairs at once on numpy, and as a Column made of
nested folds, which stays in the JVM. EDR and LCSS match two points whose
Euclidean distance is at most ``eps``; LCSS pairs places at most ``delta``
apart and gives the dissimilarity max(m, n) - S.

A null or empty trajectory has a null distance to anything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("DTW", "FRECHET", "EDR", "LCSS")
EPS, DELTA = 25.0, 8
#: Doubles of point distances that are held at once.
HELD = 4_000_000
#: The same for pairs that leave when they are over, which are best held in a processor's cache; and the share of pairs from which a row moves none.
PAIRS_HELD, SLACK = 400_000, 0.85
#: Points of the right sides whose walks are followed at once.
CELLS = 1 << 16
#: Left rows whose ends are held against those of all right rows at once.
STRIP = 256


def check_name(name: str) -> str:
    if name.upper() not in NAMES:
        raise ValueError(f"unknown trajectory distance {name}")
    return name.upper()


# ---------------------------------------------------------------- numpy

def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All points of a column, and where each row's points start and end."""
    n = len(column)
    column = pa.concat_arrays([column]) if not isinstance(column, pa.ChunkedArray) else column.combine_chunks()
    rows = np.asarray(column.is_valid())
    size = np.where(rows, np.nan_to_num(np.asarray(column.value_lengths().fill_null(0))), 0).astype(np.int64)
    inner = column.flatten()
    flat = np.asarray(inner.flatten().fill_null(np.nan), dtype=float)
    width = len(flat) // len(inner) if len(inner) else 1
    if len(inner) and not np.all(np.asarray(inner.value_lengths().fill_null(-1)) == width):
        raise ValueError("the points of a trajectory column have to have one number of coordinates, and none may be null")
    ends = np.cumsum(size)
    return flat.reshape(-1, width) if len(inner) else np.zeros((0, 1)), ends - size, np.asarray(size[:n])


def _padded(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    place = start[:, None] + np.minimum(np.arange(size.max()), size[:, None] - 1)
    return points[place]


def batch_distances(name: str, a: pa.Array, b: pa.Array | np.ndarray, eps: float = EPS, delta: int = DELTA) -> pa.Array:
    """The distance of each pair of rows; ``b`` may be one trajectory for all."""
    pa_, sa, na = _points(a)
    if isinstance(b, np.ndarray):
        pb, sb, nb = b, np.zeros(len(na), np.int64), np.full(len(na), len(b))
    else:
        pb, sb, nb = _points(b)
    out = np.full(len(na), np.nan)
    usable = np.flatnonzero((na > 0) & (nb > 0))
    usable = usable[np.lexsort((nb[usable], na[usable]))]  # alike lengths together: little padding
    at = 0
    while at < len(usable):
        to = at + 1
        while to < len(usable) and (to + 1 - at) * na[usable[to]] * max(nb[usable[at : to + 1]].max(), 1) <= HELD and to - at < 4096:
            to += 1
        own = usable[at:to]
        x, y = _padded(pa_, sa[own], na[own]), _padded(pb, sb[own], nb[own])
        out[own] = _programme(name, x, y, na[own], nb[own], eps, delta)
        at = to
    return pa.array(out, mask=(na == 0) | (nb == 0))


def _programme(name: str, x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, eps: float, delta: int) -> np.ndarray:
    """One cell of all pairs at a time; rows that are shorter give their result when their corner is reached."""
    pairs, rows, columns = len(x), x.shape[1], y.shape[1]
    out = np.zeros(pairs)
    edit = name in ("EDR", "LCSS")
    prev = [np.full(pairs, float(j) if name == "EDR" else 0.0) for j in range(columns + 1)] if edit else []
    for i in range(rows):
        d = x[:, i, None, :] - y
        d = d * d
        total = d[..., 0].copy()
        for k in range(1, d.shape[2]):
            total += d[..., k]
        d = np.sqrt(total)
        row = [np.full(pairs, float(i + 1) if name == "EDR" else 0.0)] if edit else []
        for j in range(columns):
            c = d[:, j]
            if name == "EDR":
                row.append(np.minimum(np.minimum(prev[j] + (c > eps), prev[j + 1] + 1), row[j] + 1))
            elif name == "LCSS":
                skip = np.maximum(prev[j + 1], row[j])
                row.append(np.where(c <= eps, prev[j] + 1, skip) if abs(i - j) <= delta else skip)
            else:
                if i and j:
                    best = np.minimum(np.minimum(prev[j], prev[j - 1]), row[j - 1])
                else:
                    best = prev[0] if i else row[j - 1] if j else np.zeros(pairs)
                row.append(c + best if name == "DTW" else np.maximum(c, best))
        ends = np.flatnonzero(m == i + 1)
        if len(ends):
            table = np.stack(row)
            out[ends] = table[n[ends] if edit else n[ends] - 1, ends]
        prev = row
    return np.maximum(m, n) - out if name == "LCSS" else out

def _ends_bound(name: str, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The bound of ``lower_bound_sql`` for all pairs of some rows."""
    (pa_, sa, na), (pb, sb, nb) = a, b
    if name in ("EDR", "LCSS"):
        return np.abs(na[rows][:, None] - nb[columns])

    def gap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = x[:, None, :] - y
        return np.sqrt((d * d).sum(axis=2))

    first = gap(pa_[sa[rows]], pb[sb[columns]])
    last = gap(pa_[sa[rows] + na[rows] - 1], pb[sb[columns] + nb[columns] - 1])
    if name == "FRECHET":
        return np.maximum(first, last)
    return np.where((na[rows][:, None] == 1) & (nb[columns] == 1), first, first + last)


def pairs_within(name: str, a: pa.Array, b: pa.Array, bar: float | np.ndarray, eps: float = EPS, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs of a row of ``a`` and a row of ``b``: the places and the distance of those within ``bar``, which may be a number for each row of ``a``.

    The ends or lengths drop most pairs, strip by strip; the programme leaves
    each of the others as soon as it can't end within the bar.
    """
    left, right = _points(a), _points(b)
    na, nb = left[2], right[2]
    bars = np.broadcast_to(np.asarray(bar, float), len(na))
    rows, columns = np.flatnonzero(na > 0), np.flatnonzero(nb > 0)
    rows = rows[np.argsort(na[rows], kind="stable")]
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(rows), STRIP):
        strip = rows[at : at + STRIP]
        i, j = np.nonzero(_ends_bound(name, left, right, strip, columns) <= bars[strip][:, None] * (1 + 1e-9))
        i, j = strip[i], columns[j]
        found.append(measured_within(name, left, right, i, j, bars, eps, delta))
    i, j, d = (np.concatenate(part) for part in zip(*found))
    return i, j, d


def measured_within(
    name: str, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, bars: np.ndarray, eps: float, delta: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some pairs of rows: those within the bar of their left row, and their distances."""
    if name in ("DTW", "FRECHET"):
        return _walked_within(name, left, right, i, j, bars)
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    order = np.argsort(right[2][j], kind="stable")  # alike lengths together
    i, j = i[order], j[order]
    sizes, start = right[2][j], 0
    while start < len(j):
        stop = int(np.searchsorted(sizes, 2 * sizes[start] + 4, "right"))
        stop = min(stop, start + max(1, PAIRS_HELD // int(sizes[stop - 1])))
        place, d = _programme_within(name, left, right, i[start:stop], j[start:stop], bars[i[start:stop]], eps, delta)
        found.append((i[start:stop][place], j[start:stop][place], d))
        start = stop
    i, j, d = (np.concatenate(part) for part in zip(*found))
    return i, j, d


def _walked_within(
    name: str, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, bars: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for walks. Those of DTW are first measured in single precision, past what that may be off by, and what is left as it is."""
    m, n = left[2], right[2]
    order = np.lexsort((m[i], n[j]))  # alike lengths together
    i, j = i[order], j[order]
    most = max((float(np.abs(p).max(initial=0.0)) for p in (left[0], right[0])), default=0.0)
    if name == "DTW" and most < 1e15 and len(i) and np.isfinite(bars[i]).all():
        steps = m[i] + n[j] + 8
        kept = np.flatnonzero(_walks(name, left, right, i, j, bars[i] + steps * (1.2e-7 * bars[i] + 1e-6 * most), np.float32) >= 0)
        i, j = i[kept], j[kept]
    d = _walks(name, left, right, i, j, bars[i], np.float64)
    kept = np.flatnonzero(d >= 0)
    return i[kept], j[kept], d[kept]


def _walks(name: str, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, bars: np.ndarray, kind: type) -> np.ndarray:
    """Distances of pairs that lie in the order of their lengths, -1 over their bars."""
    xs, ys = (np.ascontiguousarray(p.T, kind) for p in (left[0], right[0]))
    at, to, m, n = left[1][i], right[1][j], left[2][i], right[2][j]
    out, start = np.full(len(i), -1.0), 0
    while start < len(i):
        stop = min(len(i), start + max(1, CELLS // int(n[start])))
        stop = start + int(np.searchsorted(n[start:stop], 1.1 * n[start] + 1, "right"))
        own = slice(start, stop)
        out[own] = _diagonals(name, xs, ys, at[own], to[own], m[own], n[own], bars[own], kind)
        start = stop
    return out


def _diagonals(
    name: str, xs: np.ndarray, ys: np.ndarray, at: np.ndarray, to: np.ndarray, m: np.ndarray, n: np.ndarray, bars: np.ndarray, kind: type
) -> np.ndarray:
    """The programme of walks, a diagonal of all pairs at a time; Frechet's on squared distances.

    A walk touches one of each two diagonals that follow each other, so a pair
    goes once both lie over its bar.
    """
    rows, columns, out = int(m.max()), int(n.max()), np.full(len(at), -1.0)
    total, place = name == "DTW", np.arange(len(at))
    loose = (bars * (1 + 1e-9)).astype(kind) if total else np.square(bars * (1 + 1e-9), dtype=kind)
    ends = m + n - 2  # the diagonal of the last cell
    own, back = at + np.minimum(np.arange(rows)[:, None], m - 1), to + np.minimum(np.arange(columns)[::-1, None], n - 1)
    p, q = [x.take(own) for x in xs], [y.take(back) for y in ys]  # a shorter side repeats its last point; the right one's last comes first
    # Line r + 1 of a diagonal is the cell of left point r; cells beyond the table stay infinite.
    one, two, new = (np.full((rows + 1, len(at)), np.inf, kind) for _ in range(3))
    held, more = np.empty((rows, len(at)), kind), np.empty((rows, len(at)), kind)
    every, ending = max(6, (rows + columns) // 8), set(ends.tolist())
    for t in range(rows + columns - 1):
        low, high = max(0, t - columns + 1), min(rows, t + 1)
        own, back = slice(low, high), slice(columns - 1 - t + low, columns - 1 - t + high)
        d, c = held[: high - low], more[: high - low]
        np.subtract(p[0][own], q[0][back], out=d)
        np.multiply(d, d, out=d)
        for x, y in zip(p[1:], q[1:]):
            np.subtract(x[own], y[back], out=c)
            np.multiply(c, c, out=c)
            np.add(d, c, out=d)
        cell = new[low + 1 : high + 1]
        if t:
            np.minimum(one[low + 1 : high + 1], one[low:high], out=cell)
            np.minimum(cell, two[low:high], out=cell)
        if total:
            np.sqrt(d, out=d)
            np.add(d, cell if t else 0, out=cell)
        else:
            np.maximum(d, cell if t else 0, out=cell)
        two, one, new = one, new, two
        if t in ending:
            done = np.flatnonzero(ends == t)
            d = one[m[done], done].astype(float)
            d = d if total else np.sqrt(d)
            within = d <= bars[done]
            out[place[done[within]]] = d[within]
        elif t % every == every - 1:
            open_ = (one[low + 1 : high + 1].min(0) <= loose) | (two[low : high + 1].min(0) <= loose)
            open_ &= ends > t
            kept = np.flatnonzero(open_)
            if not len(kept):
                break
            if len(kept) < 0.7 * len(open_):
                p, q = [x.take(kept, 1) for x in p], [y.take(kept, 1) for y in q]
                one, two, new = (x.take(kept, 1) for x in (one, two, new))
                held, more = held[:, : len(kept)].copy(), more[:, : len(kept)].copy()
                m, ends, bars, loose, place = m[kept], ends[kept], bars[kept], loose[kept], place[kept]
    return out


def _programme_within(
    name: str, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, bar: np.ndarray, eps: float, delta: int
) -> tuple[np.ndarray, np.ndarray]:
    """Which of some pairs are within their bars, and their distances.

    After each row of the programme the pairs go whose best cell is over the
    bar. A pair within the bar of EDR or LCSS leaves at most ``bar`` points of
    either side alone, so only cells that near the diagonal count.
    """
    xs, ys = a[0].T.copy(), b[0].T.copy()
    at, to, m, n = a[1][i], b[1][j], a[2][i], b[2][j]
    edit, far = name in ("EDR", "LCSS"), -np.inf if name == "LCSS" else np.inf
    columns, place, loose = int(n.max()), np.arange(len(i)), bar * (1 + 1e-9)
    band = int(min(max(bar.max(initial=0.0), 0), columns + int(m.max()))) if edit else 0
    kept, values = [np.zeros(0, np.int64)], [np.zeros(0)]
    # Cell k of a row stands for the first k points of the right side; cell 0 is the edge.
    prev = [np.full(len(i), float(k) if name == "EDR" else 0.0) if k <= band else far for k in range(columns + 1)] if edit else []
    # The right side's points in each column, gathered once; a shorter side repeats its last.
    held = [[y[to + np.minimum(k, n) - 1] for y in ys] for k in range(1, columns + 1)]
    for r in range(int(m.max())):
        if not len(place):
            break
        p = xs[:, at + np.minimum(r, m - 1)]  # pairs that have ended aren't looked at again
        low, high = (max(1, r + 1 - band), min(columns, r + 1 + band)) if edit else (1, columns)
        row = [far] * (columns + 1)
        if edit and r + 1 <= band:
            row[0] = np.full(len(place), float(r + 1) if name == "EDR" else 0.0)
        for k in range(low, high + 1):
            q = held[k - 1]
            c = p[0] - q[0]
            c = c * c
            for x, y in zip(p[1:], q[1:]):
                c += (x - y) * (x - y)
            c = np.sqrt(c)
            if name == "EDR":
                row[k] = np.minimum(np.minimum(prev[k - 1] + (c > eps), prev[k] + 1), row[k - 1] + 1)
            elif name == "LCSS":
                skip = np.maximum(prev[k], row[k - 1])
                row[k] = np.where(c <= eps, np.maximum(prev[k - 1] + 1, skip), skip) if abs(r + 1 - k) <= delta else np.broadcast_to(skip, c.shape)
            else:
                if r and k > 1:
                    best = np.minimum(np.minimum(prev[k], prev[k - 1]), row[k - 1])
                else:
                    best = prev[1] if r else row[k - 1] if k > 1 else 0.0
                row[k] = c + best if name == "DTW" else np.maximum(c, best)
        open_ = np.zeros(len(place), bool)
        ended = m == r + 1
        for k in range(0 if edit and r + 1 <= band else low, high + 1):
            if name == "LCSS":
                open_ |= np.maximum(m, n) - (row[k] + np.minimum(m - r - 1, n - k)) <= loose
            else:
                open_ |= row[k] <= loose
            done = np.flatnonzero(ended & (n == k))
            if len(done):
                d = np.maximum(m[done], n[done]) - row[k][done] if name == "LCSS" else row[k][done]
                within = d <= bar[done]
                kept.append(place[done[within]])
                values.append(d[within])
        open_ &= ~ended
        kept_ = np.flatnonzero(open_)
        if len(kept_) > SLACK * len(open_):  # pairs that are over stay over: a few of them cost less than moving the rest
            prev = row
        else:
            at, m, n, place, bar, loose = at[kept_], m[kept_], n[kept_], place[kept_], bar[kept_], loose[kept_]
            prev = [cell[kept_] if isinstance(cell, np.ndarray) else cell for cell in row]
            held = [[y[kept_] for y in q] for q in held]
    return np.concatenate(kept), np.concatenate(values)


def distance(name: str, a: Column | str, b: Column | str, eps: float = EPS, delta: int = DELTA) -> Column:
    """Arrow function of two trajectory columns."""
    name = check_name(name)

    @F.arrow_udf("double")
    def pairwise(x: pa.Array, y: pa.Array) -> pa.Array:
        return batch_distances(name, x, y, eps, delta)

    return pairwise(a, b)


def distance_to(name: str, column: Column | str, query: list[list[float]], eps: float = EPS, delta: int = DELTA) -> Column:
    """Arrow function of a trajectory column and one trajectory."""
    name, points = check_name(name), np.array(query, float).reshape(len(query), -1) if query else np.zeros((0, 1))

    @F.arrow_udf("double")
    def single(x: pa.Array) -> pa.Array:
        return batch_distances(name, x, points, eps, delta)

    return single(column)


# ---------------------------------------------------------------- folds

def point_distance(p: str, q: str, dims: int = 2) -> str:
    """SQL: Euclidean distance of two points."""
    terms = [f"({p}[{k}] - {q}[{k}]) * ({p}[{k}] - {q}[{k}])" for k in range(dims)]
    return f"sqrt({' + '.join(terms)})"


def fold_sql(name: str, a: str, b: str, eps: float = EPS, delta: int = DELTA, dims: int = 2) -> str:
    """The distance as one SQL expression over two trajectory columns."""
    name, none = check_name(name), "CAST(array() AS ARRAY<DOUBLE>)"
    if name in ("DTW", "FRECHET"):
        d = point_distance("p", f"{b}[j]", dims)
        best = (
            "CASE WHEN size(prev) = 0 AND j = 0 THEN 0D WHEN size(prev) = 0 THEN element_at(row, -1) WHEN j = 0 THEN prev[0] "
            "ELSE least(prev[j], prev[j - 1], element_at(row, -1)) END"
        )
        cell = f"{d} + {best}" if name == "DTW" else f"greatest({d}, {best})"
        body = f"aggregate(sequence(0, size({b}) - 1), {none}, (row, j) -> array_append(row, {cell}))"
        fold = f"aggregate({a}, {none}, (prev, p) -> {body}, last -> element_at(last, -1))"
    else:
        d = point_distance(f"{a}[i - 1]", f"{b}[j - 1]", dims)
        if name == "EDR":
            seed, first = f"transform(sequence(0, size({b})), k -> CAST(k AS DOUBLE))", "prev[0] + 1D"
            cell = f"least(prev[j - 1] + CASE WHEN {d} <= {eps}D THEN 0D ELSE 1D END, prev[j] + 1D, element_at(row, -1) + 1D)"
        else:
            seed, first = f"transform(sequence(0, size({b})), k -> 0D)", "0D"
            cell = f"CASE WHEN {d} <= {eps}D AND abs(i - j) <= {delta} THEN prev[j - 1] + 1D ELSE greatest(prev[j], element_at(row, -1)) END"
        body = f"aggregate(sequence(1, size({b})), array({first}), (row, j) -> array_append(row, {cell}))"
        fold = f"aggregate(sequence(1, size({a})), {seed}, (prev, i) -> {body}, last -> element_at(last, -1))"
        if name == "LCSS":
            fold = f"greatest(size({a}), size({b})) - {fold}"
    return f"CASE WHEN size({a}) > 0 AND size({b}) > 0 THEN {fold} END"


def native_distance(name: str, a: str, b: str, eps: float = EPS, delta: int = DELTA, dims: int = 2) -> Column:
    return F.expr(fold_sql(name, a, b, eps, delta, dims))


# ---------------------------------------------------------------- bounds

def lower_bound_sql(name: str, a: str, b: str, dims: int = 2) -> str:
    """SQL: a bound that no distance goes below, from the ends or the lengths of two trajectories."""
    if check_name(name) in ("EDR", "LCSS"):
        return f"CAST(abs(size({a}) - size({b})) AS DOUBLE)"
    # A row that an earlier filter drops may still be evaluated: no access may fail on an empty trajectory.
    first = point_distance(f"get({a}, 0)", f"get({b}, 0)", dims)
    last = point_distance(f"try_element_at({a}, -1)", f"try_element_at({b}, -1)", dims)
    if name.upper() == "FRECHET":
        return f"greatest({first}, {last})"
    return f"CASE WHEN size({a}) = 1 AND size({b}) = 1 THEN {first} ELSE {first} + {last} END"


def box_bound(name: str, column: str, low: list, high: list, eps: float = EPS) -> Column:
    """A bound from the points of a trajectory and the box of the other, given by numbers or columns."""
    side = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    outside = lambda p, k: F.greatest(side(low[k]) - p[k], p[k] - side(high[k]), F.lit(0.0))
    gap = lambda p: F.sqrt(sum((outside(p, k) * outside(p, k) for k in range(1, len(low))), outside(p, 0) * outside(p, 0)))
    start = F.lit(0.0)
    if name == "DTW":
        return F.aggregate(column, start, lambda s, p: s + gap(p))
    if name == "FRECHET":
        return F.aggregate(column, start, lambda s, p: F.greatest(s, gap(p)))
    return F.aggregate(column, start, lambda s, p: s + F.when(gap(p) > eps, 1.0).otherwise(0.0))
