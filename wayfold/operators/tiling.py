"""Sort-Tile-Recursive tiling of points, level under level.

A tile tree has levels of axes, such as the coordinates of first points, then of
last points. Within a level that is to make ``t`` tiles of ``d`` axes, the first
axis is cut into ceil(t ** (1/d)) slabs of about equal counts, and each slab on
its own is cut along the next axis into ceil of what is left, and so on; each
tile of a level is then cut by the next level in the same way. So a cut is made
from the points of its own slab, and points along a curve fill their tiles as
evenly as points all over the plane.

The cuts come from a bounded sample; every row is then placed by them. Tiles are
half open and cover all of space: a point on a cut belongs to the upper tile,
one beyond the sample to an outermost one. A coordinate that a row doesn't have
counts as beyond all others. Equal cuts are one: points that coincide can't be
parted, and their tiles have fewer neighbours. One tile has no cuts, and no
points make one tile.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def fan_outs(tiles: int, levels: list[int]) -> list[int]:
    """Pieces along each axis of levels of so many axes, for about ``tiles`` tiles."""
    fans, rest = [], float(max(tiles, 1))
    for k, axes in enumerate(levels):
        own = math.ceil(round(rest ** (1 / (len(levels) - k)), 9))
        rest = max(rest / own, 1.0)
        for i in range(axes):
            pieces = math.ceil(round(own ** (1 / (axes - i)), 9))
            fans.append(pieces)
            own = max(own / pieces, 1.0)
    return fans


@dataclass
class Tiling:
    """Of each axis the number of pieces, and the cuts within each node above it; missing cuts are NaN."""

    fans: list[int]
    cuts: list[np.ndarray]

    @property
    def tiles(self) -> int:
        return math.prod(self.fans)

    def place(self, points: np.ndarray) -> np.ndarray:
        """The tile of each row of coordinates."""
        points = np.where(np.isnan(points), np.inf, points)
        node = np.zeros(len(points), np.int64)
        for k, (fan, cuts) in enumerate(zip(self.fans, self.cuts)):
            if fan > 1:
                node = node * fan + (cuts[node] <= points[:, k, None]).sum(1)
        return node


def tiling(sample: np.ndarray, tiles: int, levels: list[int]) -> Tiling:
    """Cuts that give each tile about as many rows of the sample (a column for each axis)."""
    fans = fan_outs(tiles, levels)
    sample = np.where(np.isnan(sample), np.inf, sample)
    cuts, node, nodes = [], np.zeros(len(sample), np.int64), 1
    for k, fan in enumerate(fans):
        own = np.full((nodes, fan - 1), np.nan)
        if fan > 1:
            order = np.lexsort((sample[:, k], node))
            sorted_ = node[order]
            starts, stops = np.searchsorted(sorted_, np.arange(nodes)), np.searchsorted(sorted_, np.arange(nodes), "right")
            for n in np.flatnonzero(stops - starts > 1).tolist():
                values = sample[order[starts[n] : stops[n]], k]
                heads = values[[len(values) * j // fan for j in range(1, fan)]]  # the head of each group but the first
                heads = np.unique(heads[heads > values[0]])
                own[n, : len(heads)] = heads
            node = node * fan + (own[node] <= sample[:, k, None]).sum(1)
            nodes *= fan
        cuts.append(own)
    return Tiling(fans, cuts)
