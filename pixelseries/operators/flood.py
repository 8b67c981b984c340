"""Depressions filled: every cell is raised to where its water can leave the grid.

A cell's filled height is the lowest, over all ways to the edge, of the highest cell
on the way. Inside a tile the ways between its border cells are reduced to a spanning
tree of least heights; tiles are joined to larger ones, which keep only their own
border, until one is left. From there the heights go back down to the cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .raster import TILE, tiled

#: Tiles that one of the next level is wide and high.
FAN = 8
#: The end of a way that leaves the grid, and of a row that holds a known height.
OUTSIDE, KNOWN = -1, -2
EDGE = "tr int, tc int, a long, b long, height double"


def _key(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    return (row.astype(np.int64) << 32) + col


class _Tile:
    """A tile and its halo as a square of heights, NaN where there is no cell."""

    def __init__(self, table: pa.Table, size: int):
        row, col, z, self.tr, self.tc = (table.column(c).to_numpy() for c in ("row", "col", "z", "tr", "tc"))
        self.tr, self.tc, self.size = int(self.tr[0]), int(self.tc[0]), size
        self.z = np.full((size + 2, size + 2), np.nan)
        self.z[row - self.tr * size + 1, col - self.tc * size + 1] = z
        rows, cols = np.meshgrid(np.arange(-1, size + 1) + self.tr * size, np.arange(-1, size + 1) + self.tc * size, indexing="ij")
        self.keys = _key(rows, cols)
        self.own = ~np.isnan(self.z)
        self.own[[0, -1], :] = self.own[:, [0, -1]] = False

    def shifted(self, dr: int, dc: int) -> np.ndarray:
        """The neighbour of each inner position."""
        n = self.size
        return self.z[1 + dr : n + 1 + dr, 1 + dc : n + 1 + dc]

    def outlets(self) -> np.ndarray:
        """Own cells with an absent neighbour."""
        open_ = np.zeros((self.size, self.size), bool)
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                open_ |= np.isnan(self.shifted(dr, dc))
        found = np.zeros_like(self.own)
        found[1:-1, 1:-1] = open_
        return found & self.own

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both ends, the higher end's height, and whether both are own, of each pair of neighbours (one end own)."""
        n, places = self.size + 2, np.arange((self.size + 2) ** 2).reshape(self.size + 2, -1)
        parts = []
        for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
            here = (slice(0, n - dr), slice(max(0, -dc), n - max(0, dc)))
            there = (slice(dr, n), slice(max(0, dc), n - max(0, -dc)))
            height = np.maximum(self.z[here], self.z[there])
            fits = ~np.isnan(height) & (self.own[here] | self.own[there])
            parts.append((places[here][fits], places[there][fits], height[fits], (self.own[here] & self.own[there])[fits]))
        return tuple(np.concatenate(p) for p in zip(*parts))


def _spanning(a: np.ndarray, b: np.ndarray, height: np.ndarray, kept: np.ndarray) -> list[tuple[int, int, float]]:
    """The least heights between ``kept`` nodes: at most one edge less than there are of these.

    Nodes are numbers from 0. Joined from the lowest edge on, two groups that both have a kept
    node get an edge between these; others only grow together.
    """
    up, keeps = list(range(len(kept))), [i if k else -1 for i, k in enumerate(kept.tolist())]
    found, order = [], np.argsort(height, kind="stable")
    for x, y, h in zip(a[order].tolist(), b[order].tolist(), height[order].tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            if keeps[x] >= 0 and keeps[y] >= 0:
                found.append((keeps[x], keeps[y], h))
            up[y] = x
            keeps[x] = keeps[x] if keeps[x] >= 0 else keeps[y]
    return found


def _flooded(links: dict[int, list[tuple[int, float]]], sources: Iterable[tuple[float, int]]) -> dict[int, float]:
    """The filled height of each node that the sources reach."""
    heap, done = list(sources), {}
    heapify(heap)
    while heap:
        height, node = heappop(heap)
        if node not in done:
            done[node] = height
            for other, least in links.get(node, ()):
                if other not in done:
                    heappush(heap, (max(height, least), other))
    return done


def _table(tr: int, tc: int, a: Iterable[int], b: Iterable[int], height: Iterable[float]) -> pa.Table:
    a = np.asarray(a, np.int64)
    return pa.table([pa.array(np.full(len(a), tr, np.int32)), pa.array(np.full(len(a), tc, np.int32)), pa.array(a), pa.array(np.asarray(b, np.int64)), pa.array(np.asarray(height, np.float64))], names=["tr", "tc", "a", "b", "height"])


def _tile_edges(size: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        """Least heights between a tile's border cells and to the outside, and its edges to the tiles east and south."""
        tile = _Tile(table, size)
        a, b, height, inside = tile.edges()
        outlets = np.flatnonzero(tile.outlets())
        border = np.zeros(tile.own.shape, bool)
        border[1:-1, [1, -2]] = border[[1, -2], 1:-1] = True
        outside = tile.own.size  # the number after the cells'
        kept = np.r_[(border & tile.own).ravel(), True]
        ends = [np.r_[x[inside], y] for x, y in ((a, outlets), (b, np.full(len(outlets), outside)))]
        tree = _spanning(*ends, np.r_[height[inside], tile.z.ravel()[outlets]], kept)
        keys = np.r_[tile.keys.ravel(), OUTSIDE]
        first, second, least = (np.array(x, t) for x, t in zip(zip(*tree), (np.int64, np.int64, float))) if tree else ([np.empty(0, np.int64)] * 2 + [np.empty(0)])
        crossing = ~inside & tile.own.ravel()[a]  # the other end's tile leaves this pair out
        a, b, height = a[crossing], b[crossing], height[crossing]
        return _table(tile.tr, tile.tc, keys[np.r_[first, a]], keys[np.r_[second, b]], np.r_[least, height])

    return run


def _numbered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, b, height = (table.column(c).to_numpy() for c in ("a", "b", "height"))
    names, at = np.unique(np.r_[a, b], return_inverse=True)
    return names, at[: len(a)], at[len(a) :], height


def _contracted(side: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        """The least heights between the border cells of a larger tile."""
        names, a, b, height = _numbered(table)
        row, col = names >> 32, names & 0xFFFFFFFF
        kept = (names == OUTSIDE) | np.isin(row % side, (0, side - 1)) | np.isin(col % side, (0, side - 1))
        tree = _spanning(a, b, height, kept)
        first, second, least = zip(*tree) if tree else ((), (), ())
        return _table(0, 0, names[list(first)] if first else [], names[list(second)] if second else [], least)

    return run


def _descended(table: pa.Table) -> pa.Table:
    """The filled heights of a larger tile's nodes, from the known ones and the outside."""
    links: dict[int, list[tuple[int, float]]] = {}
    sources = []
    for a, b, height in zip(*(table.column(c).to_pylist() for c in ("a", "b", "height"))):
        if b == KNOWN:
            sources.append((height, a))
        elif OUTSIDE in (a, b):
            sources.append((height, b if a == OUTSIDE else a))
        else:
            links.setdefault(a, []).append((b, height))
            links.setdefault(b, []).append((a, height))
    found = _flooded(links, sources)
    return pa.table([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.float64())], names=["cell", "height"])


def _filled(size: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        """A tile's cells with their filled heights; the border's are known."""
        cells = table.filter(pa.compute.invert(pa.compute.is_null(table.column("z"))))
        known = table.filter(pa.compute.is_valid(table.column("height")))
        tile = _Tile(cells, size)
        width, z = size + 2, tile.z.ravel()
        own = np.flatnonzero(tile.own)
        at = {int(k): int(p) for k, p in zip(tile.keys.ravel()[own], own)}
        heap = [(h, at[k]) for k, h in zip(known.column("cell").to_pylist(), known.column("height").to_pylist())]
        heap += [(float(z[p]), int(p)) for p in np.flatnonzero(tile.outlets())]
        heapify(heap)
        level, inner, heights = np.full(z.shape, np.nan), tile.own.ravel().tolist(), z.tolist()
        around = [dr * width + dc for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
        done = [False] * len(heights)
        while heap:
            height, p = heappop(heap)
            if done[p]:
                continue
            done[p], level[p] = True, height
            for step in around:
                q = p + step
                if inner[q] and not done[q]:
                    heappush(heap, (max(height, heights[q]), q))
        keys = tile.keys.ravel()[own]
        return pa.table([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(z[own]), pa.array(level[own])], names=["row", "col", "z", "filled"])

    return run


def _tile_of(node: Column, side: int) -> tuple[Column, Column]:
    return F.floor(F.shiftright(node, 32) / side).cast("int"), F.floor(node.bitwiseAND(F.lit(0xFFFFFFFF)) / side).cast("int")


def fill_depressions(cells: DataFrame, size: int = TILE, fan: int = FAN) -> DataFrame:
    """``row, col, z, filled``: the surface on which all water can leave.

    Rows and columns are not negative. Missing cells may be absent or NULL; a cell with
    an absent neighbour among its eight, as at the edge of the grid, is an outlet and keeps its
    height. Depressions become level: ``filled`` equals the height of their lowest way out.

    A task holds one tile, or the borders of ``fan`` x ``fan`` tiles of the level below; the
    number of levels is the logarithm of the grid's side. The last level's one task holds
    borders alone, which grow with the side of the grid, not its area.
    """
    known = cells.filter(F.col("z").isNotNull()).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("z").cast("double").alias("z"))
    halo = tiled(known, 1, size)
    # A halo without a cell of the tile's own is no tile.
    halo = cut_lineage(halo.join(known.select(F.floor(F.col("row") / size).cast("int").alias("tr"), F.floor(F.col("col") / size).cast("int").alias("tc")).distinct(), ["tr", "tc"], "left_semi"))
    edges = [cut_lineage(halo.groupBy("tr", "tc").applyInArrow(_tile_edges(size), EDGE))]
    reach = known.agg(F.greatest(F.max("row"), F.max("col"))).first()[0] or 0
    sides = [size]
    while True:
        side = sides[-1] * fan
        ends = edges[-1].withColumns({"a": F.when(F.col("a") < 0, F.col("b")).otherwise(F.col("a")), "b": F.when(F.col("a") < 0, F.col("a")).otherwise(F.col("b"))})
        (ar, ac), (br, bc) = _tile_of(F.col("a"), side), _tile_of(F.col("b"), side)
        ends = ends.withColumns({"tr": ar, "tc": ac, "within": (F.col("b") == OUTSIDE) | ((ar == br) & (ac == bc))})
        edges[-1] = cut_lineage(ends)
        sides.append(side)
        if side > reach:
            break
        joined = edges[-1].filter("within").drop("within").groupBy("tr", "tc").applyInArrow(_contracted(side), EDGE)
        edges.append(cut_lineage(joined.unionByName(edges[-1].filter("not within").drop("within"))))
    levels = None
    for found, side in zip(reversed(edges), reversed(sides)):
        rows = found.filter("within").select("tr", "tc", "a", "b", "height")
        if levels is not None:
            tr, tc = _tile_of(F.col("cell"), side)
            rows = rows.unionByName(levels.select(tr.alias("tr"), tc.alias("tc"), F.col("cell").alias("a"), F.lit(KNOWN).cast("long").alias("b"), "height"))
        levels = cut_lineage(rows.groupBy("tr", "tc").applyInArrow(_descended, "cell long, height double"))
    tr, tc = _tile_of(F.col("cell"), size)
    none = lambda kind: F.lit(None).cast(kind)
    rows = halo.select("tr", "tc", "row", "col", "z", none("long").alias("cell"), none("double").alias("height"))
    rows = rows.unionByName(levels.select(tr.alias("tr"), tc.alias("tc"), none("int").alias("row"), none("int").alias("col"), none("double").alias("z"), "cell", "height"))
    return rows.groupBy("tr", "tc").applyInArrow(_filled(size), "row int, col int, z double, filled double")
