"""Filled depressions against a flood from the edge over the whole grid."""

from heapq import heappop, heappush

import numpy as np
import pytest

from pixelseries.operators.flood import fill_depressions
from pixelseries.operators.terrain import flow_accumulation, with_neighbours, with_pointer

AROUND = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]


def plain_fill(cells):
    """``{(row, col): z}`` to filled heights."""
    heap = [(z, p) for p, z in cells.items() if any((p[0] + r, p[1] + c) not in cells for r, c in AROUND)]
    heap.sort()
    done = {}
    while heap:
        height, p = heappop(heap)
        if p in done:
            continue
        done[p] = height
        for r, c in AROUND:
            q = (p[0] + r, p[1] + c)
            if q in cells and q not in done:
                heappush(heap, (max(height, cells[q]), q))
    return done


def frame(spark, cells):
    return spark.createDataFrame([(*p, z) for p, z in cells.items()], "row int, col int, z double")


def filled(spark, cells, **sizes):
    return {(r.row, r.col): r.filled for r in fill_depressions(frame(spark, cells), **sizes).collect()}


@pytest.mark.parametrize("size, fan", [(4, 2), (8, 2), (5, 3), (128, 8)])
def test_noise_with_holes(spark, size, fan):
    rng = np.random.default_rng(size)
    z = rng.integers(0, 40, (41, 37)).astype(float)
    cells = {(r, c): float(z[r, c]) for r in range(41) for c in range(37) if rng.random() > 0.01}
    want = plain_fill(cells)
    assert filled(spark, cells, size=size, fan=fan) == want and any(want[p] > cells[p] for p in cells)


def test_a_lake_over_many_tiles_with_an_island_and_one_way_out(spark):
    r, c = np.mgrid[0:60, 0:60]
    z = 5.0 + ((r - 30) ** 2 + (c - 30) ** 2) / 50
    z[[0, -1], :] = z[:, [0, -1]] = 100
    z[1, :] = z[-2, :] = z[:, 1] = z[:, -2] = 99
    z[28:32, 28:32] = 50
    z[40, 57:60] = 31
    cells = {(i, j): float(z[i, j]) for i in range(60) for j in range(60)}
    got = filled(spark, cells, size=7, fan=2)
    assert got == plain_fill(cells)
    assert got[10, 10] == got[45, 20] == 31 and got[30, 30] == 50


def test_small_grids(spark):
    assert filled(spark, {}) == {}
    assert filled(spark, {(0, 0): 3.0}) == {(0, 0): 3.0}
    ring = {(r, c): 9.0 for r in range(3) for c in range(3)}
    assert filled(spark, {**ring, (1, 1): -4.0}) == ring
    far = {**{p: z for p, z in ring.items()}, (1, 1): 1.0, **{(r + 500, c + 900): z for (r, c), z in ring.items()}, (501, 901): 2.0}
    assert filled(spark, far, size=4, fan=2) == {p: 9.0 for p in far}
    missing = frame(spark, {**ring, (1, 1): 2.0}).unionByName(spark.createDataFrame([(0, 3, None), (5, 5, None)], "row int, col int, z double"))
    assert {r.filled for r in fill_depressions(missing).collect()} == {9.0}


def test_nothing_flows_into_a_filled_pit(spark):
    rng = np.random.default_rng(2)
    cells = {(r, c): float(100 - r - c + 3 * rng.random()) for r in range(20) for c in range(20)}
    cells[10, 10] = -50.0
    def ends(surface):
        return {(r.row, r.col): r.acc for r in flow_accumulation(with_pointer(with_neighbours(surface), 1.0, 1.0)).collect()}
    raw = ends(frame(spark, cells))
    full = fill_depressions(frame(spark, cells), size=6, fan=2)
    dry = ends(full.select("row", "col", full.filled.alias("z")))
    assert raw[10, 10] > dry[10, 10] and max(dry.values()) > max(v for p, v in raw.items() if p != (10, 10))
