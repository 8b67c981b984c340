"""Terrain features of an elevation grid ``(row, col, z)``.

Values at the border of the grid, or next to a missing cell, take the centre
value for the absent neighbour.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .raster import NEIGHBOURS, TILE, GridMeta, align_nearest, all_cells, box_statistics, resample, with_neighbours

# Direction codes of the flow pointer, as (row step, column step).
DIRECTIONS = {1: (-1, 1), 2: (0, 1), 4: (1, 1), 8: (1, 0), 16: (1, -1), 32: (0, -1), 64: (-1, -1), 128: (-1, 0)}
_DIRECTION_OF = {"ne": 1, "e": 2, "se": 4, "s": 8, "sw": 16, "w": 32, "nw": 64, "n": 128}


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.col("z"))


def _gradient(dx: float, dy: float) -> tuple[Column, Column]:
    """Eastward and northward slope, weighted over 3 x 3 cells (Horn 1981)."""
    nw, n, ne, w, e, sw, s, se = (_filled(c) for c in NEIGHBOURS)
    east = ((ne + 2 * e + se) - (nw + 2 * w + sw)) / (8 * dx)
    north = ((nw + 2 * n + ne) - (sw + 2 * s + se)) / (8 * dy)
    return east, north


def slope_degrees(dx: float, dy: float) -> Column:
    p, q = _gradient(dx, dy)
    return F.degrees(F.atan(F.sqrt(p * p + q * q)))


def aspect_degrees(dx: float, dy: float) -> Column:
    """Direction of steepest descent, clockwise from north; missing on flat cells."""
    p, q = _gradient(dx, dy)
    return F.when((p != 0) | (q != 0), F.pmod(F.degrees(F.atan2(-p, -q)), F.lit(360.0)))


def ruggedness() -> Column:
    """Root mean square difference to the neighbours that exist."""
    squares = [F.coalesce((F.col(c) - F.col("z")) * (F.col(c) - F.col("z")), F.lit(0.0)) for c in NEIGHBOURS]
    present = [F.col(c).isNotNull().cast("int") for c in NEIGHBOURS]
    return F.sqrt(F.try_divide(sum(squares[1:], squares[0]), sum(present[1:], present[0])))


def curvatures(dx: float, dy: float) -> tuple[Column, Column, Column]:
    """Plan, profile and mean curvature (Zevenbergen and Thorne 1987); zero on flat cells."""
    nw, n, ne, w, e, sw, s, se = (_filled(c) for c in NEIGHBOURS)
    z = F.col("z")
    d = ((w + e) / 2 - z) / (dx * dx)
    r = ((n + s) / 2 - z) / (dy * dy)
    f = (-nw + ne + sw - se) / (4 * dx * dy)
    g, h = (e - w) / (2 * dx), (n - s) / (2 * dy)
    steep = g * g + h * h
    plan = F.coalesce(F.try_divide(2 * (d * h * h + r * g * g - f * g * h), steep), F.lit(0.0))
    profile = F.coalesce(F.try_divide(-2 * (d * g * g + r * h * h + f * g * h), steep), F.lit(0.0))
    return plan, profile, (plan + profile) / 2


def with_pointer(around: DataFrame, dx: float, dy: float) -> DataFrame:
    """Add ``pointer``: the code of the steepest descending neighbour.

    The lowest code of equals; 0 in sinks and on flats.
    """
    drops = {}
    for code in DIRECTIONS:
        name = next(n for n, c in _DIRECTION_OF.items() if c == code)
        row, col = DIRECTIONS[code]
        drops[code] = (F.col("z") - F.col(name)) / math.hypot(dx * abs(col), dy * abs(row))
    pointer = F.lit(0)
    for code in reversed(DIRECTIONS):  # the lowest code is tested first
        pointer = F.when(drops[code] == F.col("__fall"), F.lit(code)).otherwise(pointer)
    steepest = around.withColumn("__fall", F.greatest(*drops.values()))
    return steepest.withColumn("pointer", F.when(F.col("__fall") > 0, pointer).otherwise(F.lit(0))).drop("__fall")


def surface(cells: DataFrame, dx: float, dy: float, size: int = TILE) -> DataFrame:
    """All 3 x 3 features in one pass over the neighbourhood."""
    plan, profile, mean = curvatures(dx, dy)
    return with_pointer(with_neighbours(cells, size), dx, dy).select(
        "row", "col", "z",
        slope_degrees(dx, dy).alias("slope"),
        aspect_degrees(dx, dy).alias("aspect"),
        ruggedness().alias("rugg"),
        plan.alias("plan_curv"),
        profile.alias("profile_curv"),
        mean.alias("curv"),
        "pointer",
    )


def _downstream(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tile's cells: place of the next cell in the tile (or -1), sums of ``weight`` from upstream, and the last cell of each path."""
    row, col, to_row, to_col = (np.asarray(table.column(c).fill_null(-(1 << 40)), np.int64) for c in ("row", "col", "to_row", "to_col"))
    key = (row << 32) + col
    order = np.argsort(key)
    at = np.minimum(np.searchsorted(key[order], (to_row << 32) + to_col), len(key) - 1)
    step = np.where(key[order][at] == (to_row << 32) + to_col, order[at], -1)
    total, reach, last = np.asarray(table.column("weight"), np.int64).copy(), step.copy(), np.arange(len(step))
    for _ in range(len(step).bit_length() + 1):
        moving = np.flatnonzero(reach >= 0)
        if not len(moving):
            return step, total, last
        np.add.at(total, reach[moving], total[moving].copy())
        last[moving] = last[reach[moving]]
        reach[moving] = reach[reach[moving]]
    raise RuntimeError("flow paths did not end; the pointers contain a cycle")


def _tile_paths(table: pa.Table) -> pa.Table:
    """Per cell the last cell of its path in the tile; for these the sum of what comes through."""
    _, total, last = _downstream(table)
    row, col = table.column("row").combine_chunks(), table.column("col").combine_chunks()
    end = pa.array(last)
    moves = table.select(["row", "col", "to_row", "to_col"])
    return moves.append_column("end_row", row.take(end)).append_column("end_col", col.take(end)).append_column("acc", pa.array(total))


def _tile_sums(table: pa.Table) -> pa.Table:
    return table.select(["row", "col"]).append_column("acc", pa.array(_downstream(table)[1]))


def _graph_sums(nodes: DataFrame, max_rounds: int) -> DataFrame:
    """``cell, acc`` of a graph ``cell, next, acc``: what comes through each node.

    Each round doubles the distance a node looks downstream. Finished nodes leave
    the table that is rewritten; what reaches them is added up at the end.
    """
    moving, gains = cut_lineage(nodes.filter(F.col("next").isNotNull())), nodes.select("cell", "acc")
    for _ in range(max_rounds):
        if moving.isEmpty():
            return gains.groupBy("cell").agg(F.sum("acc").alias("acc"))
        arriving = cut_lineage(moving.groupBy(F.col("next").alias("cell")).agg(F.sum("acc").alias("acc")))
        gains = gains.unionByName(arriving)
        onward = moving.select(F.col("cell").alias("__via"), F.col("next").alias("__far"))
        added = arriving.withColumnRenamed("acc", "__gain")
        moving = cut_lineage(
            moving.join(added, "cell", "left")
            .join(onward, F.col("next") == F.col("__via"))
            .select("cell", F.col("__far").alias("next"), (F.col("acc") + F.coalesce("__gain", F.lit(0))).alias("acc"))
        )
    raise RuntimeError("flow paths did not end; the pointers contain a cycle")


def flow_accumulation(pointers: DataFrame, max_rounds: int = 64, size: int = TILE) -> DataFrame:
    """Number of cells that drain through each cell, itself included.

    ``pointers(row, col, pointer)`` as from :func:`with_pointer`. Paths are first
    followed inside tiles; only the cells where water leaves a tile take part in the
    rounds over the whole grid, whose number is the logarithm of the tiles on the
    longest path. What enters a tile is then sent down its paths once more.
    """
    dr, dc = F.lit(0), F.lit(0)
    for code, (r, c) in DIRECTIONS.items():
        dr = F.when(F.col("pointer") == code, F.lit(r)).otherwise(dr)
        dc = F.when(F.col("pointer") == code, F.lit(c)).otherwise(dc)

    def tile(c: str) -> Column:
        return F.floor(F.col(c) / size).cast("int")

    def goes(moved: Column) -> Column:
        return F.when(F.col("pointer") != 0, moved).cast("long")

    cells = pointers.select(
        F.col("row").cast("long").alias("row"),
        F.col("col").cast("long").alias("col"),
        goes(F.col("row") + dr).alias("to_row"),
        goes(F.col("col") + dc).alias("to_col"),
        tile("row").alias("tr"),
        tile("col").alias("tc"),
    )
    place = "row long, col long"
    paths = cut_lineage(
        cells.withColumn("weight", F.lit(1).cast("long")).groupBy("tr", "tc").applyInArrow(_tile_paths, f"{place}, to_row long, to_col long, end_row long, end_col long, acc long")
    )
    cell, to, end = F.struct("row", "col"), F.struct(F.col("to_row").alias("row"), F.col("to_col").alias("col")), F.struct(F.col("end_row").alias("row"), F.col("end_col").alias("col"))
    leaving = paths.filter((cell == end) & F.col("to_row").isNotNull()).select(cell.alias("cell"), to.alias("to"), "acc")
    entered = paths.select(cell.alias("to"), end.alias("end")).join(leaving.select("to").distinct(), "to", "left_semi")
    following = entered.join(leaving.select(F.col("cell").alias("end")), "end", "left_semi").select("to", F.col("end").alias("next"))
    nodes = leaving.join(following, "to", "left").select("cell", "next", "acc")
    through = _graph_sums(nodes, max_rounds).select("cell", F.col("acc").alias("through"))
    inflow = leaving.join(through, "cell").groupBy("to").agg(F.sum("through").alias("inflow")).select("to.row", "to.col", "inflow")
    fed = cells.join(inflow, ["row", "col"], "left").withColumn("weight", F.lit(1).cast("long") + F.coalesce("inflow", F.lit(0)))
    found = fed.select("tr", "tc", "row", "col", "to_row", "to_col", "weight").groupBy("tr", "tc").applyInArrow(_tile_sums, f"{place}, acc long")
    kinds = dict(pointers.dtypes)
    return found.select(F.col("row").cast(kinds["row"]), F.col("col").cast(kinds["col"]), "acc")


def wetness(slopes: DataFrame, accumulation: DataFrame) -> DataFrame:
    """``ln(catchment / tan(slope))``; missing on flat cells."""
    index = F.ln(F.try_divide(F.col("acc").cast("double"), F.tan(F.radians("slope"))))
    return slopes.join(accumulation, ["row", "col"]).select("row", "col", index.alias("twi"))


def relative_position(cells: DataFrame, filter_x: int = 11, filter_y: int = 11, size: int = TILE) -> DataFrame:
    """Position between box minimum (-1), box mean (0) and box maximum (1)."""
    box = box_statistics(cells, filter_x, filter_y, size)
    above = F.col("z") - F.col("mean")
    reach = F.when(above < 0, F.col("mean") - F.col("z_min")).otherwise(F.col("z_max") - F.col("mean"))
    return box.select("row", "col", F.coalesce(F.try_divide(above, reach), F.lit(0.0)).alias("rtp"))


def deviation(cells: DataFrame, filter_x: int = 11, filter_y: int = 11, size: int = TILE) -> DataFrame:
    """Difference to the box mean in box standard deviations; 0 where the box is flat."""
    box = box_statistics(cells, filter_x, filter_y, size)
    return box.select("row", "col", F.coalesce(F.try_divide(F.col("z") - F.col("mean"), F.col("sd")), F.lit(0.0)).alias("dev"))


FEATURES = ("slope", "northing", "easting", "rugg", "curv", "twi")


def terrain_features(cells: DataFrame, meta: GridMeta, wanted=FEATURES, size: int = TILE) -> DataFrame:
    """The static terrain bands of one elevation grid."""
    base = surface(cells, meta.dx, meta.dy, size).withColumns({"northing": F.cos(F.radians("aspect")), "easting": F.sin(F.radians("aspect"))})
    if "twi" in wanted:
        base = cut_lineage(base)  # read three times below
        twi = wetness(base, flow_accumulation(base))
        base = base.join(twi, ["row", "col"], "left")
    return base.select("row", "col", *wanted)


def multi_resolution(cells: DataFrame, meta: GridMeta, factors: dict[str, float], wanted=FEATURES, size: int = TILE) -> DataFrame:
    """Terrain bands at several resolutions on the cells of the finest grid.

    ``factors`` maps the band suffix to the cell size relative to ``meta``;
    a factor of 1 uses the grid as it is.
    """
    result = all_cells(cells.sparkSession, meta)
    for suffix, factor in factors.items():
        dem, dem_meta = (cells, meta) if factor == 1 else resample(cells, meta, meta.dx * factor, meta.dy * factor)
        bands = terrain_features(dem, dem_meta, wanted, size)
        named = bands.select("row", "col", *[F.col(b).alias(f"{b}_{suffix}") for b in wanted])
        result = align_nearest(named, dem_meta, result, meta, [f"{b}_{suffix}" for b in wanted])
    return result
