"""Grid operators on cell tables ``(row, col, z)``; missing cells are NULL or absent.

All grids share one coordinate system.  Row 0 is the northern edge.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import NODATA, cell_centre, cell_index, to_missing

TILE = 128  # cells per tile side: 16k cells fit any task, halos of a few cells cost a few percent


@dataclass(frozen=True)
class GridMeta:
    """Upper-left corner, cell size (both positive) and size in cells of a grid."""

    ulx: float
    uly: float
    dx: float
    dy: float
    width: int
    height: int

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        return self.ulx, self.uly - self.height * self.dy, self.ulx + self.width * self.dx, self.uly

    def resized(self, dx: float, dy: float) -> GridMeta:
        """Same corner, other cell size; a partial last row or column is cut."""
        return GridMeta(self.ulx, self.uly, dx, dy, int(self.width * self.dx / dx), int(self.height * self.dy / dy))

    def snapped(self, dx: float, dy: float) -> GridMeta:
        """Box grown outward to multiples of the new cell size."""
        x0, y0, x1, y1 = self.bbox
        left, top = math.floor(x0 / dx), math.ceil(y1 / dy)
        return GridMeta(left * dx, top * dy, dx, dy, math.ceil(x1 / dx) - left, top - math.floor(y0 / dy))


def all_cells(spark: SparkSession, meta: GridMeta) -> DataFrame:
    """Every ``(row, col)`` of a grid, generated in parallel."""
    cells = spark.range(meta.width * meta.height)
    return cells.select(F.expr(f"cast(id div {meta.width} as int)").alias("row"), F.expr(f"cast(id % {meta.width} as int)").alias("col"))


def grid_summary(points: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Bounds, size in cells and step of a regular grid given by its cell centres."""
    # the distinct coordinates of a grid axis are few, the cells are not: reduce each axis first
    def axis(c: str, p: str) -> DataFrame:
        low, high, n = F.min(c), F.max(c), F.count("*")
        step = F.try_divide(high - low, n - 1)
        return points.select(c).distinct().agg(F.struct(low.alias(f"min_{p}"), high.alias(f"max_{p}"), n.alias(f"n_{p}"), step.alias(f"step_{p}")).alias(p))

    return axis(x, "x").withColumn("y", axis(y, "y").scalar()).select("x.*", "y.*")


# --- neighbourhoods ----------------------------------------------------------

def tiled(cells: DataFrame, radius: int, size: int = TILE) -> DataFrame:
    """Cells sorted into square tiles, copied into the neighbouring tiles they border on.

    One shuffle brings a tile and its halo of ``radius`` cells together; every
    window by ``(tr, tc, ...)`` after it runs without another one.  A tile is
    bounded by ``(size + 2 * radius)^2`` cells.
    """
    def spans(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - radius) / size).cast("int"), F.floor((F.col(c) + radius) / size).cast("int"))

    return (
        cells.withColumn("tr", F.explode(spans("row")))
        .withColumn("tc", F.explode(spans("col")))
        .repartition("tr", "tc")
    )


def in_core(size: int = TILE) -> Column:
    """True for the cells a tile owns, false for its halo."""
    return (F.floor(F.col("row") / size) == F.col("tr")) & (F.floor(F.col("col") / size) == F.col("tc"))


NEIGHBOURS = ("nw", "n", "ne", "w", "e", "sw", "s", "se")


def with_neighbours(cells: DataFrame, size: int = TILE) -> DataFrame:
    """``z`` plus the eight adjacent values of every non-missing cell; absent neighbours are NULL."""
    known = cells.filter(F.col("z").isNotNull()).select("row", "col", "z")
    place = F.array(
        *[
            F.struct((F.col("row") + d).alias("row"), *[(F.col("z") if d == e else F.lit(None).cast("double")).alias(n) for e, n in ((1, "n"), (0, "z"), (-1, "s"))])
            for d in (1, 0, -1)
        ]
    )
    columns = (
        tiled(known, 1, size)
        .select("tr", "tc", "col", F.inline(place))
        .groupBy("tr", "tc", "row", "col")
        .agg(*[F.max(c).alias(c) for c in ("n", "z", "s")])
    )
    w = Window.partitionBy("tr", "tc", "row").orderBy("col")
    side = F.struct("col", "n", "z", "s")
    west, east = F.lag(side).over(w), F.lead(side).over(w)
    placed = columns.withColumns({"__w": west, "__e": east}).filter(F.col("z").isNotNull() & in_core(size))

    def beside(name: str, offset: int, field: str) -> Column:
        return F.when(F.col(f"{name}.col") == F.col("col") + offset, F.col(f"{name}.{field}"))

    return placed.select(
        "row", "col", "z", "n", "s",
        *[beside("__w", -1, f).alias(a) for f, a in (("n", "nw"), ("z", "w"), ("s", "sw"))],
        *[beside("__e", 1, f).alias(a) for f, a in (("n", "ne"), ("z", "e"), ("s", "se"))],
    )


def _sliding_sum(a: np.ndarray, radius: int, first: int, n: int) -> np.ndarray:
    """Sums over ``radius`` rows up and down of the rows ``first .. first + n - 1``, from running sums."""
    upto = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
    return upto[first + radius + 1 : first + radius + 1 + n] - upto[first - radius : first - radius + n]


def _sliding_extreme(a: np.ndarray, radius: int, first: int, n: int, least: bool) -> np.ndarray:
    """Least or greatest over the same rows: two running extremes, forth and back in blocks as wide as the window, meet in any window."""
    pick, width = (np.minimum if least else np.maximum), 2 * radius + 1
    blocks = np.concatenate([a, np.full((-len(a) % width, *a.shape[1:]), np.inf if least else -np.inf)]).reshape(-1, width, *a.shape[1:])
    forth = pick.accumulate(blocks, axis=1).reshape(-1, *a.shape[1:])
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1, *a.shape[1:])
    return pick(back[first - radius : first - radius + n], forth[first + radius : first + radius + n])


def _tile_boxes(rx: int, ry: int, halo: int, size: int):
    def run(table: pa.Table) -> pa.Table:
        """The box statistics of one tile's own cells."""
        row, col, z, tr, tc = (table.column(c).to_numpy() for c in ("row", "col", "z", "tr", "tc"))
        at, values = (row - int(tr[0]) * size + halo, col - int(tc[0]) * size + halo), np.full((size + 2 * halo,) * 2, np.nan)
        values[at] = z
        base, known = z.min(), ~np.isnan(values)
        above = np.where(known, values - base, 0.0)

        def boxes(a: np.ndarray, along, across) -> np.ndarray:
            return across(along(a.T, rx).T, ry)

        total = lambda a, r: _sliding_sum(a, r, halo, size)
        n, s, q = (boxes(a, total, total) for a in (known.astype(float), above, above * above))
        low, high = (boxes(np.where(known, values, f), *[lambda a, r, f=f: _sliding_extreme(a, r, halo, size, f > 0)] * 2) for f in (np.inf, -np.inf))
        own = known[halo : halo + size, halo : halo + size]
        n, s, q, low, high = (a[own] for a in (n, s, q, low, high))
        mean, flat = s / n, low == high
        sd = np.where(flat, 0.0, np.sqrt(np.maximum(q / n - mean * mean, 0.0)))
        rows, cols = np.nonzero(own)
        columns = {"row": (rows + int(tr[0]) * size).astype(np.int32), "col": (cols + int(tc[0]) * size).astype(np.int32), "z": values[halo : halo + size, halo : halo + size][own]}
        return pa.table(columns | {"n": np.rint(n).astype(np.int64), "mean": np.where(flat, low, base + mean), "sd": sd, "z_min": low, "z_max": high})

    return run


def box_statistics(cells: DataFrame, filter_x: int, filter_y: int, size: int = TILE) -> DataFrame:
    """Count, mean, standard deviation, min and max of ``z`` in a box around each cell.

    The box is separable: first along the row, then along the column, each with running
    sums and extremes, so the work for a cell does not grow with the box; the
    halo that tiles share does. Heights count from the tile's lowest, so that
    squares of high, flat ground do not cancel; a box without any difference is flat exactly.
    """
    if filter_x % 2 == 0 or filter_y % 2 == 0:
        raise ValueError("filter sizes must be odd")
    rx, ry = filter_x // 2, filter_y // 2
    known = cells.filter(F.col("z").isNotNull()).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("z").cast("double").alias("z"))
    halo = max(rx, ry)
    run = _tile_boxes(rx, ry, halo, size)
    return tiled(known, halo, size).groupBy("tr", "tc").applyInArrow(run, "row int, col int, z double, n long, mean double, sd double, z_min double, z_max double")


#: Row and column steps in which fills look for a valid cell: there and back along rows, columns and both diagonals.
LINES = (((0, -1), (0, 1)), ((-1, 0), (1, 0)), ((-1, -1), (1, 1)), ((-1, 1), (1, -1)))


def _tile_fill(max_distance: int, size: int):
    def run(table: pa.Table) -> pa.Table:
        """The cells a tile owns, the missing ones filled."""
        row, col, tr, tc = (table.column(c).to_numpy() for c in ("row", "col", "tr", "tc"))
        held = table.column("z").is_valid().to_numpy(zero_copy_only=False)
        z = table.column("z").fill_null(0.0).to_numpy()
        # Of several rows of a cell the largest value counts: it is written last.
        order = np.lexsort((z, held))
        top, left = int(tr[0]) * size - max_distance, int(tc[0]) * size - max_distance
        at, side = (row[order] - top, col[order] - left), size + 2 * max_distance
        values, known, present = np.zeros((side, side)), np.zeros((side, side), bool), np.zeros((side, side), bool)
        values[at], known[at], present[at] = z[order], held[order], True
        own = np.zeros((side, side), bool)
        own[max_distance : max_distance + size, max_distance : max_distance + size] = True
        holes = np.nonzero(own & present & ~known)
        above, below = np.zeros(len(holes[0])), np.zeros(len(holes[0]))
        for steps in LINES:
            for down, across in steps:
                unit = math.sqrt(2) if down and across else 1.0
                part, weight, left_over = np.zeros(len(above)), np.zeros(len(above)), np.arange(len(above))
                for step in range(1, int(max_distance / unit) + 1):
                    there = holes[0][left_over] + step * down, holes[1][left_over] + step * across
                    hit = known[there]
                    weight[left_over[hit]] = 1.0 / (step * unit)
                    part[left_over[hit]] = 1.0 / (step * unit) * values[there][hit]
                    left_over = left_over[~hit]
                above, below = above + part, below + weight
        filled = known.copy()
        filled[holes] = below > 0
        values[holes] = above / np.where(below > 0, below, 1.0)
        rows, cols = np.nonzero(own & present)
        columns = [(rows + top).astype(np.int32), (cols + left).astype(np.int32), pa.array(values[rows, cols], mask=~filled[rows, cols]), ~known[rows, cols]]
        return pa.table(columns, names=["row", "col", "z", "was_missing"])

    return run


def fill_nodata(cells: DataFrame, max_distance: int = 10, size: int = TILE) -> DataFrame:
    """Fill missing cells from the nearest valid cell in each of eight directions.

    Inverse-distance weights; cells with no valid cell within ``max_distance``
    in any direction stay missing.  Cells to fill are rows with a NULL ``z``.
    Rows are sorted by tile once and a tile is filled at a time, so a task holds
    one sort of its narrow rows and a single tile besides.
    """
    rows = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("z").cast("double").alias("z"))
    run = _tile_fill(max_distance, size)
    return tiled(rows, max_distance, size).groupBy("tr", "tc").applyInArrow(run, "row int, col int, z double, was_missing boolean")


# --- resampling and alignment ------------------------------------------------

def _centres(target: DataFrame, meta: GridMeta) -> tuple[Column, Column]:
    return cell_centre("col", meta.ulx, meta.dx), cell_centre("row", meta.uly, -meta.dy)


def _needed(source_meta: GridMeta, target_meta: GridMeta, margin: float) -> Column:
    """True for source cells some target centre reads; ``margin`` is half a cell for bilinear.

    A narrow test before the join: coarsening by ``k`` shuffles ``1/k^2`` (or
    ``4/k^2``) of the source instead of all of it.
    """
    def axis(c: str, offset: float, source: float, target: float, n: int) -> Column:
        first = ((F.col(c) - margin) * source - offset) / target - 0.5
        last = ((F.col(c) + 1 + margin) * source - offset) / target - 0.5
        return F.ceil(F.greatest(first - 1e-6, F.lit(0.0))) <= F.least(last + 1e-6, F.lit(float(n - 1)))

    a, b = source_meta, target_meta
    return axis("col", b.ulx - a.ulx, a.dx, b.dx, b.width) & axis("row", a.uly - b.uly, a.dy, b.dy, b.height)


def align_nearest(source: DataFrame, source_meta: GridMeta, target: DataFrame, target_meta: GridMeta, bands: Sequence[str] = ("z",)) -> DataFrame:
    """Value of the source cell under each target cell centre; NULL outside the source.

    ``target`` is a table of ``row, col`` (other columns are kept).
    """
    x, y = _centres(target, target_meta)
    looked_up = target.withColumns(
        {"__c": cell_index(x, source_meta.ulx, source_meta.dx), "__r": F.floor((F.lit(source_meta.uly) - y) / source_meta.dy).cast("bigint")}
    )
    read = source.filter(_needed(source_meta, target_meta, 0.0))
    layer = read.select(F.col("row").cast("bigint").alias("__r"), F.col("col").cast("bigint").alias("__c"), *bands)
    return looked_up.join(layer, ["__r", "__c"], "left").drop("__r", "__c")


def align_bilinear(source: DataFrame, source_meta: GridMeta, target: DataFrame, target_meta: GridMeta) -> DataFrame:
    """Distance-weighted mean of the up to four valid source cells around each target cell centre."""
    x, y = _centres(target, target_meta)
    corners = F.array(
        *[
            F.struct(
                (F.col("__c0") + j).alias("__c"),
                (F.col("__r0") + i).alias("__r"),
                ((F.col("__fx") if j else 1 - F.col("__fx")) * (F.col("__fy") if i else 1 - F.col("__fy"))).alias("__w"),
            )
            for i in (0, 1)
            for j in (0, 1)
        ]
    )
    corner_rows = (
        target.select("row", "col", ((x - source_meta.ulx) / source_meta.dx - 0.5).alias("__x"), ((F.lit(source_meta.uly) - y) / source_meta.dy - 0.5).alias("__y"))
        .withColumns({"__c0": F.floor("__x").cast("bigint"), "__r0": F.floor("__y").cast("bigint")})
        .withColumns({"__fx": F.col("__x") - F.col("__c0"), "__fy": F.col("__y") - F.col("__r0")})
        .select("row", "col", F.inline(corners))
    )
    read = source.filter(F.col("z").isNotNull() & _needed(source_meta, target_meta, 0.5))
    layer = read.select(F.col("row").cast("bigint").alias("__r"), F.col("col").cast("bigint").alias("__c"), "z")
    return (
        corner_rows.join(layer, ["__r", "__c"], "left")
        .groupBy("row", "col")
        .agg(F.try_divide(F.sum(F.col("__w") * F.col("z")), F.sum(F.when(F.col("z").isNotNull(), F.col("__w")))).alias("z"))
    )


def align(source: DataFrame, source_meta: GridMeta, target: DataFrame, target_meta: GridMeta, method: str = "bilinear") -> DataFrame:
    """Source values on the cells of the target grid."""
    if method == "near":
        return align_nearest(source, source_meta, target.select("row", "col"), target_meta)
    if method == "bilinear":
        return align_bilinear(source, source_meta, target, target_meta)
    raise ValueError("method must be 'near' or 'bilinear'")


def align_uncropped(source: DataFrame, source_meta: GridMeta, dx: float, dy: float, method: str = "bilinear") -> tuple[DataFrame, GridMeta]:
    """Align to another cell size on the whole source box, grown outward to whole target cells."""
    meta = source_meta.snapped(dx, dy)
    return align(source, source_meta, all_cells(source.sparkSession, meta), meta, method), meta


def resample(source: DataFrame, source_meta: GridMeta, dx: float, dy: float | None = None, method: str = "bilinear") -> tuple[DataFrame, GridMeta]:
    """Same corner, new cell size, ``int(old_size * old_cell / new_cell)`` cells."""
    meta = source_meta.resized(dx, dx if dy is None else dy)
    return align(source, source_meta, all_cells(source.sparkSession, meta), meta, method), meta


def coarsen_sum(source: DataFrame, source_meta: GridMeta, dx: float, dy: float | None = None) -> tuple[DataFrame, GridMeta]:
    """Sum per coarser cell; a cell on a border is split by overlap."""
    meta = source_meta.resized(dx, dx if dy is None else dy)
    kx, ky = meta.dx / source_meta.dx, meta.dy / source_meta.dy

    def covered(c: str, k: float) -> Column:
        return F.sequence(F.floor(F.col(c) / k + 1e-9).cast("int"), (F.ceil((F.col(c) + 1) / k - 1e-9) - 1).cast("int"))

    def overlap(c: str, t: str, k: float) -> Column:
        return F.least((F.col(t) + 1) * F.lit(k), F.col(c) + 1.0) - F.greatest(F.col(t) * F.lit(k), F.col(c) + 0.0)

    spread = (
        source.filter(F.col("z").isNotNull())
        .withColumn("__r", F.explode(covered("row", ky)))
        .withColumn("__c", F.explode(covered("col", kx)))
        .filter((F.col("__r") < meta.height) & (F.col("__c") < meta.width))
        .withColumn("__w", overlap("row", "__r", ky) * overlap("col", "__c", kx))
    )
    total = F.sum(F.col("z") * F.col("__w")).alias("z")
    return spread.groupBy(F.col("__r").alias("row"), F.col("__c").alias("col")).agg(total), meta


def rescale01(cells: DataFrame, value: str = "z") -> DataFrame:
    """``(v - min) / (max - min)`` over the whole raster."""
    ends = cells.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    return cells.withColumn(value, F.try_divide(F.col(value) - ends["lo"], ends["hi"] - ends["lo"]))


def coarsen_rescale(source: DataFrame, source_meta: GridMeta, dx: float, dy: float | None = None) -> tuple[DataFrame, GridMeta]:
    """Share maps: sum to coarser cells, then rescale to 0..1."""
    cells, meta = coarsen_sum(source, source_meta, dx, dy)
    return rescale01(cells), meta


def mosaic(tiles: DataFrame, tile: str = "tile_id") -> DataFrame:
    """One raster from overlapping tiles: the first tile (by id) with a value wins."""
    return tiles.filter(F.col("z").isNotNull()).groupBy("row", "col").agg(F.min_by("z", tile).alias("z"))


def crop_to_valid(cells: DataFrame) -> DataFrame:
    """Cut fully missing border rows and columns and renumber; interior ones stay.

    Adds ``row0, col0``, the position of the new corner in the old grid.
    """
    valid = cells.filter(F.col("z").isNotNull())
    box = valid.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))])).scalar()
    inside = F.col("row").between(box["lo_row"], box["hi_row"]) & F.col("col").between(box["lo_col"], box["hi_col"])
    return cells.filter(inside).select(
        (F.col("row") - box["lo_row"]).alias("row"),
        (F.col("col") - box["lo_col"]).alias("col"),
        *[c for c in cells.columns if c not in ("row", "col")],
        box["lo_row"].alias("row0"),
        box["lo_col"].alias("col0"),
    )


def pad_to(cells: DataFrame, target: DataFrame, nodata: float = NODATA) -> DataFrame:
    """Put cropped cells (with ``row0, col0``) back on the cells of ``target``; the rest is nodata."""
    back = cells.select((F.col("row") + F.col("row0")).alias("row"), (F.col("col") + F.col("col0")).alias("col"), "z")
    return target.select("row", "col").join(back, ["row", "col"], "left").withColumn("z", F.coalesce("z", F.lit(nodata)))


def missing_lines(cells: DataFrame, axis: str = "row") -> DataFrame:
    """Rows (or columns) without a single valid cell."""
    return cells.groupBy(axis).agg(F.count("z").alias("n")).filter(F.col("n") == 0).select(axis)


# --- polygons ----------------------------------------------------------------

def burn_polygons(vertices: DataFrame, meta: GridMeta) -> DataFrame:
    """Cells of the grid whose centre lies inside a polygon (even-odd rule over its rings).

    ``vertices(poly_id, ring_id, seq, px, py)`` with closed rings: the last
    vertex repeats the first; ``seq`` gives the order and may have gaps.  Works scan line by scan line: edges are cut with
    the row centres they span and the crossings are paired, so no cell is ever
    compared with a polygon.  Whatever lies outside the grid is clipped.
    """
    ring = Window.partitionBy("poly_id", "ring_id").orderBy("seq")
    edges = (
        vertices.select("poly_id", F.col("px").alias("x0"), F.col("py").alias("y0"), F.lead("px").over(ring).alias("x1"), F.lead("py").over(ring).alias("y1"))
        .filter(F.col("x1").isNotNull() & (F.col("y0") != F.col("y1")))
    )
    lo, hi = F.least("y0", "y1"), F.greatest("y0", "y1")  # half open: lo <= centre < hi
    first = F.greatest(F.lit(0), F.floor((F.lit(meta.uly) - hi) / meta.dy - 0.5).cast("int") + 1)
    last = F.least(F.lit(meta.height - 1), F.floor((F.lit(meta.uly) - lo) / meta.dy - 0.5).cast("int"))
    centre = F.lit(meta.uly) - (F.col("row") + 0.5) * meta.dy
    crossings = (
        edges.withColumns({"__first": first, "__last": last})
        .filter(F.col("__first") <= F.col("__last"))
        .withColumn("row", F.explode(F.sequence("__first", "__last")))
        .select("poly_id", "row", (F.col("x0") + (centre - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("cx"))
    )
    line = Window.partitionBy("poly_id", "row").orderBy("cx")
    spans = crossings.withColumns({"__rn": F.row_number().over(line), "__end": F.lead("cx").over(line)}).filter(F.col("__rn") % 2 == 1)
    left = F.greatest(F.lit(0), F.ceil((F.col("cx") - meta.ulx) / meta.dx - 0.5).cast("int"))
    right = F.least(F.lit(meta.width - 1), F.ceil((F.col("__end") - meta.ulx) / meta.dx - 0.5).cast("int") - 1)
    return (
        spans.withColumns({"__l": left, "__r": right})
        .filter(F.col("__l") <= F.col("__r"))
        .select("row", F.explode(F.sequence("__l", "__r")).alias("col"))
        .distinct()
    )


def burn_mask(vertices: DataFrame, cells: DataFrame, meta: GridMeta, out: str = "mask") -> DataFrame:
    """``cells`` with a 0/1 mask of the polygons."""
    burned = burn_polygons(vertices, meta).withColumn(out, F.lit(1))
    return cells.join(burned, ["row", "col"], "left").withColumn(out, F.coalesce(out, F.lit(0)))


# --- static layers on pixels ---------------------------------------------------

def overlay(pixels: DataFrame, layers: DataFrame, meta: GridMeta, bands: Sequence[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Nearest layer values on pixel centres; all layers of a grid share one join.

    Pixels outside the layers, and nodata cells, get missing values.  Scenes
    cover little of a country-wide layer, so the layer is cut to the tiles they
    touch before it is shuffled by cell.
    """
    placed = pixels.withColumns(
        {"__c": cell_index(lon, meta.ulx, meta.dx), "__r": F.floor((F.lit(meta.uly) - F.col(lat)) / meta.dy).cast("bigint")}
    )
    source = layers.select(F.col("row").cast("bigint").alias("__r"), F.col("col").cast("bigint").alias("__c"), *[to_missing(b).alias(b) for b in bands])

    def tile(c: str) -> Column:
        return F.floor(F.col(c) / TILE).alias(f"{c}_tile")

    touched = placed.select(tile("__r"), tile("__c")).distinct()
    tiled_source = source.withColumns({"__r_tile": tile("__r"), "__c_tile": tile("__c")})
    source = tiled_source.join(touched, ["__r_tile", "__c_tile"], "left_semi").drop("__r_tile", "__c_tile")
    return placed.join(source, ["__r", "__c"], "left").drop("__r", "__c")
