"""Rasters and layers of many grids: one mosaic from all, and values of every grid on pixels."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NODATA
from .raster import GridMeta, overlay

#: What a catalogue says of each raster, with its ``raster_id`` and ``priority``.
PLACE = ("ulx", "uly", "dx", "dy", "width", "height")


# --- mosaic ------------------------------------------------------------------


def common_grid(catalogue: DataFrame, dx: float, dy: float) -> GridMeta:
    """The grid of a cell size that covers all rasters, its corner at multiples of the size."""
    right, bottom = F.col("ulx") + F.col("width") * F.col("dx"), F.col("uly") - F.col("height") * F.col("dy")
    box = catalogue.agg(F.min("ulx").alias("x0"), F.min(bottom).alias("y0"), F.max(right).alias("x1"), F.max("uly").alias("y1")).first()
    if box["x0"] is None:
        raise ValueError("the catalogue has no rasters")
    left, top = math.floor(box["x0"] / dx), math.ceil(box["y1"] / dy)
    return GridMeta(left * dx, top * dy, dx, dy, math.ceil(box["x1"] / dx) - left, top - math.floor(box["y0"] / dy))


def in_box(catalogue: DataFrame, target: GridMeta) -> DataFrame:
    """The rasters that overlap a grid."""
    x0, y0, x1, y1 = target.bbox
    return catalogue.filter((F.col("ulx") < x1) & (F.col("ulx") + F.col("width") * F.col("dx") > x0) & (F.col("uly") > y0) & (F.col("uly") - F.col("height") * F.col("dy") < y1))


def _centres(start: Column, step: Column, origin: float, size: float, count: int) -> Column:
    """The target cells whose centres lie from ``start`` up to ``start + step``, the end left out."""
    first = lambda edge: F.ceil((edge - F.lit(origin)) / F.lit(size) - F.lit(0.5)).cast("long")
    low, high = F.greatest(first(start), F.lit(0).cast("long")), F.least(first(start + step), F.lit(count).cast("long")) - 1
    return F.when(low <= high, F.sequence(low, high))


def mosaic_rasters(cells: DataFrame, catalogue: DataFrame, target: GridMeta, by: Sequence[str] = (), nodata: float = NODATA) -> DataFrame:
    """``by..., row, col, z`` on the target grid from rasters of any origin and cell size.

    ``cells(raster_id, row, col, z)``; ``catalogue`` has one row per raster: ``raster_id``,
    its ``priority``, ``PLACE`` and the columns ``by``, which make a mosaic of their own each. A target cell
    takes the value of the source cell that holds its centre, of the raster of
    lowest priority that has one there (ties: smallest id); NULL, NaN and ``nodata`` are no values.
    Target cells without any are absent.

    Rasters outside the target are left out before their cells are read, if the cells
    are stored by ``raster_id``. A source cell tells which target centres it holds, so
    there is no join with the target: the catalogue's rows meet the cells, and one
    grouping with partial results picks the values.
    """
    known = cells.filter(F.col("z").isNotNull() & ~F.isnan(F.col("z").cast("double")) & (F.col("z") != nodata)).select("raster_id", "row", "col", F.col("z").cast("double").alias("z"))
    placed = known.join(in_box(catalogue, target).select("raster_id", "priority", *PLACE, *by), "raster_id")
    placed = placed.filter((F.col("row") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") >= 0) & (F.col("col") < F.col("width")))
    # Rows count from the top: distances from the target's top edge grow downwards.
    down = F.lit(target.uly) - F.col("uly") + F.col("row") * F.col("dy")
    across = F.col("ulx") + F.col("col") * F.col("dx")
    spread = placed.withColumn("to_row", F.explode(_centres(down, F.col("dy"), 0.0, target.dy, target.height)))
    spread = spread.withColumn("to_col", F.explode(_centres(across, F.col("dx"), target.ulx, target.dx, target.width)))
    rank = F.struct("priority", "raster_id")
    found = spread.groupBy(*by, F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.min_by("z", rank).alias("z"))
    return found.select(*by, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "z")


# --- layer register ----------------------------------------------------------


@dataclass(frozen=True)
class Layer:
    """One band on a grid: ``cells(row, col, <value>)`` and the number that stands for no data."""

    band: str
    cells: DataFrame
    meta: GridMeta
    value: str = "z"
    nodata: float = NODATA


def attach_layers(places: DataFrame, layers: Sequence[Layer], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``places`` with a column per layer: the value of the cell a place lies in.

    Layers of the same grid become one table and take one join, however many they
    are. A place outside a grid, and a cell without data, give NULL. Bands that
    the places have already, or that occur twice, are an error.
    """
    names = [layer.band for layer in layers]
    if twice := {n for n in names if names.count(n) > 1} | (set(names) & set(places.columns)):
        raise ValueError(f"bands named twice: {', '.join(sorted(twice))}")
    grids: dict[GridMeta, list[Layer]] = {}
    for layer in layers:
        grids.setdefault(layer.meta, []).append(layer)
    for meta, members in grids.items():
        long = None
        for layer in members:
            value = F.col(layer.value).cast("double")
            rows = layer.cells.select("row", "col", F.lit(layer.band).alias("band"), F.when(~F.isnan(value) & (value != layer.nodata), value).alias("v")).filter("v is not null")
            long = rows if long is None else long.unionByName(rows)
        inside = (F.col("row") >= 0) & (F.col("row") < meta.height) & (F.col("col") >= 0) & (F.col("col") < meta.width)
        wide = long.filter(inside).groupBy("row", "col").agg(*[F.max(F.when(F.col("band") == m.band, F.col("v"))).alias(m.band) for m in members])
        places = overlay(places, wide, meta, [m.band for m in members], lon, lat)
    return places
