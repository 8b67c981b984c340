"""Choice of scenes, pixels and validation samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import beyond, cell_centre, in_bbox, in_time_range, negative_scene, positive_scene, seeded_order
from .raster import GridMeta
from .topk import first_n, mark_fraction, top_k_per_group

SEGMENT_COLUMNS, SEGMENT_ROWS = 3, 2  # fixed values: a raster is sampled in 3 x 2 parts


def scene_cells(forest: DataFrame, drought: DataFrame) -> DataFrame:
    """Forest and drought share of each coarse cell."""
    return forest.join(drought, ["row", "col"])


def _with_centre(cells: DataFrame, meta: GridMeta) -> DataFrame:
    return cells.withColumns({"lon": cell_centre("col", meta.ulx, meta.dx), "lat": cell_centre("row", meta.uly, -meta.dy)})


def positive_scenes(cells: DataFrame, meta: GridMeta, forest_min: float, drought_min: float, n: int, seed: int = 0) -> DataFrame:
    """Up to ``n`` random cells with forest and drought above their thresholds."""
    chosen = cells.filter(positive_scene("forest", "drought", forest_min, drought_min))
    return _with_centre(first_n(chosen, [seeded_order(seed, "row", "col"), F.col("row"), F.col("col")], n), meta)


def negative_scenes(cells: DataFrame, meta: GridMeta, forest_min: float, n: int, seed: int = 0) -> DataFrame:
    """Random cells with forest and no drought, ``ceil(n / 6)`` from each of 3 x 2 segments.

    Cells beyond the last whole segment are not sampled.
    """
    width, height = meta.width // SEGMENT_COLUMNS, meta.height // SEGMENT_ROWS
    i, j = F.floor(F.col("col") / width), F.floor(F.col("row") / height)
    segments = (
        cells.filter(negative_scene("forest", "drought", forest_min))
        .withColumns({"seg_x": i, "seg_y": j})
        .filter((F.col("seg_x") < SEGMENT_COLUMNS) & (F.col("seg_y") < SEGMENT_ROWS))
    )
    quota = math.ceil(n / (SEGMENT_COLUMNS * SEGMENT_ROWS))
    order = [seeded_order(seed, "row", "col"), F.col("row"), F.col("col")]
    return _with_centre(top_k_per_group(segments, ["seg_x", "seg_y"], order, quota), meta)


def draw_pixels(candidates: DataFrame, k: int | None, seed: int = 0, scene: str = "scene_id", pixel: str = "pixel_id", start: str = "start_t") -> DataFrame:
    """At most ``k`` random pixels per scene and window start, a fresh draw for each start."""
    if k is None:
        return candidates
    return top_k_per_group(candidates, [scene, start], [seeded_order(seed, scene, start, pixel), F.col(pixel)], k)


def validation_split(samples: DataFrame, fraction: float, seed: int = 0, sample_id: str = "sample_id", flag: str = "is_val") -> DataFrame:
    """Flag exactly ``int(fraction * n)`` samples; ``sample_id`` must be unique."""
    return mark_fraction(samples, seeded_order(seed, sample_id), [sample_id], fraction, flag)


def split_by_range(samples: DataFrame, bbox=None, time_range=None) -> DataFrame:
    """Add ``split``: train inside the place and time range, else test."""
    inside = _inside(bbox, time_range)
    return samples.withColumn("split", F.when(inside, "train").otherwise("test"))


def route_stats(stats: DataFrame, bbox=None, time_range=None) -> DataFrame:
    """Stats inside the range serve both splits, the others are kept aside as ``unused``."""
    inside = _inside(bbox, time_range)
    target = F.when(inside, F.array(F.lit("train"), F.lit("test"))).otherwise(F.array(F.lit("unused")))
    return stats.withColumn("split", F.explode(target))


def _inside(bbox, time_range) -> Column:
    if bbox is None and time_range is None:
        raise ValueError("give a bounding box, a time range or both")
    return F.coalesce(in_bbox("lon", "lat", bbox) & in_time_range("start", "end", time_range), F.lit(False))


def keep_listed(df: DataFrame, keep: DataFrame, on: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Rows of scenes on the keep-list; applies to cubes, stats and samples alike."""
    return df.join(keep.select(*on), list(on), "left_semi")


def purged(df: DataFrame, keep: DataFrame, on: Sequence[str] = ("scene_id",)) -> DataFrame:
    """The rows :func:`keep_listed` removes."""
    return df.join(keep.select(*on), list(on), "left_anti")


def drop_half_planes(df: DataFrame, lon_bound: float, lon_side: str, lat_bound: float, lat_side: str) -> DataFrame:
    """Remove rows beyond both bounds (strictly)."""
    doomed = beyond("lon", lon_bound, lon_side) & beyond("lat", lat_bound, lat_side)
    return df.filter(~F.coalesce(doomed, F.lit(False)))
