"""Mosaics and layers of several grids, and builds that go on from stored cubes, against plain references."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from pixelseries.operators.layers import Layer, attach_layers, common_grid, in_box, mosaic_rasters
from pixelseries.operators.raster import GridMeta
from pixelseries.plans.dataset import DatasetConfig
from pixelseries.plans.incremental import build_requested, raw_cubes
from pixelseries.sources import store

SF = "/root/testdata/sf0.001"
CATALOGUE = "raster_id int, priority int, ulx double, uly double, dx double, dy double, width int, height int, region string"


def rasters():
    """An offset and an overlap, three cell sizes, one raster far away in a region of its own."""
    rng = np.random.default_rng(1)
    places = [(1, 2, 0.013, 20.017, 1.0, 1.0, 20, 15, "a"), (2, 1, 7.317, 18.219, 0.37, 0.41, 30, 25, "a"), (3, 3, -3.3, 25.7, 2.6, 3.1, 6, 7, "a"), (4, 0, 500.1, 30.3, 1.0, 1.0, 5, 5, "b")]
    cells = []
    for i, _, _, _, _, _, width, height, _ in places:
        for r in range(height):
            for c in range(width):
                kind = rng.random()
                cells.append((i, r, c, None if kind < 0.1 else -9999.0 if kind < 0.2 else float("nan") if kind < 0.25 else float(rng.integers(0, 1000))))
    return places, cells + [(1, 99, 0, 5.0), (1, -1, 0, 5.0)]  # outside their raster


def plain_mosaic(places, cells, target):
    values = {(i, r, c): z for i, r, c, z in cells if z is not None and not math.isnan(z) and z != -9999.0}
    out = {}
    for r in range(target.height):
        for c in range(target.width):
            x, y = target.ulx + (c + 0.5) * target.dx, target.uly - (r + 0.5) * target.dy
            for i, _, ulx, uly, dx, dy, width, height, region in sorted(places, key=lambda p: (p[1], p[0])):
                at = (i, math.floor((uly - y) / dy), math.floor((x - ulx) / dx))
                if at in values and 0 <= at[1] < height and 0 <= at[2] < width and (region, r, c) not in out:
                    out[region, r, c] = values[at]
    return out


@pytest.mark.parametrize("size", [0.29, 1.0, 2.3])
def test_mosaic_of_rasters_equals_every_centre(spark, size):
    places, cells = rasters()
    catalogue, table = spark.createDataFrame(places, CATALOGUE), spark.createDataFrame(cells, "raster_id int, row int, col int, z double")
    target = common_grid(catalogue.filter("region = 'a'"), size, size)
    x0, y0, x1, y1 = target.bbox
    assert x0 <= -3.3 < x0 + size and y1 - size < 25.7 <= y1 and x1 >= 20.013 and y0 <= 4.0
    found = mosaic_rasters(table, catalogue, target, by=["region"])
    assert found.columns == ["region", "row", "col", "z"]
    got = {(r.region, r.row, r.col): r.z for r in found.collect()}
    assert got == plain_mosaic(places, cells, target) and len(got) > 50
    assert {r.raster_id for r in in_box(catalogue, target).collect()} == {1, 2, 3}


def test_mosaic_reads_only_rasters_in_the_box(spark, tmp_path):
    places, cells = rasters()
    spark.createDataFrame(cells, "raster_id int, row int, col int, z double").write.partitionBy("raster_id").parquet(str(tmp_path / "cells"))
    spark.createDataFrame(places, CATALOGUE).write.parquet(str(tmp_path / "catalogue"))
    found = mosaic_rasters(spark.read.parquet(str(tmp_path / "cells")), spark.read.parquet(str(tmp_path / "catalogue")), GridMeta(498.0, 32.0, 1.0, 1.0, 10, 10))
    assert found.count() > 0
    assert "dynamicpruning" in found._jdf.queryExecution().toString()


def test_mosaic_of_nothing(spark):
    places, cells = rasters()
    none = spark.createDataFrame([], CATALOGUE)
    with pytest.raises(ValueError, match="no rasters"):
        common_grid(none, 1.0, 1.0)
    table = spark.createDataFrame(cells, "raster_id int, row int, col int, z double")
    assert mosaic_rasters(table, none, GridMeta(0, 9, 1, 1, 9, 9)).count() == 0


def test_layers_of_two_grids(spark):
    near, far = GridMeta(0.0, 10.0, 1.0, 1.0, 10, 10), GridMeta(-5.0, 20.0, 4.0, 4.0, 5, 5)
    grid = lambda n, f: spark.createDataFrame([(r, c, f(r, c)) for r in range(n) for c in range(n)], "row int, col int, z double")
    a, b = grid(10, lambda r, c: float(10 * r + c)), grid(10, lambda r, c: -1.0 if r == c else float(r + c))
    c = grid(5, lambda r, c: -9999.0 if r == 2 else float(r * 100 + c))
    points = [(1, 0.5, 9.5), (2, 3.2, 1.1), (3, 4.4, 5.6), (4, -1.0, 12.0), (5, 300.0, 5.0), (6, 9.99, 0.01), (7, 9.99, -0.5)]
    places = spark.createDataFrame(points, "id int, lon double, lat double")
    found = attach_layers(places, [Layer("a", a, near), Layer("c", c, far), Layer("b", b, near, nodata=-1.0)])
    assert set(found.columns) == {"id", "lon", "lat", "a", "b", "c"}
    got = {r.id: (r.a, r.b, r.c) for r in found.collect()}
    for i, lon, lat in points:
        r, k = math.floor(10 - lat), math.floor(lon)
        inside = 0 <= r < 10 and 0 <= k < 10
        fr, fk = math.floor((20 - lat) / 4), math.floor((lon + 5) / 4)
        known = 0 <= fr < 5 and 0 <= fk < 5 and fr != 2
        assert got[i] == (10.0 * r + k if inside else None, float(r + k) if inside and r != k else None, 100.0 * fr + fk if known else None)
    assert str(found._jdf.queryExecution().optimizedPlan()).count("Join LeftOuter") == 2  # one per grid
    with pytest.raises(ValueError, match="twice: a"):
        attach_layers(places, [Layer("a", a, near), Layer("a", c, far)])
    with pytest.raises(ValueError, match="twice: lon"):
        attach_layers(places, [Layer("lon", a, near)])
    assert attach_layers(places, []).columns == places.columns


def times(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(f"{root}/cubes") for f in files if f.endswith(".parquet")}


def requested(spark):
    cubes = store.cube_catalogue(fx.frames(spark, SF))
    return cubes.withColumns({"lon": 6 + F.col("scene_id") / 32, "lat": 46 + F.col("scene_id") / 64})


def test_second_run_builds_only_new_scenes(spark, tmp_path):
    root, frames, every = str(tmp_path), fx.frames(spark, SF), requested(spark)
    first = raw_cubes(every.filter("scene_id < 2"), frames, root, "train")
    assert {r.scene_id for r in first.select("scene_id").distinct().collect()} == {0, 1}
    before = times(root)
    second = raw_cubes(every, frames.filter("scene_id >= 2"), root, "train")  # the stored ones are not in the source any more
    assert second.count() == frames.count() and {p: t for p, t in times(root).items() if p in before} == before
    after = times(root)
    again = raw_cubes(every, frames.filter("false"), root, "train")
    assert again.count() == frames.count() and times(root) == after
    assert raw_cubes(every.filter("scene_id = 3"), frames, root, "train").select("scene_id").distinct().count() == 1


def test_a_cube_is_found_under_another_name(spark, tmp_path):
    frames, every = fx.frames(spark, SF), requested(spark)
    raw_cubes(every, frames, str(tmp_path), "train")
    renamed = raw_cubes(every.withColumn("scene_id", F.col("scene_id") + 100), frames.filter("false"), str(tmp_path), "train")
    assert renamed.groupBy("scene_id").count().collect() and renamed.agg(F.min("scene_id")).first()[0] == 100
    assert renamed.count() == frames.count()


def test_a_stopped_run_is_built_again(spark, tmp_path):
    frames, every = fx.frames(spark, SF), requested(spark)
    store.write_cubes(frames.filter("scene_id = 1 and t < 100"), f"{tmp_path}/cubes", "train", raw=True)  # written, but not in the catalogue
    assert raw_cubes(every, frames, str(tmp_path), "train").count() == frames.count()


def test_build_from_stored_cubes_equals_a_fresh_one(spark, tmp_path):
    frames, every = fx.frames(spark, SF), requested(spark)
    static = fx.static_raw(spark, SF).groupBy("scene_id", "pixel_id").agg(F.first("DEM").alias("DEM")).withColumns({"FOREST_MASK": F.lit(1.0), "DROUGHT_MASK": F.lit(0.0), "lon": F.lit(6.0), "lat": F.col("pixel_id") / 8})
    weather, config = fx.weather(spark, SF), DatasetConfig(n_frames=fx.N_FRAMES, max_gap=None, pixels_per_scene=1)
    raw_cubes(every.filter("scene_id < 2"), frames, f"{tmp_path}/a", "train")
    sums = []
    for root in ("a", "b"):
        built = build_requested(every, frames, static, weather, config, fx.DAY0, f"{tmp_path}/{root}", "train")
        sums.append(sorted((r.sample_id, round(r.v, 9)) for r in built.samples.select("sample_id", F.aggregate("context.s2_ndvi", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))).alias("v")).collect()))
    assert sums[0] == sums[1] and len(sums[0]) > 100
