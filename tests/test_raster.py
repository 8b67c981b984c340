import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseries.operators import raster, terrain
from pixelseries.operators.raster import GridMeta

NAN = float("nan")


def cells(spark, a):
    rows = [(r, c, None if math.isnan(a[r][c]) else float(a[r][c])) for r in range(len(a)) for c in range(len(a[0]))]
    return spark.createDataFrame(rows, "row int, col int, z double")


def array(df, shape, column="z"):
    out = np.full(shape, NAN)
    for r in df.collect():
        out[r.row, r.col] = NAN if r[column] is None else r[column]
    return out


def rugged(n=23, m=19, holes=0.1):
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 100, (n, m))
    a[rng.uniform(size=(n, m)) < holes] = NAN
    return a


@pytest.mark.parametrize("size", [3, 7, 128])
def test_neighbours_across_tiles_and_holes(spark, size):
    a = rugged()
    found = raster.with_neighbours(cells(spark, a), size).collect()
    assert len(found) == (~np.isnan(a)).sum()
    steps = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}
    padded = np.pad(a, 1, constant_values=NAN)
    for r in found:
        for name, (dr, dc) in steps.items():
            want = padded[r.row + 1 + dr, r.col + 1 + dc]
            assert (r[name] is None and math.isnan(want)) or r[name] == want


@pytest.mark.parametrize("size", [4, 128])
def test_box_statistics(spark, size):
    a = rugged()
    for r in raster.box_statistics(cells(spark, a), 5, 3, size).collect():
        box = a[max(0, r.row - 1) : r.row + 2, max(0, r.col - 2) : r.col + 3]
        assert r.n == (~np.isnan(box)).sum()
        assert (r["mean"], r.z_min, r.z_max) == pytest.approx((np.nanmean(box), np.nanmin(box), np.nanmax(box)))
        assert r.sd == pytest.approx(np.nanstd(box), abs=1e-6)
    with pytest.raises(ValueError):
        raster.box_statistics(cells(spark, a), 4, 3)


@pytest.mark.parametrize("size", [12, 128])
def test_fill_nodata(spark, size):
    a = rugged(30, 30, 0.3)
    a[4:29, 3:28] = NAN  # wider than the search distance
    a[0, :] = NAN  # hole at the border
    filled = array(raster.fill_nodata(cells(spark, a), 10, size), a.shape)
    for r in range(30):
        for c in range(30):
            if not math.isnan(a[r, c]):
                assert filled[r, c] == a[r, c]
                continue
            top = bottom = 0.0
            for dr, dc in [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]:
                unit = math.hypot(dr, dc)
                for s in range(1, int(10 / unit) + 1):
                    y, x = r + s * dr, c + s * dc
                    if 0 <= y < 30 and 0 <= x < 30 and not math.isnan(a[y, x]):
                        top, bottom = top + a[y, x] / (s * unit), bottom + 1 / (s * unit)
                        break
            assert (math.isnan(filled[r, c]) and bottom == 0) or filled[r, c] == pytest.approx(top / bottom)
    assert math.isnan(filled[16, 15])


def test_fill_nodata_sorts_its_rows_once(spark):
    """A sort per search direction held all rows of a task, wider each time."""
    spread = cells(spark, rugged(20, 20, 0.3))
    plan = raster.fill_nodata(spread, 10, 12)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Window" not in plan


def test_fill_nodata_of_repeated_cells_and_nan(spark):
    """The largest value of a cell counts, NaN is one, and nobody's positions stay absent."""
    rows = [(0, 0, 3.0), (0, 0, 1.0), (0, 0, None), (0, 1, None), (0, 1, None), (0, 3, 9.0), (50, 50, None), (90, 90, NAN), (90, 92, None), (None, 4, 1.0)]
    found = {(r.row, r.col): (r.z, r.was_missing) for r in raster.fill_nodata(spark.createDataFrame(rows, "row int, col int, z double"), 10, 12).collect()}
    assert len(found) == 6
    assert found[0, 0] == (3.0, False) and found[0, 3] == (9.0, False) and found[50, 50] == (None, True)
    assert found[0, 1] == (pytest.approx((3.0 / 1 + 9.0 / 2) / 1.5), True)
    assert math.isnan(found[90, 90][0]) and math.isnan(found[90, 92][0]) and found[90, 92][1]


META = GridMeta(0.0, 10.0, 1.0, 1.0, 12, 10)


def test_coarsen_keeps_the_sum_and_splits_cells(spark):
    a = np.arange(120, dtype=float).reshape(10, 12)
    found, meta = raster.coarsen_sum(cells(spark, a), META, 2.0)
    assert (meta.width, meta.height) == (6, 5) and array(found, (5, 6)).sum() == a.sum()
    found, meta = raster.coarsen_sum(cells(spark, a), META, 2.5, 2.5)
    fine = np.repeat(np.repeat(a / 4, 2, axis=0), 2, axis=1)[:20, :20]
    assert (meta.width, meta.height) == (4, 4)
    assert np.allclose(array(found, (4, 4)), fine.reshape(4, 5, 4, 5).sum(axis=(1, 3)))


def test_rescale(spark):
    found = array(raster.rescale01(cells(spark, [[1.0, 2.0], [NAN, 5.0]])), (2, 2))
    assert found[0].tolist() == [0.0, 0.25] and found[1, 1] == 1.0 and math.isnan(found[1, 0])
    assert np.isnan(array(raster.rescale01(cells(spark, [[3.0, 3.0]])), (1, 2))).all()


def test_bilinear_and_nearest(spark):
    a = np.add.outer(np.arange(10) * 2.0, np.arange(12) * 3.0)  # a plane is reproduced inside
    found, meta = raster.resample(cells(spark, a), META, 1.5)
    got = array(found, (meta.height, meta.width))
    want = np.add.outer(((np.arange(6) + 0.5) * 1.5 - 0.5) * 2, ((np.arange(8) + 0.5) * 1.5 - 0.5) * 3)
    assert np.allclose(got, want)
    near, _ = raster.resample(cells(spark, a), META, 3.0, method="near")
    assert np.allclose(array(near, (3, 4)), a[1::3, 1::3][:3, :4])
    with pytest.raises(ValueError):
        raster.resample(cells(spark, a), META, 3.0, method="cubic")


def test_bilinear_ignores_missing_cells(spark):
    found, _ = raster.resample(cells(spark, [[1.0, NAN], [1.0, 1.0]]), GridMeta(0, 2, 1, 1, 2, 2), 2.0)
    assert array(found, (1, 1))[0, 0] == 1.0


@pytest.mark.parametrize("method", ["near", "bilinear"])
@pytest.mark.parametrize("dx, dy, ulx, uly", [(1.0, 1.0, 0.0, 10.0), (0.3, 0.7, 0.0, 10.0), (3.0, 2.0, 1.1, 9.3), (2.5, 4.0, -3.2, 13.7), (7.0, 7.0, 0.5, 9.5)])
def test_alignment_reads_every_cell_it_needs(spark, method, dx, dy, ulx, uly):
    a = rugged(10, 12, 0.2)
    target = GridMeta(ulx, uly, dx, dy, int(12 / dx) + 2, int(10 / dy) + 2)
    found = array(raster.align(cells(spark, a), META, raster.all_cells(spark, target), target, method), (target.height, target.width))
    for r in range(target.height):
        for c in range(target.width):
            x, y = ulx + (c + 0.5) * dx, 10 - (uly - (r + 0.5) * dy)
            if method == "near":
                spots = [(math.floor(y), math.floor(x), 1.0)]
            else:
                fx, fy = x - 0.5 - math.floor(x - 0.5), y - 0.5 - math.floor(y - 0.5)
                spots = [(math.floor(y - 0.5) + i, math.floor(x - 0.5) + j, (fy if i else 1 - fy) * (fx if j else 1 - fx)) for i in (0, 1) for j in (0, 1)]
            known = [(a[i, j], w) for i, j, w in spots if 0 <= i < 10 and 0 <= j < 12 and not math.isnan(a[i, j])]
            total = sum(w for _, w in known)
            if total:
                assert found[r, c] == pytest.approx(sum(v * w for v, w in known) / total)
            else:
                assert math.isnan(found[r, c])


def test_uncropped_box_grows_outward(spark):
    meta = GridMeta(0.4, 5.3, 1.0, 1.0, 4, 3).snapped(2.0, 2.0)
    assert (meta.ulx, meta.uly, meta.width, meta.height) == (0.0, 6.0, 3, 2)


def test_mosaic_first_valid_tile_wins(spark):
    rows = [(1, 0, 0, None), (2, 0, 0, 5.0), (3, 0, 0, 6.0), (2, 1, 1, 7.0)]
    found = raster.mosaic(spark.createDataFrame(rows, "tile_id int, row int, col int, z double"))
    assert sorted(tuple(r) for r in found.collect()) == [(0, 0, 5.0), (1, 1, 7.0)]


def test_crop_keeps_interior_gaps_and_pad_restores_the_size(spark):
    a = np.full((6, 5), NAN)
    a[1, 1:4], a[4, 2] = 1.0, 2.0  # rows 2 and 3 are missing inside
    whole = cells(spark, a)
    cropped = raster.crop_to_valid(whole)
    assert array(cropped, (4, 3)).shape == (4, 3) and cropped.count() == 12
    padded = array(raster.pad_to(cropped, whole), (6, 5))
    assert np.array_equal(padded, np.where(np.isnan(a), -9999, a))
    assert sorted(r.row for r in raster.missing_lines(whole).collect()) == [0, 2, 3, 5]


def inside(x, y, rings):
    crossings = 0
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
            if y0 != y1 and min(y0, y1) <= y < max(y0, y1) and x0 + (y - y0) * (x1 - x0) / (y1 - y0) <= x:
                crossings += 1
    return crossings % 2 == 1


def test_burn_polygons_with_hole_edges_on_centres_and_clipping(spark):
    polygons = [
        [[(1, 1), (9, 1.3), (8, 8), (2, 9), (1, 1)], [(3, 3), (6, 3), (6, 6), (3, 6), (3, 3)]],  # with a hole
        [[(0.5, 0.5), (2.5, 0.5), (2.5, 2.5), (0.5, 2.5), (0.5, 0.5)]],  # edges through cell centres
        [[(-5, 4), (30, 4), (30, 5.2), (-5, 5.2), (-5, 4)]],  # wider than the grid
        [[(50, 50), (60, 50), (60, 60), (50, 50)]],  # outside
    ]
    rows = [(p, r, s, float(x), float(y)) for p, rings in enumerate(polygons) for r, ring in enumerate(rings) for s, (x, y) in enumerate(ring)]
    vertices = spark.createDataFrame(rows, "poly_id int, ring_id int, seq int, px double, py double")
    got = {(r.row, r.col) for r in raster.burn_polygons(vertices, META).collect()}
    want = {(r, c) for r in range(10) for c in range(12) if any(inside(c + 0.5, 10 - (r + 0.5), rings) for rings in polygons)}
    assert got == want and len(got) > 40
    mask = raster.burn_mask(vertices, raster.all_cells(spark, META), META)
    assert mask.count() == 120 and mask.agg(F.sum("mask")).first()[0] == len(want)


def test_burn_with_gaps_in_the_numbering(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    vertices = spark.createDataFrame([(1, 0, 10 * i, x, y) for i, (x, y) in enumerate(ring)], "poly_id int, ring_id int, seq int, px double, py double")
    assert raster.burn_polygons(vertices, raster.GridMeta(0.0, 8.0, 1.0, 1.0, 8, 8)).count() == 16


@pytest.mark.parametrize("fx, fy, size", [(1, 1, 4), (1, 9, 5), (21, 3, 8), (41, 31, 7), (101, 101, 16)])
def test_boxes_of_any_size(spark, fx, fy, size):
    rng = np.random.default_rng(fx)
    a = rng.integers(0, 9, (23, 31)).astype(float)
    a[rng.random(a.shape) < 0.2] = np.nan
    a[5:12, 5:12] = 3.0
    for r in raster.box_statistics(cells(spark, a), fx, fy, size).collect():
        box = a[max(0, r.row - fy // 2) : r.row + fy // 2 + 1, max(0, r.col - fx // 2) : r.col + fx // 2 + 1]
        box = box[~np.isnan(box)]
        assert (r.z, r.n, r.z_min, r.z_max) == (a[r.row, r.col], len(box), box.min(), box.max())
        assert r.mean == pytest.approx(box.mean()) and r.sd == pytest.approx(box.std(), abs=1e-6)
        assert box.std() > 0 or r.sd == 0


def test_deviation_of_high_flat_ground(spark):
    cells = spark.range(100).select((F.col("id") % 10).cast("int").alias("row"), F.floor(F.col("id") / 10).cast("int").alias("col"), (F.lit(4e8) + F.col("id") % 2).alias("z"))
    found = raster.box_statistics(cells, 11, 11).filter("row = 5 and col = 5").first()
    assert found.n == 100 and found.mean == pytest.approx(4e8 + 0.5, abs=1e-6) and found.sd == pytest.approx(0.5, abs=1e-9)


def test_overlay_leaves_pixels_outside_missing(spark):
    layers = cells(spark, [[1.0, -9999.0], [3.0, 4.0]]).withColumnRenamed("z", "DEM")
    pixels = spark.createDataFrame([(0, 0.5, 1.5), (1, 1.5, 1.5), (2, 1.2, 0.1), (3, 9.0, 0.5)], "pixel_id int, lon double, lat double")
    found = {r.pixel_id: r.DEM for r in raster.overlay(pixels, layers, GridMeta(0, 2, 1, 1, 2, 2), ["DEM"]).collect()}
    assert found == {0: 1.0, 1: None, 2: 4.0, 3: None}


def test_plane_has_constant_slope_and_no_curvature(spark):
    a = np.add.outer(np.zeros(8), np.arange(9) * 1.0)  # rises to the east
    inner = [r for r in terrain.surface(cells(spark, a), 1.0, 1.0, 4).collect() if 0 < r.row < 7 and 0 < r.col < 8]
    assert {round(r.slope, 9) for r in inner} == {45.0} and {r.aspect for r in inner} == {270.0}
    assert {(r.plan_curv, r.profile_curv, r.curv) for r in inner} == {(0.0, 0.0, 0.0)} and {r.pointer for r in inner} == {32}


def test_flat_and_peak(spark):
    flat = terrain.surface(cells(spark, np.ones((3, 3))), 1.0, 1.0).collect()
    assert {(r.slope, r.aspect, r.rugg, r.curv, r.pointer) for r in flat} == {(0.0, None, 0.0, 0.0, 0)}
    a = np.zeros((3, 3))
    a[1, 1] = 2.0
    peak = [r for r in terrain.surface(cells(spark, a), 1.0, 1.0).collect() if (r.row, r.col) == (1, 1)][0]
    assert peak.rugg == 2.0 and peak.pointer == 2  # equal drops east, south, west, north: lowest code


def test_single_cell(spark):
    only = terrain.surface(cells(spark, [[7.0]]), 1.0, 1.0).first()
    assert only.rugg is None and only.pointer == 0 and only.slope == 0.0


def walk(pointers):
    acc = {k: 0 for k in pointers}
    for cell in pointers:
        while True:
            acc[cell] += 1
            code = pointers[cell]
            if code == 0:
                break
            dr, dc = terrain.DIRECTIONS[code]
            cell = (cell[0] + dr, cell[1] + dc)
    return acc


def test_flow_accumulation_equals_walking(spark):
    y, x = np.mgrid[0:20, 0:20]
    a = y * 3.0 + abs(x - 9) + np.random.default_rng(3).uniform(0, 1.5, (20, 20))  # a valley: long paths
    surface = terrain.surface(cells(spark, a), 1.0, 1.0, 8)
    pointers = {(r.row, r.col): r.pointer for r in surface.collect()}
    for size in (5, 128):
        acc = {(r.row, r.col): r.acc for r in terrain.flow_accumulation(surface, size=size).collect()}
        assert acc == walk(pointers) and max(acc.values()) > 20
    assert sum(v for k, v in acc.items() if pointers[k] == 0) == 400


def test_flow_channel_and_confluence(spark):
    rows = [(0, 0, 4), (0, 2, 16), (1, 1, 8), (2, 1, 8), (3, 1, 0)]
    found = terrain.flow_accumulation(spark.createDataFrame(rows, "row int, col int, pointer int"))
    assert {(r.row, r.col): r.acc for r in found.collect()} == {(0, 0): 1, (0, 2): 1, (1, 1): 3, (2, 1): 4, (3, 1): 5}


def test_flow_cycle_is_an_error(spark):
    loop = spark.createDataFrame([(0, 0, 2), (0, 1, 32)], "row int, col int, pointer int")
    with pytest.raises(Exception, match="cycle"):
        terrain.flow_accumulation(loop, max_rounds=3)
    with pytest.raises(RuntimeError, match="cycle"):
        terrain.flow_accumulation(loop, max_rounds=3, size=1)


@pytest.mark.parametrize("size", [1, 7, 128])
def test_flow_of_one_long_channel(spark, size):
    """A channel that winds through all rows and holds every cell; tiles of one cell are a graph of all."""
    rows = []
    for r in range(21):
        turn = 20 if r % 2 == 0 else 0
        rows += [(r, c, (8 if r < 20 else 0) if c == turn else (2 if r % 2 == 0 else 32)) for c in range(21)]
    found = terrain.flow_accumulation(spark.createDataFrame(rows, "row int, col int, pointer int"), size=size)
    acc = {(r.row, r.col): r.acc for r in found.collect()}
    assert acc == walk({(r, c): p for r, c, p in rows}) and max(acc.values()) == 441


def test_relative_position_and_deviation(spark):
    a = np.array([[0.0, 0.0, 0.0], [0.0, 9.0, 0.0], [0.0, 0.0, 0.0]])
    rtp = array(terrain.relative_position(cells(spark, a), 3, 3), (3, 3), "rtp")
    assert rtp[1, 1] == 1.0 and rtp[0, 0] == -1.0
    dev = array(terrain.deviation(cells(spark, a), 3, 3), (3, 3), "dev")
    assert dev[1, 1] == pytest.approx((9 - 1) / a.std())
    assert array(terrain.deviation(cells(spark, np.ones((3, 3))), 3, 3), (3, 3), "dev").tolist() == np.zeros((3, 3)).tolist()


def test_multi_resolution_has_every_feature(spark):
    a = rugged(20, 20, 0.0)
    found = terrain.multi_resolution(cells(spark, a), GridMeta(0, 20, 1, 1, 20, 20), {"20": 1, "100": 5}, size=8)
    assert found.count() == 400
    assert set(found.columns) == {"row", "col"} | {f"{b}_{s}" for b in terrain.FEATURES for s in ("20", "100")}
    assert found.filter("slope_20 is null or slope_100 is null or twi_20 is null").count() == 0


def test_grid_summary(spark):
    points = spark.createDataFrame([(x * 0.5, 10.0 - y) for x in range(4) for y in range(3)], "lon double, lat double")
    assert tuple(raster.grid_summary(points).first()) == (0.0, 1.5, 4, 0.5, 8.0, 10.0, 3, 1.0)
