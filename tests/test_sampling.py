import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from pixelseries.operators import sampling, topk
from pixelseries.operators.raster import GridMeta

META = GridMeta(6.0, 48.0, 0.5, 0.25, 7, 5)


def masks(spark, forest, drought, width=7):
    rows = [(i // width, i % width, f, d) for i, (f, d) in enumerate(zip(forest, drought))]
    both = spark.createDataFrame(rows, "row int, col int, forest double, drought double")
    return sampling.scene_cells(both.select("row", "col", "forest"), both.select("row", "col", "drought"))


def test_positive_scenes_thresholds_are_strict(spark):
    cells = masks(spark, [0.5, 0.6, 0.6, 0.9], [0.9, 0.1, 0.2, 0.3])
    found = sampling.positive_scenes(cells, META, 0.5, 0.1, 10).collect()
    assert sorted((r.row, r.col) for r in found) == [(0, 2), (0, 3)]
    first = [r for r in found if r.col == 2][0]
    assert (first.lon, first.lat) == (7.25, 47.875)
    assert sampling.positive_scenes(cells, META, 0.5, 0.1, 1).count() == 1


def test_negative_scenes_take_a_quota_from_each_segment(spark):
    cells = masks(spark, [0.9] * 35, [0.0] * 35)  # segments of 2 x 2 cells; column 6 and row 4 are left over
    found = sampling.negative_scenes(cells, META, 0.5, 13).collect()
    per = {}
    for r in found:
        per[r.seg_x, r.seg_y] = per.get((r.seg_x, r.seg_y), 0) + 1
    assert per == {(i, j): 3 for i in range(3) for j in range(2)}
    assert all(r.col < 6 and r.row < 4 for r in found)
    assert sampling.negative_scenes(cells, META, 0.5, 600).count() == 24  # fewer candidates than the quota
    assert sampling.negative_scenes(masks(spark, [0.9] * 35, [0.1] * 35), META, 0.5, 13).count() == 0


def test_top_k_is_exact_with_one_hot_group(spark):
    rows = spark.range(30_000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("g"), F.md5(F.col("id").cast("string")).alias("h"), "id")
    got = {(r.g, r.id) for r in topk.top_k_per_group(rows, ["g"], [F.col("h"), F.col("id")], 7).collect()}
    groups = {}
    for i in range(30_000):
        groups.setdefault(0 if i % 3 == 0 else i % 50, []).append((hashlib.md5(str(i).encode()).hexdigest(), i))
    assert got == {(g, i) for g, members in groups.items() for _, i in sorted(members)[:7]}


def test_draw_pixels(spark):
    candidates = spark.range(40).select(F.lit(0).alias("scene_id"), F.col("id").alias("pixel_id"), F.explode(F.array(F.lit(3), F.lit(4))).alias("start_t"))
    drawn = sampling.draw_pixels(candidates, 10, seed=1)
    by_start = {s: {r.pixel_id for r in drawn.filter(F.col("start_t") == s).collect()} for s in (3, 4)}
    assert len(by_start[3]) == len(by_start[4]) == 10 and by_start[3] != by_start[4]
    assert sampling.draw_pixels(candidates, 40).count() == sampling.draw_pixels(candidates, 99).count() == 80
    assert sampling.draw_pixels(candidates, None).count() == 80


@pytest.mark.parametrize("n, fraction", [(1000, 0.05), (999, 0.5), (7, 0.1), (10, 1.0), (200_000, 0.3)])
def test_validation_split_has_the_exact_size(spark, n, fraction):
    ids = spark.range(n).select(F.format_string("s%08d", "id").alias("sample_id"))
    split = sampling.validation_split(ids, fraction, seed=42)
    val = {r.sample_id for r in split.filter("is_val").collect()}
    assert split.count() == n and len(val) == int(fraction * n)
    if n <= 1000:
        order = sorted((hashlib.md5(f"42:s{i:08d}".encode()).hexdigest(), f"s{i:08d}") for i in range(n))
        assert val == {s for _, s in order[: len(val)]}


def keyed(spark):
    d = datetime.date
    rows = [(0, 6.0, 46.0, d(2018, 1, 1), d(2018, 6, 1)), (1, 7.0, 47.0, d(2018, 1, 1), d(2018, 6, 2)), (2, 7.1, 46.5, d(2017, 12, 31), d(2018, 2, 1)), (3, None, 46.5, d(2018, 2, 1), d(2018, 2, 1))]
    return spark.createDataFrame(rows, "id int, lon double, lat double, start date, end date")


def test_split_bounds_are_inclusive_and_split_is_a_partition(spark):
    box, times = [6.0, 46.0, 7.0, 47.0], ["2018-01-01", "2018-06-01"]

    def train(**ranges):
        return {r.id for r in sampling.split_by_range(keyed(spark), **ranges).filter("split = 'train'").collect()}

    assert train(bbox=box) == {0, 1} and train(time_range=times) == {0, 3} and train(bbox=box, time_range=times) == {0}
    assert sampling.split_by_range(keyed(spark), bbox=box).count() == 4
    with pytest.raises(ValueError):
        sampling.split_by_range(keyed(spark))


def test_stats_inside_the_range_serve_both_splits(spark):
    found = sampling.route_stats(keyed(spark), bbox=[6.0, 46.0, 7.0, 47.0])
    assert sorted((r.id, r.split) for r in found.collect()) == [(0, "test"), (0, "train"), (1, "test"), (1, "train"), (2, "unused"), (3, "unused")]


def test_half_planes_are_strict_and_keep_the_unknown(spark):
    left = sampling.drop_half_planes(keyed(spark), 6.5, "more", 47.0, "less")
    assert {r.id for r in left.collect()} == {0, 1, 3}
    with pytest.raises(ValueError):
        sampling.drop_half_planes(keyed(spark), 6.5, "above", 47.0, "less")


def test_keep_list(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (2, "d")], "scene_id int, name string")
    keep = spark.createDataFrame([(1,), (1,), (9,)], "scene_id int")
    assert {r.name for r in sampling.keep_listed(df, keep).collect()} == {"b", "c"}
    assert {r.name for r in sampling.purged(df, keep).collect()} == {"a", "d"}
