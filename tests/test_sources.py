import json

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.queries import samples as query_samples
from pixelseries.functions import bands as B
from pixelseries.functions import keys as K
from pixelseries.operators import sampling, stats
from pixelseries.operators.topk import one_per_key
from pixelseries.plans.dataset import DatasetConfig, build_dataset, prepare_frames, write_dataset
from pixelseries.session import cut_lineage
from pixelseries.sources import bands as band_source
from pixelseries.sources import scenes, store

SF = "/root/testdata/sf0.001"


def test_scene_lists(spark, tmp_path):
    for name, text in (("a.txt", "6.45, 46.65\n6.5, 46.7\n"), ("b.txt", "6.5, 46.7\n")):
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in ("a.txt", "b.txt")]
    both = scenes.read_scenes(spark, paths)
    assert sorted(tuple(r) for r in both.collect()) == [(6.45, 46.65), (6.5, 46.7), (6.5, 46.7)]
    once = scenes.union_scenes(scenes.read_scenes(spark, paths[0]), scenes.read_scenes(spark, paths[1]))
    scenes.write_scenes(once, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["6.45, 46.65", "6.5, 46.7"]


def test_tile_urls(spark, tmp_path):
    (tmp_path / "u.txt").write_text("https://x.example/e/elev_2019_2741-1241/elev_2019_2741-1241_0.5_2056_5728.tif\nhttps://x.example/readme.html\n")
    rows = {r.file_name: tuple(r)[2:] for r in scenes.read_tile_urls(spark, str(tmp_path / "u.txt")).collect()}
    assert rows == {"elev_2019_2741-1241_0.5_2056_5728.tif": (2019, 2741, 1241, 0.5, 2056), "readme.html": (None,) * 5}


def test_list_files_without_stats(spark, tmp_path):
    for name in ("a.npz", "b.npz", "a_min.npz", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.file_name for r in scenes.list_files(spark, str(tmp_path), "*.npz", ["_min.npz"]).collect()] == ["a.npz", "b.npz"]


def test_band_dictionary(spark):
    rows = {r.band: r for r in band_source.band_dictionary(spark).collect()}
    assert len(rows) == len(band_source.band_descriptions()) == 36 + 3 * 7 + 7
    assert rows["NDVI"].interpolation == "linear" and rows["PH15_30"].interpolation == "nearest"
    assert rows["PH15_30"].description == "acidity (pH), 15 to 30 cm deep"


def cubes(spark):
    return fx.frames(spark, SF)


def test_cubes_replace_only_their_scene(spark, tmp_path):
    path = str(tmp_path / "cubes")
    f = cubes(spark)
    store.write_cubes(f, path, "train", raw=True)
    store.write_cubes(f.filter("scene_id = 1 and t < 10"), path, "train", raw=True)
    back = store.read_cubes(spark, path, "train", raw=True)
    assert back.filter("scene_id = 1").agg(F.max("t")).first()[0] < 10
    assert back.filter("scene_id <> 1").count() == f.filter("scene_id <> 1").count()
    assert store.read_cubes(spark, path, "train").count() == 0


def test_stats_and_samples_round_trip(spark, tmp_path):
    found = stats.band_stats(cubes(spark), fx.BANDS)
    store.write_stats(found.withColumn("split", F.lit("train")), str(tmp_path / "stats"))
    assert spark.read.parquet(str(tmp_path / "stats")).filter("split = 'train'").count() == found.count()
    packed = store.pack_samples(query_samples(spark, SF), ["s2_ndvi"], ["sample_id", "scene_id"]).withColumn("split", F.lit("train"))
    for _ in range(2):  # written twice, stored once
        store.write_samples(packed, str(tmp_path / "samples"))
    back = spark.read.parquet(str(tmp_path / "samples"))
    assert back.count() == packed.count() == 20 * 410
    row = back.first()
    assert (len(row.context), len(row.context[0]), len(row.target[0])) == (1, 54, 18)


def test_first_prediction_wins(spark, tmp_path):
    path = str(tmp_path / "preds")
    first = spark.createDataFrame([("a", 0, 1.0)], "sample_id string, step int, pred double")
    store.write_predictions(first, path)
    store.write_predictions(first.unionByName(spark.createDataFrame([("b", 0, 3.0)], first.schema)).withColumn("pred", F.col("pred") * 2), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 0, 1.0), ("b", 0, 6.0)]


def test_scores(spark, tmp_path):
    for trial, values in (("config_(hidden_dim=32)_(num_layers=2)", ["0.5", "0.25"]), ("config_(hidden_dim=64)_(num_layers=2)", ["0.75"])):
        (tmp_path / trial).mkdir()
        text = json.dumps([{"RMSE_drought": v, "epoch": str(i)} for i, v in enumerate(values)])
        (tmp_path / trial / "validation_scores.json").write_text(text)
    found = store.read_scores(spark, f"{tmp_path}/*/validation_scores.json")
    assert sorted(tuple(r) for r in found.collect())[1] == ("config_(hidden_dim=32)_(num_layers=2)", 1, 0.25)
    store.write_scores(found, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_catalogue_ignores_float_noise(spark):
    want = spark.sql("select date'2018-01-05' start, date'2021-12-30' end, 6.1 lon, 46.3 lat, 128 width, 128 height union all select date'2018-01-05', date'2021-12-30', 6.2, 46.3, 128, 128")
    have = spark.sql("select date'2018-01-01' start, date'2021-12-28' end, 6.1000000001D lon, 46.3D lat, 128 width, 128 height")
    want, have = (df.selectExpr("start", "end", "cast(lon as double) lon", "cast(lat as double) lat", "width", "height") for df in (want, have))
    assert [r.lon for r in store.reusable(want, have).collect()] == [6.1]
    assert [r.lon for r in store.to_build(want, have).collect()] == [6.2]


def test_cut_lineage_reads_back_the_same_rows(spark):
    df = spark.range(10).select("id", F.struct(F.col("id").alias("a")).alias("s"))
    again = cut_lineage(df)
    assert sorted(r.id for r in again.collect()) == list(range(10)) and again.schema.simpleString() == df.schema.simpleString()
    assert "Range" not in again._jdf.queryExecution().toString()


@pytest.mark.parametrize("summer, gap", [(True, 40), (False, None)])
def test_dataset_build_end_to_end(spark, tmp_path, summer, gap):
    frames = B.add_ndvi(cubes(spark))
    static = fx.static_raw(spark, SF).groupBy("scene_id", "pixel_id").agg(F.first("DEM").alias("DEM")).withColumns({"FOREST_MASK": F.lit(1.0), "DROUGHT_MASK": F.lit(0.0)})
    static = static.withColumns({"lon": F.lit(6.0), "lat": F.col("pixel_id") / 8})
    weather = frames.select("scene_id", "pixel_id", F.col("ts").alias("day"), (F.col("t") * 1.0).alias("era5_t"))
    config = DatasetConfig(n_frames=fx.N_FRAMES, max_gap=gap, target_in_summer=summer, pixels_per_scene=1, compat=True)
    built = build_dataset(frames, static, weather, config, fx.DAY0)
    per = built.samples.groupBy("scene_id", "start_t").count()
    assert per.agg(F.max("count")).first()[0] == 1
    row = built.samples.first()
    led = [f.era5_t for f in row.context if f.era5_t is not None]
    assert led and led[0] >= row.start_t + 18  # weather of 18 frames later
    assert len(row.context) == 54 and len(row.target) == 18 and "DEM" in built.samples.columns and "FOREST_MASK" not in built.samples.columns
    if summer:
        assert built.samples.filter(~F.month(F.col("target")[0]["ts"]).between(6, 8)).count() == 0
    write_dataset(built, str(tmp_path), "train")
    assert spark.read.parquet(f"{tmp_path}/samples").count() == built.samples.count()
    assert spark.read.parquet(f"{tmp_path}/stats").count() == built.stats.count()
    stored = spark.read.parquet(f"{tmp_path}/samples")
    named = stored.select(K.parse_key("sample_id").alias("k"), "start", "end", "lon", "lat")
    assert named.filter("k.start = start and k.end = end and k.lon = lon and k.lat = lat and k.shift = 18").count() == stored.count()
    late = sampling.split_by_range(stored, time_range=["1998-01-01", "2003-01-01"])
    assert 0 < late.filter("split = 'train'").count() < stored.count()
    assert spark.read.parquet(f"{tmp_path}/cubes").select("stage").distinct().count() == 2


def test_stats_of_another_scene_stay(spark, tmp_path):
    def stats(scene, low):
        return spark.createDataFrame([(scene, "a", low, 9.0, "train")], "scene_id long, band string, min double, max double, split string")

    for scene, low in ((1, 0.0), (2, 1.0), (2, 2.0)):
        store.write_stats(stats(scene, low), str(tmp_path / "stats"))
    assert sorted((r.scene_id, r.min) for r in spark.read.parquet(str(tmp_path / "stats")).collect()) == [(1, 0.0), (2, 2.0)]


def test_samples_are_replaced_by_name(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame([(1, "train", *r) for r in rows], "scene_id long, split string, sample_id string, v double")

    store.write_samples(batch(("a", 1.0), ("b", 2.0)), str(tmp_path / "s"))
    store.write_samples(batch(("b", 3.0), ("c", 4.0)), str(tmp_path / "s"))
    assert sorted((r.sample_id, r.v) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("a", 1.0), ("b", 3.0), ("c", 4.0)]


def test_predictions_of_one_batch_are_unique(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 2.0), ("a", 0, 1.0), ("b", 0, 5.0)], "sample_id string, step int, pred double")
    store.write_predictions(rows, str(tmp_path / "p"))
    store.write_predictions(rows.withColumn("pred", F.lit(0.0)), str(tmp_path / "p"))
    assert sorted((r.sample_id, r.pred) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [("a", 1.0), ("b", 5.0)]
    with pytest.raises(Exception):
        store.write_predictions(rows.drop("step"), str(tmp_path / "p"))


def test_first_predictions_are_found_by_one_grouping_without_a_sort(spark):
    rows = spark.createDataFrame([("a", 0, 2.0), ("a", 0, 1.0), ("b", 0, 5.0), ("c", 0, None), ("c", 0, 4.0), (None, 1, 3.0), ("d", 2, float("nan")), ("d", 2, 7.0)], "sample_id string, step int, pred double")
    stored = rows.filter("sample_id = 'b' or sample_id is null")
    found = one_per_key(rows, ["sample_id", "step"], stored)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "HashAggregate" in plan and found.columns == rows.columns
    assert {tuple(r) for r in found.collect()} == {("a", 0, 1.0), ("c", 0, None), (None, 1, 3.0), ("d", 2, 7.0)}
    two = rows.withColumn("more", F.lit("x"))
    assert {tuple(r) for r in one_per_key(two, ["sample_id", "step"], stored).collect()} == {("a", 0, 1.0, "x"), ("c", 0, None, "x"), (None, 1, 3.0, "x"), ("d", 2, 7.0, "x")}
    keys = rows.select("sample_id", "step")
    assert {tuple(r) for r in one_per_key(keys, ["sample_id", "step"], stored).collect()} == {("a", 0), ("c", 0), (None, 1), ("d", 2)}


def test_weather_without_an_image_is_kept(spark):
    """Per-scene pixel ids, images on some frames only: weather comes from the readings of every frame."""
    config = DatasetConfig(n_frames=6, max_gap=None)
    frames = spark.createDataFrame([(s, 0, t, float(t)) for s in (1, 2) for t in (0, 3)], "scene_id long, pixel_id long, t int, s2_ndvi double").withColumn("ts", F.date_add(F.lit("2020-01-01").cast("date"), F.col("t") * 5))
    days = [(s, 0, d, float(100 * s + d)) for s in (1, 2) for d in range(0, 26)]
    weather = spark.createDataFrame(days, "scene_id long, pixel_id long, d int, era5_tp double").select("scene_id", "pixel_id", F.date_add(F.lit("2020-01-01").cast("date"), "d").alias("day"), "era5_tp")
    found = prepare_frames(frames, weather, config, "2020-01-01")
    got = {(r.scene_id, r.t): r.era5_tp for r in found.collect()}
    assert len(got) == 12
    assert got == {(s, t): float(sum(100 * s + d for d in ([0] if t == 0 else range(5 * t - 4, 5 * t + 1)))) for s in (1, 2) for t in range(6)}
