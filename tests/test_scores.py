import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseries.operators import forecast, scores, stats, tuning

N = None


def pairs(spark):
    rows = [("a", 0, 1.0, 2.0), ("a", 1, 3.0, 3.0), ("b", 0, 0.0, 3.0), ("b", 1, 1.0, 1.0), ("c", 0, 2.0, 2.0), ("c", 1, 2.0, 4.0)]
    return spark.createDataFrame(rows, "sample_id string, step int, pred double, truth double")


def test_errors(spark):
    per = {r.sample_id: (r.n_steps, r.mse) for r in scores.sample_errors(pairs(spark)).collect()}
    assert per == {"a": (2, 0.5), "b": (2, 4.5), "c": (2, 2.0)}
    assert scores.rmse(pairs(spark)).first().rmse == pytest.approx(math.sqrt(14 / 6))
    assert scores.loss("l2")(pairs(spark)).first().l2 == pytest.approx(7 / 3)
    # two batches of at most two samples, two steps each
    assert scores.rmse(pairs(spark), compat_batch=2).first().rmse == pytest.approx(math.sqrt(14 / 4))
    with pytest.raises(ValueError):
        scores.loss("l7")


def test_merge_scores(spark):
    parts = scores.sample_errors(pairs(spark))
    assert scores.merge_scores(parts.unionByName(parts)).count() == 3
    doubled = scores.merge_scores(parts.unionByName(parts.withColumn(parts.columns[-1], F.col(parts.columns[-1]) + 1)))
    assert sorted(map(tuple, doubled.collect())) == sorted(map(tuple, parts.collect()))


def test_sliding_scores_of_constant_series(spark):
    rows = [(0, p, t, v) for p, v in ((0, 0.3), (1, 0.7)) for t in range(200)]
    found = scores.sliding_baseline_scores(spark.createDataFrame(rows, "scene_id int, pixel_id int, t int, v double"), "v", 54, 18).first()
    assert found.mse_mean == found.rmse_mean == found.rmse_persistence == 0.0


def test_stats_and_normalisation(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, None, 5.0), (1, 3.0, 5.0)], "scene_id int, a double, b double")
    per = stats.band_stats(df, ["a", "b"])
    assert sorted((r.scene_id, r.band, r.min, r.max) for r in per.collect()) == [(0, "a", 1.0, 1.0), (0, "b", 5.0, 5.0), (1, "a", 3.0, 3.0), (1, "b", 5.0, 5.0)]
    assert sorted(tuple(r) for r in stats.global_stats(per).collect()) == [("a", 1.0, 3.0), ("b", 5.0, 5.0)]
    scaled = stats.normalise(df, ["a", "b"], per).collect()
    assert sorted((r.a is None, r.a or 0.0) for r in scaled) == [(False, 0.0), (False, 1.0), (True, 0.0)]
    assert {r.b for r in scaled} == {None}
    with pytest.raises(ValueError):
        stats.normalise(df, ["a"], None)
    assert [r.a for r in stats.normalise(df, ["a"], None, compat=True).orderBy("a").collect()] == [None, -2.0, 0.0]


def test_trials(spark):
    grid = tuning.trial_grid(tuning.parameter_lists(spark, {"hidden_dim": [64, 32], "num_layers": [2, 10, 4]}))
    names = {r.trial for r in grid.collect()}
    assert len(names) == 6 and "config_(hidden_dim=32)_(num_layers=10)" in names
    done = spark.createDataFrame([("config_(hidden_dim=32)_(num_layers=10)",)], "trial string")
    assert tuning.pending_trials(grid, done).count() == 5
    assert tuning.pending_trials(grid, done, "overwrite").count() == 6
    with pytest.raises(ValueError):
        tuning.pending_trials(grid, done, "replace")
    base = grid.withColumn("setting", F.struct(F.struct(F.lit(0).alias("hidden"), F.lit(0.1).alias("rate")).alias("model")))
    nested = tuning.with_settings(base, "setting", {"model.hidden": "hidden_dim"})
    assert {(r.setting.model.hidden, r.setting.model.rate) for r in nested.collect()} == {(32, 0.1), (64, 0.1)}


def test_best_trial_compares_numbers_not_text(spark):
    rows = [("x", "0", "10.5"), ("x", "1", "9.5"), ("x", "2", "9.5"), ("y", "0", "9.75"), ("y", "1", "11.0")]
    df = spark.createDataFrame(rows, "trial string, epoch string, rmse string")
    assert tuple(tuning.best_trial(df).first()) == ("x", 9.5, 1)


def samples(spark, n):
    # target step s of a sample is the context mean plus s / 10
    value = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    context = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((value + i / 100).alias("v")))
    target = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.struct((value + 0.015 + i / 10).alias("v")))
    return spark.range(n).select(F.col("id").cast("string").alias("sample_id"), context.alias("context"), target.alias("target"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))


def test_forecaster_recovers_a_linear_rule(spark):
    df = samples(spark, 400)
    rows = forecast.training_rows(df.filter("split = 'train'"), ["v"], "v")
    model = forecast.fit_forecaster(rows, 2, reg_param=1e-8)
    found = forecast.score_track(model, df, ["v"], "v", "test")
    assert found.count() == 200 and set(found.columns) == {"sample_id", "step", "pred", "truth"}
    assert scores.rmse(found).first().rmse < 1e-4
    by_step = found.groupBy("step").agg(F.avg("pred")).collect()
    assert len(by_step) == 2
    ahead = model.predict(forecast.context_features(df, ["v"]).select("sample_id", "features"))
    assert ahead.columns == ["sample_id", "step", "pred"] and ahead.count() == 800


def test_grid_search_prefers_less_shrinkage(spark):
    rows = forecast.training_rows(samples(spark, 400), ["v"], "v")
    found = forecast.grid_search(rows, rows, 2, {"reg_param": [1e-6, 10.0]}).collect()
    assert len(found) == 2 and min(found, key=lambda r: r.rmse).reg_param == 1e-6


def test_each_step_has_its_own_shape(spark):
    # step 0 repeats the first frame, step 1 mirrors it
    x = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    frame = lambda v: F.struct(v.alias("v"))
    df = spark.range(300).select(F.col("id").cast("string").alias("sample_id"), F.array(frame(x), frame(1 - x * x)).alias("context"), F.array(frame(x), frame(1 - x)).alias("target"))
    rows = forecast.training_rows(df, ["v"], "v")
    found = forecast.fit_forecaster(rows, 2, reg_param=1e-9).predict(rows)
    assert scores.rmse(found).first().rmse < 1e-3


def test_elastic_net_meets_its_conditions():
    rng = np.random.default_rng(3)
    x, n = rng.normal(size=(400, 6)), 400
    y = x[:, :2] @ np.array([[2.0, 0.0], [0.5, -1.0]]) + rng.normal(size=(400, 2)) / 10
    xc, yc = x - x.mean(0), y - y.mean(0)
    m = forecast.Moments(n, x.mean(0), y.mean(0), xc.T @ xc / n, xc.T @ yc / n)
    b, a = m.solve(0.2, 0.5)
    slope = m.xy - m.xx @ b - 0.1 * b
    assert np.allclose(slope[b != 0], 0.1 * np.sign(b[b != 0]), atol=1e-6) and (np.abs(slope[b == 0]) <= 0.1 + 1e-9).all() and (b == 0).any()
    b, a = m.solve(0.2, 0.0)
    assert np.allclose(m.xx @ b + 0.2 * b, m.xy) and np.allclose(a, y.mean(0) - x.mean(0) @ b)


def test_missing_and_scaled_features(spark):
    rows = [("a", [(1.0, N), (3.0, N)], 7.0), ("b", [(N, 4.0), (2.0, 8.0)], N)]
    df = spark.createDataFrame(rows, "sample_id string, context array<struct<v: double, w: double>>, soil double")
    plain = {r.sample_id: r.features for r in forecast.context_features(df, ["v", "w"], ["soil"]).collect()}
    assert plain == {"a": [1.0, 3.0, 0.0, 0.0, 7.0], "b": [2.0, 2.0, 4.0, 8.0, 0.0]}
    stats = spark.createDataFrame([("v", 1.0, 3.0), ("w", 0.0, 8.0), ("soil", 7.0, 7.0)], "band string, min double, max double")
    scaled = {r.sample_id: r.features for r in forecast.context_features(df, ["v", "w"], ["soil"], stats).collect()}
    assert scaled == {"a": [0.0, 1.0, 0.5, 0.5, 0.5], "b": [0.5, 0.5, 0.5, 1.0, 0.5]}
