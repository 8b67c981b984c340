import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseries.operators import clean, series, weather
from pixelseries.operators.loess import smooth_series

DAY = datetime.date(2020, 1, 1)


def frames(spark, values, pixel=0, scene=0):
    rows = [(scene, pixel, t, DAY + datetime.timedelta(days=5 * t), v) for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "scene_id int, pixel_id int, t int, ts date, v double")


def values_of(df, column="v"):
    return [r[column] for r in df.orderBy("pixel_id", "t").collect()]


N = None


@pytest.mark.parametrize(
    "values, gap, start",
    [
        ([1.0, 2.0, 3.0], 0, 0),
        ([N, N, N], 3, 0),
        ([N, N, 1.0, N], 2, 0),
        ([1.0, N, 2.0, N, N], 2, 3),
        ([1.0, N, N, 2.0, N, N, 3.0], 2, 1),
    ],
)
def test_longest_gap(spark, values, gap, start):
    row = series.longest_gap(frames(spark, values), "v").first()
    assert (row.max_gap, row.gap_start) == (gap, start)


@pytest.mark.parametrize("values, limit, flag", [([1.0, N, N, 2.0], 2, 1), ([1.0, N, N, 2.0], 1, 0), ([N, N], 5, 0), ([1.0, 2.0], 0, 1)])
def test_flag_usable(spark, values, limit, flag):
    found = series.flag_usable(frames(spark, values), "v", limit)
    assert {r.to_sample for r in found.collect()} == {flag}
    assert series.longest_gap(frames(spark, values), "v").first().max_gap <= limit or flag == 0


def test_fill_by_index_holds_ends(spark):
    assert values_of(series.fill_by_index(frames(spark, [N, 1.0, N, N, 4.0, N]), ["v"])) == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert values_of(series.fill_by_index(frames(spark, [N, 7.0, N]), ["v"])) == [7.0, 7.0, 7.0]
    assert values_of(series.fill_by_index(frames(spark, [N, N]), ["v"])) == [N, N]
    assert values_of(series.fill_by_index(frames(spark, [1.0, 5.0, 2.0]), ["v"])) == [1.0, 5.0, 2.0]


def test_fill_by_time_uses_unequal_steps_and_leaves_ends(spark):
    rows = [(0, 0, i, DAY + datetime.timedelta(days=d), v) for i, (d, v) in enumerate([(0, N), (1, 10.0), (2, N), (11, 20.0), (12, N)])]
    df = spark.createDataFrame(rows, "scene_id int, pixel_id int, t int, ts date, v double")
    assert values_of(series.fill_by_time(df, ["v"])) == [N, 10.0, 11.0, 20.0, N]


def test_densify(spark):
    df = frames(spark, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]).filter(F.col("t").isin(1, 4))
    found = series.densify(df, 6, bands=["v"])
    assert values_of(found) == [N, 1.0, N, N, 4.0, N]
    assert [r.t for r in found.orderBy("t").collect()] == list(range(6))
    with pytest.raises(Exception, match="frame outside 0..3"):
        series.densify(df, 4, bands=["v"]).collect()
    with pytest.raises(Exception, match="two rows of one pixel"):
        series.densify(df.unionByName(df), 6, bands=["v"]).collect()


def test_frame_index_and_change(spark):
    found = series.frame_index(frames(spark, [1.0, 3.0, 2.0]).filter("t <> 1"))
    assert sorted((r.t, r.ts) for r in found.collect()) == [(0, DAY), (1, DAY + datetime.timedelta(days=10))]
    assert values_of(series.change(frames(spark, [1.0, 3.0, 2.0]), "v"), "change") == [N, 1.5, 0.0]
    gappy = frames(spark, [1.0, 3.0, 2.0, 4.0]).filter("t <> 1")
    assert values_of(series.change(gappy, "v"), "change") == [N, N, 1.5]


def test_drop_low_values_agrees_with_the_weekly_quantile_without_hash_tables(spark):
    rng = np.random.default_rng(3)
    rows = [(0, p, t, DAY + datetime.timedelta(days=5 * t), N if rng.uniform() < 0.3 else float(rng.integers(0, 9)) + 0.1) for p in range(3) for t in range(150)]
    rows += [(0, 9, t, DAY, v) for t, v in enumerate([N, N])] + [(0, 10, t, DAY, v) for t, v in enumerate([2.0, float("nan"), -float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "scene_id int, pixel_id int, t int, ts date, v double")
    for q in (0.0, 0.05, 0.3, 1.0):
        found = clean.drop_low_values(df, ["v"], q)
        assert "percentile" not in found._jdf.queryExecution().executedPlan().toString()
        limits = clean.weekly_quantile(df, "v", q)
        joined = df.withColumn("week", F.weekofyear("ts")).join(limits, ["scene_id", "pixel_id", "week"])
        expected = joined.select("pixel_id", "t", F.when(F.col("v") >= F.col("q"), F.col("v")).alias("v"))
        assert [str(v) for v in values_of(found)] == [str(v) for v in values_of(expected)]


def test_drop_low_values_keeps_the_quantile_and_pools_years(spark):
    week1 = [datetime.date(y, 3, 3) for y in (2018, 2019, 2020)]  # ISO weeks 9, 9, 10
    rows = [(0, 0, i, d, v) for i, (d, v) in enumerate(zip(week1 + [datetime.date(2021, 1, 1), datetime.date(2020, 12, 31)], [1.0, 2.0, 0.5, 4.0, 3.0]))]
    df = spark.createDataFrame(rows, "scene_id int, pixel_id int, t int, ts date, v double")
    # weeks: 9 pools 1.0 and 2.0, week 10 holds 0.5 alone, week 53 pools 3.0 and 4.0
    assert values_of(clean.drop_low_values(df, ["v"], 0.5)) == [N, 2.0, 0.5, 4.0, N]
    weeks = {r.week: r.q for r in clean.weekly_quantile(df, "v", 0.5).collect()}
    assert weeks == {9: 1.5, 10: 0.5, 53: 3.5}


def reference_loess(y, frac, passes):
    """Point by point with a weighted least-squares solver."""
    n = len(y)
    k = int(frac * n + 1e-10)
    trust = np.ones(n)
    for done in range(passes + 1):
        fitted = np.empty(n)
        left = 0
        for i in range(n):
            while left + k < n and i > (left + left + k) / 2:
                left += 1
            j = np.arange(left, left + k)
            reach = max(i - left, left + k - 1 - i)
            d = abs(j - i) / reach
            w = np.where(d >= 0.999, 0, np.where(d <= 0.001, 1, (1 - d**3) ** 3)) * trust[j]
            slope, level = np.polyfit(j - i, y[j], 1, w=np.sqrt(w)) if (w > 0).sum() > 1 else (0, (w @ y[j]) / w.sum())
            fitted[i] = level
        if done < passes:
            miss = abs(y - fitted)
            u = miss / (6 * np.median(miss))
            u = np.where(u >= 0.999, 1, np.where(u <= 0.001, 0, u))
            trust = (1 - u**2) ** 2
    return fitted


@pytest.mark.parametrize("frac, passes", [(0.2, 0), (0.2, 3), (0.15, 1), (0.16, 3)])
def test_loess_equals_pointwise_fits(spark, frac, passes):
    rng = np.random.default_rng(5)
    y = np.sin(np.arange(60) / 7) + rng.normal(0, 0.2, 60)
    y[30] += 5
    got = values_of(smooth_series(frames(spark, [float(v) for v in y]), ["v"], frac, passes))
    assert np.allclose(got, reference_loess(y, frac, passes), atol=1e-9)


def test_loess_with_weight_on_few_points(spark):
    y = np.zeros(60)  # a median residual of almost nothing: most neighbours lose all weight
    y[::7] = 1e3
    y += np.random.default_rng(2).normal(0, 1e-6, 60)
    for frac in (0.1, 0.3):
        got = values_of(smooth_series(frames(spark, [float(v) for v in y]), ["v"], frac, 3))
        assert np.allclose(got, reference_loess(y, frac, 3), atol=1e-5)


def test_loess_reproduces_lines_and_constants(spark):
    line = [0.5 * t - 3 for t in range(40)]
    assert np.allclose(values_of(smooth_series(frames(spark, line), ["v"], 0.2)), line)
    assert np.allclose(values_of(smooth_series(frames(spark, [2.0] * 40), ["v"], 0.2)), [2.0] * 40)


def test_loess_robust_pass_ignores_an_outlier(spark):
    y = [0.1 * t + 0.01 * (-1) ** t for t in range(60)]
    y[30] += 10
    plain = values_of(smooth_series(frames(spark, y), ["v"], 0.3, 0))
    robust = values_of(smooth_series(frames(spark, y), ["v"], 0.3, 3))
    assert abs(robust[30] - 3.0) < 0.05 < abs(plain[30] - 3.0)


def test_loess_keeps_gappy_unusable_and_other_columns(spark):
    df = frames(spark, [1.0, N, 2.0] * 10).unionByName(frames(spark, [float(t % 2) for t in range(30)], pixel=1))
    df = df.withColumn("ok", F.lit(0)).withColumn("tag", F.concat(F.lit("t"), F.col("t")))
    assert values_of(smooth_series(df, ["v"], 0.3)) [:30] == [1.0, N, 2.0] * 10
    kept = smooth_series(df, ["v"], 0.3, usable="ok")
    assert values_of(kept)[30:] == [float(t % 2) for t in range(30)]
    assert kept.filter("tag <> concat('t', t)").count() == 0


def test_loess_rejects_a_span_below_two(spark):
    with pytest.raises(Exception, match="fewer than 2"):
        smooth_series(frames(spark, [1.0, 2.0, 3.0]), ["v"], 0.3).collect()


def test_weather_goes_to_the_next_frame(spark):
    f = spark.createDataFrame([(1, DAY), (1, DAY + datetime.timedelta(days=3)), (1, DAY + datetime.timedelta(days=9))], "pixel_id int, ts date")
    days = [(-2, 1.0), (0, 2.0), (1, 4.0), (3, 8.0), (3, 9.0), (10, 99.0)]
    w = spark.createDataFrame([(1, DAY + datetime.timedelta(days=d), v) for d, v in days], "pixel_id int, day date, v double").withColumn("m", F.col("v"))
    found = {(r.ts - DAY).days: (r.v, r.m) for r in weather.match_to_frames(w, f, {"v": "sum", "m": "mean"}, keys=["pixel_id"]).collect()}
    assert found == {0: (3.0, 1.5), 3: (21.0, 7.0), 9: (N, N)}


def test_lead_weather(spark):
    df = frames(spark, [1.0, 2.0, 3.0, 4.0])
    assert values_of(weather.lead_weather(df, ["v"], 2)) == [3.0, 4.0, N, N]
    assert values_of(weather.lead_weather(df, ["v"], 0)) == [1.0, 2.0, 3.0, 4.0]
    assert values_of(weather.lead_weather(df.filter("t <> 2"), ["v"], 2)) == [N, 4.0, N]


def test_calendar_weather_is_that_of_its_frames(spark):
    days = spark.range(23).select(F.lit(1).alias("scene_id"), F.lit(1).alias("pixel_id"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("day"), F.col("id").cast("double").alias("era5_tp"))
    days = days.withColumn("era5_t", F.col("era5_tp"))
    calendar = spark.range(5).select(F.lit(1).alias("scene_id"), F.lit(1).alias("pixel_id"), F.col("id").cast("int").alias("t"), F.date_add(F.lit(DAY), (F.col("id") * 5).cast("int")).alias("ts"))
    how = weather.frame_variables(days.columns)
    assert how == {"era5_tp": "sum", "era5_t": "mean"}
    by_frames = weather.match_to_frames(days, calendar, how).join(calendar, ["scene_id", "pixel_id", "ts"])
    by_calendar = weather.match_to_calendar(days, str(DAY), 5, 5, how)
    want = sorted((r.t, r.era5_tp, r.era5_t) for r in by_frames.collect())
    assert want == sorted((r.t, r.era5_tp, r.era5_t) for r in by_calendar.collect()) and len(want) == 5
    with pytest.raises(ValueError, match="era5_x"):
        weather.frame_variables(["era5_x"])


def test_fill_by_time_knows_no_clock_change(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Zurich")
    try:
        times = ["2021-03-27 18:00:00", "2021-03-28 00:00:00", "2021-03-28 06:00:00"]
        df = spark.createDataFrame([(0, 0, i, x, v) for i, (x, v) in enumerate(zip(times, [4.0, N, 8.0]))], "scene_id int, pixel_id int, t int, ts string, v double")
        assert values_of(series.fill_by_time(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["v"])) == [4.0, 6.0, 8.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_best_orbit_lowest_phase_of_equals(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 5, N), (0, 1, 1.0), (0, 6, 1.0), (1, 2, 1.0), (1, 3, 1.0)], "scene_id int, day int, v double")
    assert sorted((r.scene_id, r.day) for r in weather.keep_best_orbit(df, "v").collect()) == [(0, 1), (0, 6), (1, 2)]


def test_fill_static_and_flags(spark):
    df = spark.createDataFrame([(0, 0, -9999.0), (0, 1, 2.0), (0, 2, float("nan")), (0, 3, 4.0), (1, 4, N)], "scene_id int, pixel_id int, a double")
    found = {r.pixel_id: r.a for r in clean.fill_static(df, ["a"]).collect()}
    assert found == {0: 3.0, 1: 2.0, 2: 3.0, 3: 4.0, 4: None}
    flags = spark.createDataFrame([(0, 1, 0)], "scene_id int, pixel_id int, to_sample int")
    assert {r.pixel_id: r.to_sample for r in clean.attach_flag(df, flags).collect()} == {0: 1, 1: 0, 2: 1, 3: 1, 4: 1}
