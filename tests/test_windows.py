import datetime

import pytest
from pyspark.sql import functions as F

from pixelseries.operators import scores, windows
from pixelseries.sources import store

DAY = datetime.date(2019, 1, 1)


def packed(spark, n, first=DAY, cadence=5, pixel=0):
    rows = [(0, pixel, t, first + datetime.timedelta(days=cadence * t), float(t * t % 11)) for t in range(n)]
    return windows.pack_series(spark.createDataFrame(rows, "scene_id int, pixel_id int, t int, ts date, v double"), ["v"])


def starts(df):
    return sorted(r.start_t for r in df.select("start_t").collect())


@pytest.mark.parametrize("n, shift, count", [(10, 0, 5), (10, 2, 3), (8, 2, 1), (6, 0, 1)])
def test_number_of_windows(spark, n, shift, count):
    found = windows.sliding_windows(packed(spark, n), 4, 2, shift)
    assert starts(found) == list(range(count))
    row = found.filter("start_t = 0").first()
    assert [f.t for f in row.context] == [0, 1, 2, 3] and [f.t for f in row.target] == [4, 5]


def test_too_short_a_series_is_an_error(spark):
    with pytest.raises(Exception, match="shorter"):
        windows.sliding_windows(packed(spark, 7), 4, 2, 2).collect()


def season(spark, df, context=4, target=2, shift=0, compat=False):
    found = windows.season_windows(df, context, target, shift, compat)
    return [(r.start_t, r.target[0].ts) for r in found.orderBy("start_t").collect()]


def test_season_bounds_are_inclusive(spark):
    found = season(spark, packed(spark, 120, first=datetime.date(2019, 5, 28), cadence=1))
    assert found[0][1] == datetime.date(2019, 6, 1) and found[-1][1] == datetime.date(2019, 8, 31)


def test_season_needs_history_and_target(spark):
    # frames 1 June .. 10 July: the first 4 starts lack context, the last lack target + shift
    df = packed(spark, 40, first=datetime.date(2019, 6, 1), cadence=1)
    assert [s for s, _ in season(spark, df, 4, 2, 3)] == list(range(0, 40 - 4 - 2 - 3 + 1))
    assert season(spark, packed(spark, 20, first=datetime.date(2019, 10, 1)), 4, 2) == []


def test_season_compat_drops_the_last_start_of_each_year(spark):
    df = packed(spark, 200)
    every, fewer = season(spark, df), season(spark, df, compat=True)
    years = {d.year for _, d in every}
    last = {max(x for x in every if x[1].year == y) for y in years}
    assert len(years) == 3 and set(every) - set(fewer) == last


def test_last_summer_frame(spark):
    cal = spark.createDataFrame([(datetime.date(2019, 8, 31),), (datetime.date(2019, 9, 1),), (datetime.date(2019, 1, 1),), (datetime.date(2020, 10, 1),)], "ts date")
    assert [tuple(r) for r in windows.last_summer_frame(cal).collect()] == [(2019, 1, datetime.date(2019, 8, 31))]


def test_long_and_packed_samples_hold_the_same_values(spark):
    cut = windows.sliding_windows(packed(spark, 12), 4, 2)
    long = windows.long_samples(cut, ["start_t"]).groupBy("start_t", "part").agg(F.sum("v").alias("s"))
    sums = {(r.start_t, r.part): r.s for r in long.collect()}
    for row in store.pack_samples(cut, ["v"], ["start_t"]).collect():
        assert sum(row.context[0]) == sums[row.start_t, "context"] and sum(row.target[0]) == sums[row.start_t, "target"]


@pytest.mark.parametrize("stride, shift", [(1, 0), (3, 0), (1, 4)])
def test_running_sums_equal_cut_windows(spark, stride, shift):
    both = packed(spark, 40).unionByName(packed(spark, 30, pixel=1))
    series = both.select("scene_id", "pixel_id", F.inline("series"))
    want = scores.baseline_scores(windows.sliding_windows(both, 9, 4, shift, stride), "v").first()
    got = scores.sliding_baseline_scores(series, "v", 9, 4, shift, stride).first()
    assert got.n_samples == want.n_samples
    for name in ("mse_mean", "rmse_mean", "mse_persistence", "rmse_persistence"):
        assert got[name] == pytest.approx(want[name], rel=1e-9)
