import datetime

import pytest
from pyspark.sql import functions as F

from pixelseries.functions import bands, columns as C, keys as K


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_key_roundtrip_is_unpadded_and_signed(spark):
    df = spark.createDataFrame([(datetime.date(2018, 3, 7), datetime.date(2019, 11, 30), -6.25, 46.5)], "start date, end date, lon double, lat double")
    name = df.withColumn("name", K.make_key("start", "end", "lon", "lat", F.lit(128), F.lit(64), 18))
    assert name.first().name == "2018_3_7_2019_11_30_-6.25_46.5_128_64_18"
    back = name.select(K.parse_key("name").alias("k")).select("k.*").first()
    assert tuple(back) == (datetime.date(2018, 3, 7), datetime.date(2019, 11, 30), -6.25, 46.5, 128, 64, 18)
    cube = name.select(K.parse_key(K.make_key("start", "end", "lon", "lat", F.lit(128), F.lit(64))).alias("k")).first().k
    assert cube.shift is None and cube.height == 64


@pytest.mark.parametrize("file_name", ["2018_3_7_2019_1_2_6.5_46.5_5_1_0.npz", "exp_2018_3_7_2019_1_2_6.5_46.5_5_1_0.npz", "/a/b/run1_2018_3_7_2019_1_2_6.5_46.5_5_1_0.npz"])
def test_key_body_drops_prefix_and_suffix(spark, file_name):
    assert one(spark, K.key_body(F.lit(file_name))) == "2018_3_7_2019_1_2_6.5_46.5_5_1_0"


def test_normalized_difference(spark):
    assert one(spark, C.normalized_difference(F.lit(3.0), F.lit(1.0))) == 0.5
    assert one(spark, C.normalized_difference(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, C.normalized_difference(F.lit(0.0), F.lit(0.0), 1e-6)) == 0.0


def test_missing_values(spark):
    assert [one(spark, C.to_missing(F.lit(v))) for v in (-9999.0, float("nan"), 1.5)] == [None, None, 1.5]
    assert [one(spark, C.clear_only(F.lit(2.0), F.lit(m))) for m in (0, 1, None)] == [2.0, None, None]
    assert [one(spark, C.vegetation_only(F.lit(2.0), F.lit(c))) for c in (9, 10, 30, 31)] == [None, 2.0, 2.0, None]


def test_lookup_and_geometry(spark):
    assert [one(spark, C.degrees_for_resolution(F.lit(m))) for m in (20, 100, 500, 30)] == [0.00018, 0.0009, 0.0045, None]
    assert one(spark, C.cell_centre(F.lit(3), 10.0, 0.5)) == 11.75 and one(spark, C.cell_index(F.lit(11.75), 10.0, 0.5)) == 3
    assert one(spark, C.northing(F.lit(180.0))) == -1.0 and one(spark, C.easting(F.lit(90.0))) == 1.0


def test_dates(spark):
    day = F.lit(datetime.date(2020, 2, 27))
    assert one(spark, C.forecast_date(day, F.lit(0))) == datetime.date(2020, 3, 3)
    assert [one(spark, C.in_summer(F.lit(datetime.date(2020, m, d)))) for m, d in ((5, 31), (6, 1), (8, 31), (9, 1))] == [False, True, True, False]


def test_transpose_and_bool(spark):
    m = F.array(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(4), F.lit(5), F.lit(6)))
    assert one(spark, C.transpose(m)) == [[1, 4], [2, 5], [3, 6]]
    assert [one(spark, C.to_bool(F.lit(w))) for w in ("Yes", "f", " 1 ", "NO")] == [True, False, True, False]
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, C.to_bool(F.lit("maybe")))


def test_eligible_pixel(spark):
    df = spark.createDataFrame([(1, 0.9, 0.2), (0, 0.9, 0.2), (1, 0.8, 0.2), (1, 0.9, 0.0)], "s int, f double, d double")
    assert df.filter(C.eligible_pixel("s", "f", 0.8)).count() == 2
    assert df.filter(C.eligible_pixel("s", "f", 0.8, "d")).count() == 1


def test_band_selection(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 4.0, 5.0, 0)], "t int, era5_tp double, DEM double, s2_B08 double, s2_B04 double, s2_B03 double, s2_mask int")
    assert bands.canonical_order(df) == ["s2_B08", "s2_B04", "s2_B03", "s2_mask", "DEM", "era5_tp"]
    derived = bands.add_derived_bands(df, ["NDVI", "NDWI", "DEM"])
    assert bands.smoothable_bands(derived) == ["s2_B08", "s2_B04", "s2_B03", "s2_ndvi"]
    assert bands.drop_helper_bands(bands.select_canonical(derived)).columns == ["t", "s2_B08", "s2_B04", "s2_B03", "s2_ndvi", "s2_ndwi", "DEM", "era5_tp"]
    for add, band in ((bands.add_ndvi, "s2_B04"), (bands.add_ndwi, "s2_B03")):
        with pytest.raises(bands.MissingBandError):
            add(df.drop(band))
