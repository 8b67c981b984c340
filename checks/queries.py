"""One query per operator over the given tables, each with its reference SQL.

Rounding to zero keeps the sign in SQL but not in Spark, hence ``+ 0.0`` on signed values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelseries.functions import bands as B
from pixelseries.functions import columns as C
from pixelseries.functions import keys as K
from pixelseries.operators import clean, raster, sampling, scores, series, stats, terrain, tuning, weather, windows
from pixelseries.operators.flood import fill_depressions
from pixelseries.operators.layers import Layer, common_grid, mosaic_rasters
from pixelseries.operators.raster import GridMeta
from pixelseries.plans.dataset import DatasetConfig, build_dataset
from pixelseries.plans.forecasting import forecast_scores, search, tune
from pixelseries.plans.incremental import raw_cubes
from pixelseries.session import cut_lineage, scratch_path
from pixelseries.sources import bands as band_source
from pixelseries.sources import scenes as scene_source
from pixelseries.sources import store

from . import fixtures as fx
from .fixtures import Sql, sql

CONTEXT, TARGET = 54, 18
TILE = 48
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


INDEXES = ("t", "start_t", "row", "col")


def query(text: str | None = None):
    """Register a query under its function name, with its SQL if there is one.

    Frame and cell numbers are ints in the library and bigints in the SQL.
    """

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = fn(spark, sf_dir)
            return found.withColumns({c: F.col(c).cast("bigint") for c in INDEXES if c in found.columns})

        QUERIES[fn.__name__] = run
        if text is not None:
            ORACLE[fn.__name__] = text
        return fn

    return register


def r4(column, digits: int = 4):
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


# --- shared inputs -----------------------------------------------------------

def ndvi_frames(spark, sf):
    return B.add_ndvi(fx.frames(spark, sf))


def dense(spark, sf, bands=("s2_B08", "s2_B04", "s2_B03", "s2_mask", "s2_ndvi")):
    found = series.densify(ndvi_frames(spark, sf), fx.N_FRAMES, bands=bands)
    return found.withColumn("ts", fx.frame_date("t"))


def filled_ndvi(spark, sf):
    return series.fill_by_index(dense(spark, sf, ("s2_ndvi",)), ["s2_ndvi"])


def located(df: DataFrame) -> DataFrame:
    return df.withColumns({"lon": 6 + F.col("pixel_id") / 64, "lat": 46 + F.col("pixel_id") / 128})


def named_samples(packed_windows: DataFrame) -> DataFrame:
    """Add place, dates and the sample name."""
    found = located(packed_windows).withColumns({"start": F.col("context")[0]["ts"], "end": F.element_at("target", -1)["ts"]})
    name = K.make_key("start", "end", "lon", "lat", F.lit(5), F.lit(1), 0)
    return found.withColumn("sample_id", name)


def samples(spark, sf):
    packed = windows.pack_series(filled_ndvi(spark, sf), ["s2_ndvi"])
    return named_samples(windows.sliding_windows(packed, CONTEXT, TARGET))


def sample_keys(spark, sf):
    return samples(spark, sf).select("sample_id", "scene_id", "pixel_id", "start_t", "start", "end", "lon", "lat")


def predictions(spark, sf):
    truth = samples(spark, sf).select("sample_id", F.posexplode("target.s2_ndvi").alias("step", "truth"))
    return truth.withColumn("pred", F.col("truth") * (1 + (F.col("step") % 3 - 1) / 100))


def scene_places(spark, sf):
    """Scenes with place; ``bright`` marks those with an above-average near infrared."""
    f = fx.frames(spark, sf)
    overall = f.agg(F.avg("s2_B08")).scalar()
    return (
        f.groupBy("scene_id")
        .agg(F.avg("s2_B08").alias("mean_nir"))
        .select("scene_id", (6 + F.col("scene_id") / 32).alias("lon"), (46 + F.col("scene_id") / 64).alias("lat"), (F.col("mean_nir") > overall).alias("bright"))
    )


def meta_of(spark, sf) -> GridMeta:
    m = fx.grid_side(spark, sf)
    return GridMeta(0.0, float(m), 1.0, 1.0, m, m)


# SQL pieces ------------------------------------------------------------------

def fill_cte(name: str, source: str, value: str, keys: str = "pixel_id", x: str = "t", hold: bool = True, order: str = "t") -> str:
    part = f"PARTITION BY {keys} ORDER BY {order}"
    known = f"CASE WHEN {value} IS NOT NULL THEN {{}} END"
    back, ahead = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    ends = "coalesce(pv, nv)" if hold else "NULL"
    return f"""{name}_n AS (
      SELECT *, last_value({known.format(x)} IGNORE NULLS) OVER ({part} {back}) AS px,
                last_value({value} IGNORE NULLS) OVER ({part} {back}) AS pv,
                first_value({known.format(x)} IGNORE NULLS) OVER ({part} {ahead}) AS nx,
                first_value({value} IGNORE NULLS) OVER ({part} {ahead}) AS nv
      FROM {source}),
    {name} AS (
      SELECT * EXCLUDE (px, pv, nx, nv),
             CASE WHEN {value} IS NOT NULL THEN {value}
                  WHEN px IS NOT NULL AND nx IS NOT NULL THEN pv + (nv - pv) * (CAST({x} - px AS DOUBLE) / (nx - px))
                  ELSE {ends} END AS v
      FROM {name}_n)"""


FILLED = Sql.DENSE + "," + fill_cte("filled", "dense", "s2_ndvi")

PLACE = "6 + pixel_id / 64.0::DOUBLE AS lon, 46 + pixel_id / 128.0::DOUBLE AS lat"


def date_parts(d: str) -> str:
    return f"year({d}) || '_' || month({d}) || '_' || day({d})"


SAMPLE_ID = (
    f"{date_parts('s.start')} || '_' || {date_parts('s.\"end\"')} || '_' || CAST(s.lon AS VARCHAR) || '_' || CAST(s.lat AS VARCHAR) || '_5_1_0'"
)

SAMPLE_KEYS = f"""sample_starts AS (
      SELECT p.scene_id, p.pixel_id, w.start_t, {PLACE},
             DATE '{fx.DAY0}' + CAST(5 * w.start_t AS INTEGER) AS start,
             DATE '{fx.DAY0}' + CAST(5 * (w.start_t + {CONTEXT + TARGET - 1}) AS INTEGER) AS "end"
      FROM (SELECT DISTINCT scene_id, pixel_id FROM frames) p
      CROSS JOIN (SELECT unnest(range({fx.N_FRAMES - CONTEXT - TARGET + 1})) AS start_t) w),
    sample_keys AS (SELECT s.*, {SAMPLE_ID} AS sample_id FROM sample_starts s)"""

SAMPLES = SAMPLE_KEYS + f""",
    sample_frames AS (
      SELECT k.*, f.t - k.start_t AS pos, f.v, f.ts,
             CASE WHEN f.t - k.start_t < {CONTEXT} THEN 'context' ELSE 'target' END AS part,
             CASE WHEN f.t - k.start_t < {CONTEXT} THEN f.t - k.start_t ELSE f.t - k.start_t - {CONTEXT} END AS step
      FROM sample_keys k JOIN filled f ON f.pixel_id = k.pixel_id AND f.t BETWEEN k.start_t AND k.start_t + {CONTEXT + TARGET - 1})"""

PREDICTIONS = SAMPLES + """,
    predictions AS (SELECT sample_id, step, v AS truth, v * (1 + (step % 3 - 1) / 100.0::DOUBLE) AS pred
                    FROM sample_frames WHERE part = 'target')"""

SCENES = """scene_places AS (
      SELECT scene_id, 6 + scene_id / 32.0::DOUBLE AS lon, 46 + scene_id / 64.0::DOUBLE AS lat,
             avg(s2_B08) > (SELECT avg(s2_B08) FROM frames) AS bright
      FROM frames GROUP BY scene_id)"""


def baseline_sql(starts: str) -> str:
    return f"""
    , b_frames AS (SELECT f.pixel_id, s.start_t, f.t - s.start_t AS pos, f.v
                   FROM filled f JOIN ({starts}) s ON f.t BETWEEN s.start_t AND s.start_t + {CONTEXT + TARGET - 1}),
    b_guess AS (SELECT pixel_id, start_t, avg(v) FILTER (pos < {CONTEXT}) AS m, max(v) FILTER (pos = {CONTEXT - 1}) AS l
                FROM b_frames GROUP BY 1, 2),
    b_sample AS (SELECT f.pixel_id, f.start_t, avg((v - m) * (v - m)) AS em, avg((v - l) * (v - l)) AS el
                 FROM b_frames f JOIN b_guess g USING (pixel_id, start_t) WHERE pos >= {CONTEXT} GROUP BY 1, 2)
    SELECT count(*) AS n_samples, round(avg(em), 6) AS mse_mean, round(sqrt(avg(em)), 6) AS rmse_mean,
           round(avg(el), 6) AS mse_persistence, round(sqrt(avg(el)), 6) AS rmse_persistence FROM b_sample"""


def rounded_scores(df):
    return df.select("n_samples", *[r4(c, 6).alias(c) for c in df.columns if c != "n_samples"])


# --- baseline (flagship) -------------------------------------------------------

@query(sql(FILLED, body="").rstrip() + baseline_sql(f"SELECT unnest(range({fx.N_FRAMES - CONTEXT - TARGET + 1})) AS start_t"))
def q_baseline_scores(spark, sf):
    found = scores.sliding_baseline_scores(filled_ndvi(spark, sf), "s2_ndvi", CONTEXT, TARGET)
    return rounded_scores(found)


@query(sql(FILLED, body="").rstrip() + baseline_sql(f"SELECT unnest(range({fx.N_FRAMES - CONTEXT - TARGET + 1})) AS start_t"))
def q_baseline_scores_samples(spark, sf):
    return rounded_scores(scores.baseline_scores(samples(spark, sf), "s2_ndvi"))


# --- bands, keys, lists --------------------------------------------------------

@query(
    sql(
        Sql.FRAMES,
        body="""SELECT scene_id, pixel_id, t, ts, round(s2_B08, 4) AS "s2_B08",
        round((s2_B08 - s2_B04) / (s2_B08 + s2_B04), 4) + 0.0::DOUBLE AS s2_ndvi, round((s2_B08 - s2_B03) / (s2_B08 + s2_B03), 4) + 0.0::DOUBLE AS s2_ndwi,
        round((s2_B08 - s2_B04) / (s2_B08 + s2_B04 + 1e-6), 4) + 0.0::DOUBLE AS ndvi_eps FROM frames""",
    )
)
def q_normalized_difference(spark, sf):
    found = B.add_derived_bands(fx.frames(spark, sf), ["NDVI", "NDWI"])
    found = B.drop_helper_bands(B.select_canonical(found))
    eps = C.normalized_difference("s2_B08", "s2_B04", 1e-6)
    return found.select("scene_id", "pixel_id", "t", "ts", r4("s2_B08").alias("s2_B08"), r4("s2_ndvi").alias("s2_ndvi"), r4("s2_ndwi").alias("s2_ndwi"), r4(eps).alias("ndvi_eps"))


@query(
    sql(
        Sql.FRAMES,
        SAMPLE_KEYS,
        body="""SELECT sample_id, pixel_id, start_t, 'run1_' || sample_id || '.npz' AS file_name, sample_id AS body,
        start, "end", lon, lat, 5 AS width, 1 AS height, 0 AS shift FROM sample_keys""",
    )
)
def q_sample_key_roundtrip(spark, sf):
    named = sample_keys(spark, sf).select("sample_id", "pixel_id", "start_t").withColumn("file_name", F.concat(F.lit("run1_"), "sample_id", F.lit(".npz")))
    return named.withColumn("body", K.key_body("file_name")).withColumn("key", K.parse_key("body")).select("sample_id", "pixel_id", "start_t", "file_name", "body", "key.*")


@query(
    sql(
        Sql.FRAMES,
        SCENES,
        body="SELECT DISTINCT lon, lat FROM scene_places",
    )
)
def q_scene_lists(spark, sf):
    places = scene_places(spark, sf)
    bright, every = places.filter("bright").select("lon", "lat"), places.select("lon", "lat")
    return scene_source.union_scenes(bright, every)


URL = "https://tiles.example.org/dem/elev_{}/elev_{}_2_2056_5728.tif"


@query(
    """WITH u AS (SELECT year(l_shipdate) || '_' || (2600 + l_partkey % 50) || '-' || (1200 + l_suppkey % 20) AS k FROM lineitem)
    SELECT 'elev_' || k || '_2_2056_5728.tif' AS file_name, CAST(split_part(k, '_', 1) AS INTEGER) AS year,
           CAST(split_part(split_part(k, '_', 2), '-', 1) AS INTEGER) AS east_km,
           CAST(split_part(split_part(k, '_', 2), '-', 2) AS INTEGER) AS north_km,
           2.0::DOUBLE AS resolution, 2056 AS epsg, count(*) AS n FROM u GROUP BY ALL"""
)
def q_tile_attributes(spark, sf):
    item = fx.table(spark, sf, "lineitem")
    tile = F.concat(F.year("l_shipdate"), F.lit("_"), 2600 + F.col("l_partkey") % 50, F.lit("-"), 1200 + F.col("l_suppkey") % 20)
    urls = item.select(F.concat(F.lit("https://tiles.example.org/dem/"), tile, F.lit("/elev_"), tile, F.lit("_2_2056_5728.tif")).alias("url"))
    counted = urls.groupBy("url").agg(F.count("*").alias("n"))  # parse each name once
    return scene_source.tile_attributes(counted).drop("url")


@query(
    sql(
        Sql.FRAMES,
        Sql.STATIC_RAW,
        body="""SELECT b.*, CASE WHEN provider = 'Sentinel 2' THEN 'linear' ELSE 'nearest' END AS interpolation,
          CASE b.metres WHEN 20 THEN 0.00018::DOUBLE END AS degrees FROM (
          SELECT 57 AS ord, 'NDVI' AS band, count(*) AS n, 'vegetation index from red and near infrared' AS description, 'satellite' AS source, 'Sentinel 2' AS provider, 20 AS metres FROM frames
          UNION ALL SELECT 36, 'DEM', count(*) FILTER ("DEM" <> -9999), 'height above sea level on cells of 20 m', 'elevation model', 'Local data', 20 FROM static_raw
          UNION ALL SELECT 0, 'CLAY0_5', count(*) FILTER ("CLAY0_5" <> -9999), 'share of clay in percent, 0 to 5 cm deep', 'soil maps', 'Local data', 20 FROM static_raw) b""",
    )
)
def q_band_dictionary(spark, sf):
    ndvi = ndvi_frames(spark, sf).select(F.lit("NDVI").alias("band"), F.col("s2_ndvi").alias("v"))
    layers = B.clean_missing(fx.static_raw(spark, sf), ["DEM", "CLAY0_5"]).unpivot(["pixel_id"], ["DEM", "CLAY0_5"], "band", "v")
    found = ndvi.unionByName(layers.select("band", "v")).groupBy("band").agg(F.count("v").alias("n"))
    return band_source.band_attributes(found, band_source.band_dictionary(spark)).withColumn("metres", F.lit(20)).withColumn("degrees", C.degrees_for_resolution("metres"))


@query(
    sql(
        Sql.FRAMES,
        SCENES,
        body="""SELECT f.scene_id, min(ts) AS start, max(ts) AS "end", CAST(max(x) - min(x) + 1 AS INTEGER) AS width,
        CAST(max(y) - min(y) + 1 AS INTEGER) AS height, any_value(lon) AS lon, any_value(lat) AS lat,
        CASE WHEN any_value(bright) THEN 'reuse' ELSE 'build' END AS action
        FROM frames f JOIN scene_places USING (scene_id) GROUP BY 1""",
    )
)
def q_catalogue_lookup(spark, sf):
    places = scene_places(spark, sf)
    requests = store.cube_catalogue(fx.frames(spark, sf)).join(places, "scene_id")
    existing = requests.filter("bright")
    wanted = requests.drop("bright")
    return store.reusable(wanted, existing).withColumn("action", F.lit("reuse")).unionByName(store.to_build(wanted, existing).withColumn("action", F.lit("build")))


@query(
    sql(
        Sql.FRAMES,
        SCENES,
        body="""SELECT CAST(scene_id AS BIGINT) AS scene_id, CASE WHEN bright THEN 1 ELSE 2 END AS run, count(*) AS n, round(sum(s2_B08), 4) AS total FROM frames JOIN scene_places USING (scene_id) GROUP BY 1, 2""",
    )
)
def q_incremental_build(spark, sf):
    """Raw cubes of the bright scenes, then of all: the second run reads and writes the others alone."""
    frames, folder = fx.frames(spark, sf), scratch_path(spark)
    requests = cut_lineage(store.cube_catalogue(frames).join(scene_places(spark, sf), "scene_id"))
    for run, wanted in ((1, requests.filter("bright")), (2, requests)):
        found = raw_cubes(wanted, frames.withColumn("run", F.lit(run)), folder, "train")
    return found.groupBy(F.col("scene_id").cast("bigint").alias("scene_id"), "run").agg(F.count("*").alias("n"), r4(F.sum("s2_B08")).alias("total"))


# --- missing values and cleaning -------------------------------------------------

@query(
    sql(
        Sql.FRAMES,
        Sql.STATIC_RAW,
        body="""SELECT a.*, b.dem_known, b.dem_any_missing FROM (
          SELECT pixel_id, count(*) AS n, count(*) FILTER (s2_mask = 0) AS n_clear, bool_or(s2_mask <> 0) AS any_cloudy,
                 count(*) FILTER (s2_mask = 0) = 0 AS all_cloudy, round(avg(s2_B08) FILTER (s2_mask = 0), 4) AS mean_clear FROM frames GROUP BY 1) a
          LEFT JOIN (SELECT pixel_id, count(*) FILTER ("DEM" <> -9999) AS dem_known, bool_or("DEM" = -9999) AS dem_any_missing FROM static_raw GROUP BY 1) b USING (pixel_id)""",
    )
)
def q_nodata_cloud_mask(spark, sf):
    clear = clean.mask_clouds(fx.frames(spark, sf), ["s2_B08"])
    found = clear.groupBy("pixel_id").agg(
        F.count("*").alias("n"),
        F.count("s2_B08").alias("n_clear"),
        B.any_missing("s2_B08").alias("any_cloudy"),
        B.all_missing("s2_B08").alias("all_cloudy"),
        r4(F.avg("s2_B08")).alias("mean_clear"),
    )
    dem = B.clean_missing(fx.static_raw(spark, sf), ["DEM"]).groupBy("pixel_id").agg(F.count("DEM").alias("dem_known"), B.any_missing("DEM").alias("dem_any_missing"))
    return found.join(dem, "pixel_id", "left")


QUANTILE = Sql.FRAMES + """, clear AS (
      SELECT *, CASE WHEN s2_mask = 0 THEN s2_B08 END AS c, week(ts) AS wk FROM frames),
    quant AS (SELECT scene_id, pixel_id, wk, quantile_cont(c, 0.05) AS q, count(c) AS n FROM clear GROUP BY 1, 2, 3)"""


@query(sql(QUANTILE, body="SELECT scene_id, pixel_id, CAST(wk AS INTEGER) AS week, round(q, 4) AS q, n FROM quant"))
def q_weekly_quantile(spark, sf):
    clear = clean.mask_clouds(fx.frames(spark, sf), ["s2_B08"])
    return clean.weekly_quantile(clear, "s2_B08", 0.05).withColumn("q", r4("q"))


@query(
    sql(
        QUANTILE,
        body="""SELECT scene_id, pixel_id, t, ts, round(CASE WHEN c >= q THEN c END, 4) AS "s2_B08"
        FROM clear JOIN quant USING (scene_id, pixel_id, wk)""",
    )
)
def q_low_value_removal(spark, sf):
    clear = clean.mask_clouds(fx.frames(spark, sf), ["s2_B08"])
    return clean.drop_low_values(clear, ["s2_B08"], 0.05).select("scene_id", "pixel_id", "t", "ts", r4("s2_B08").alias("s2_B08"))


@query(
    sql(
        Sql.DENSE,
        body="""SELECT scene_id, pixel_id, coalesce(max(len), 0) AS max_gap, coalesce(arg_min(b, -len * 1000 + b), 0) AS gap_start,
             max(n_known) AS n_known, CASE WHEN coalesce(max(len), 0) <= 8 AND max(n_known) > 0 THEN 1 ELSE 0 END AS to_sample
        FROM (SELECT scene_id, pixel_id, grp, CASE WHEN bool_or(clear IS NULL) THEN count(*) FILTER (clear IS NULL) END AS len,
                     min(t) FILTER (clear IS NULL) AS b, max(nk) AS n_known
              FROM (SELECT *, count(clear) OVER (PARTITION BY pixel_id ORDER BY t) AS grp, count(clear) OVER (PARTITION BY pixel_id) AS nk
                    FROM (SELECT *, CASE WHEN s2_mask = 0 THEN s2_ndvi END AS clear FROM dense)) GROUP BY 1, 2, 3)
        GROUP BY 1, 2""",
    )
)
def q_longest_gap(spark, sf):
    clear = clean.mask_clouds(dense(spark, sf), ["s2_ndvi"])
    gaps = series.longest_gap(clear, "s2_ndvi")
    flags = series.flag_usable(clear, "s2_ndvi", 8).groupBy("scene_id", "pixel_id").agg(F.max("to_sample").alias("to_sample"))
    return clean.attach_flag(gaps, flags)


@query(sql(FILLED, body="SELECT scene_id, pixel_id, t, round(v, 4) + 0.0::DOUBLE AS s2_ndvi FROM filled"))
def q_interp_clamped(spark, sf):
    return filled_ndvi(spark, sf).select("scene_id", "pixel_id", "t", r4("s2_ndvi").alias("s2_ndvi"))


@query(
    sql(
        Sql.WEATHER,
        "w2 AS (SELECT pixel_id, day, datediff('day', DATE '1970-01-01', day) AS t, CASE WHEN era5_tp >= 12 THEN era5_t END AS era5_t FROM weather)",
        fill_cte("f", "w2", "era5_t", hold=False),
        body="SELECT pixel_id, day, round(v, 4) AS era5_t FROM f",
    )
)
def q_interp_time(spark, sf):
    readings = fx.weather(spark, sf).select("pixel_id", "day", F.unix_date("day").alias("t"), F.when(F.col("era5_tp") >= 12, F.col("era5_t")).alias("era5_t"))
    return series.fill_by_time(readings, ["era5_t"], keys=("pixel_id",), ts="day").select("pixel_id", "day", r4("era5_t").alias("era5_t"))


def loess_cte(name: str, source: str, value: str, passes: int, n: int = fx.N_FRAMES, frac: float = 0.07) -> str:
    """``name(pixel_id, t, y, f)``: local linear fit with bisquare refits, one self-join per pass."""
    k = int(frac * n + 1e-10)
    left = f"least(greatest(CAST(ceil(i.t - {k} / 2.0) AS BIGINT), 0), {n - k})"
    parts = [f"{name}_0 AS (SELECT pixel_id, t, {value} AS y, 1.0::DOUBLE AS rw FROM {source})"]
    for p in range(passes + 1):
        src = f"{name}_{p}"
        parts.append(
            f"""{name}_w{p} AS (
          SELECT pixel_id, t, y, yj, dx, CASE WHEN share >= 0.999 THEN 0 WHEN share <= 0.001 THEN rw ELSE rw * pow(1 - share * share * share, 3) END AS w
          FROM (SELECT i.pixel_id, i.t, i.y, j.y AS yj, j.rw, CAST(j.t - i.t AS DOUBLE) AS dx,
                       abs(j.t - i.t) / CAST(greatest(i.t - i.l, i.l + {k - 1} - i.t) AS DOUBLE) AS share
                FROM (SELECT i.*, {left} AS l FROM {src} i) i JOIN {src} j ON j.pixel_id = i.pixel_id AND j.t BETWEEN i.l AND i.l + {k - 1})),
        {name}_f{p} AS (
          SELECT pixel_id, t, y, CASE WHEN s0 > 0 THEN sy / s0 - sx / s0 * (sxy - sx / s0 * sy) / greatest(sxx - sx * sx / s0, 1e-12 * s0) ELSE y END AS f
          FROM (SELECT pixel_id, t, any_value(y) AS y, sum(w) AS s0, sum(w * dx) AS sx, sum(w * dx * dx) AS sxx, sum(w * yj) AS sy, sum(w * dx * yj) AS sxy
                FROM {name}_w{p} GROUP BY 1, 2))"""
        )
        if p < passes:
            parts.append(
                f"""{name}_{p + 1} AS (
          SELECT pixel_id, t, y, pow(1 - u * u, 2) AS rw FROM (
            SELECT *, CASE WHEN u0 >= 0.999 THEN 1 WHEN u0 <= 0.001 THEN 0 ELSE u0 END AS u FROM (
              SELECT r.pixel_id, r.t, r.y, CASE WHEN m > 0 THEN abs(r.y - r.f) / (6 * m) WHEN r.y <> r.f THEN 1 ELSE 0 END AS u0
              FROM {name}_f{p} r JOIN (SELECT pixel_id, quantile_cont(abs(y - f), 0.5) AS m FROM {name}_f{p} GROUP BY 1) q USING (pixel_id))))"""
            )
    parts.append(f"{name} AS (SELECT * FROM {name}_f{passes})")
    return ", ".join(parts)


def _loess(spark, sf, passes):
    from pixelseries.operators.loess import smooth_series

    return smooth_series(filled_ndvi(spark, sf), ["s2_ndvi"], 0.07, passes).select("pixel_id", "t", r4("s2_ndvi").alias("s2_ndvi"))


def _loess_sql(passes):
    return sql(FILLED, loess_cte("lo", "filled", "v", passes), body="SELECT pixel_id, t, round(f, 4) + 0.0::DOUBLE AS s2_ndvi FROM lo")


@query(_loess_sql(0))
def q_loess_plain(spark, sf):
    return _loess(spark, sf, 0)


@query(_loess_sql(1))
def q_loess_one_pass(spark, sf):
    return _loess(spark, sf, 1)


@query(_loess_sql(3))
def q_loess(spark, sf):
    return _loess(spark, sf, 3)


def clean_cte(max_gap: int) -> str:
    """``cd`` masked values, ``cs`` flags per pixel, ``co`` smoothed series."""
    return (
        Sql.DENSE
        + f""", cl AS (SELECT *, CASE WHEN s2_mask = 0 THEN s2_ndvi END AS c, week(ts) AS wk FROM dense),
    cq AS (SELECT pixel_id, wk, quantile_cont(c, 0.05) AS q FROM cl GROUP BY 1, 2),
    cd AS (SELECT scene_id, pixel_id, t, CASE WHEN c >= q THEN c END AS d FROM cl JOIN cq USING (pixel_id, wk)),
    cr AS (SELECT pixel_id, grp, count(*) FILTER (d IS NULL) AS len, count(d) AS k
           FROM (SELECT *, count(d) OVER (PARTITION BY pixel_id ORDER BY t) AS grp FROM cd) GROUP BY 1, 2),
    cs AS (SELECT pixel_id, CASE WHEN max(len) <= {max_gap} AND sum(k) > 0 THEN 1 ELSE 0 END AS to_sample FROM cr GROUP BY 1),
    """
        + fill_cte("ci", "cd", "d")
        + ","
        + loess_cte("co", "ci", "v", 3)
    )


@query(
    sql(
        clean_cte(12),
        body="""SELECT pixel_id, t, to_sample, round(CASE WHEN to_sample = 1 THEN f ELSE d END, 4) + 0.0::DOUBLE AS s2_ndvi
        FROM co JOIN cd USING (pixel_id, t) JOIN cs USING (pixel_id)""",
    )
)
def q_clean_chain(spark, sf):
    found = clean.clean_series(dense(spark, sf, ("s2_ndvi", "s2_mask")), max_gap=12, remove_pct=0.05, loess_frac=0.07)
    return found.select("pixel_id", "t", "to_sample", r4("s2_ndvi").alias("s2_ndvi"))


@query(
    sql(
        Sql.STATIC_RAW,
        body="""SELECT scene_id, pixel_id, cell_id,
          round(coalesce(nullif("DEM", -9999), avg(nullif("DEM", -9999)) OVER (PARTITION BY scene_id)), 4) AS "DEM",
          round(coalesce(nullif("CLAY0_5", -9999), avg(nullif("CLAY0_5", -9999)) OVER (PARTITION BY scene_id)), 4) AS "CLAY0_5" FROM static_raw""",
    )
)
def q_static_fill(spark, sf):
    found = clean.fill_static(fx.static_raw(spark, sf), ["DEM", "CLAY0_5"])
    return found.select("scene_id", "pixel_id", "cell_id", r4("DEM").alias("DEM"), r4("CLAY0_5").alias("CLAY0_5"))


# --- statistics ----------------------------------------------------------------

BAND_STATS = Sql.FRAMES + """, band_rows AS (
      SELECT scene_id, 's2_B08' AS band, s2_B08 AS v FROM frames UNION ALL SELECT scene_id, 's2_B04', s2_B04 FROM frames
      UNION ALL SELECT scene_id, 's2_B03', s2_B03 FROM frames)"""


@query(
    sql(
        BAND_STATS,
        body="""SELECT CAST(scene_id AS BIGINT) AS scene_id, band, round(min(v), 4) AS "min", round(max(v), 4) AS "max" FROM band_rows GROUP BY 1, 2
        UNION ALL SELECT -1, band, round(min(v), 4), round(max(v), 4) FROM band_rows GROUP BY 2""",
    )
)
def q_band_minmax(spark, sf):
    per_scene = stats.band_stats(fx.frames(spark, sf), fx.BANDS)
    overall = stats.global_stats(per_scene).withColumn("scene_id", F.lit(-1).cast("bigint"))
    both = per_scene.unionByName(overall)
    return both.select("scene_id", "band", r4("min").alias("min"), r4("max").alias("max"))


@query(
    sql(
        Sql.FRAMES,
        body="""SELECT pixel_id, t, """
        + ", ".join(f'round(({b} - min({b}) OVER ()) / (max({b}) OVER () - min({b}) OVER ()), 4) AS "{b}"' for b in fx.BANDS)
        + " FROM frames",
    )
)
def q_minmax_normalise(spark, sf):
    f = fx.frames(spark, sf)
    found = stats.normalise(f, fx.BANDS, stats.band_stats(f, fx.BANDS))
    return found.select("pixel_id", "t", *[r4(b).alias(b) for b in fx.BANDS])


# --- windows ---------------------------------------------------------------------

@query(
    sql(
        FILLED,
        SAMPLES,
        body=f"""SELECT sample_id, scene_id, pixel_id, start_t, part, step, ts, round(v, 4) + 0.0::DOUBLE AS s2_ndvi FROM sample_frames""",
    )
)
def q_sliding_windows(spark, sf):
    cut = samples(spark, sf)
    long = windows.long_samples(cut, ["sample_id", "scene_id", "pixel_id", "start_t"])
    step = F.when(F.col("part") == "context", F.col("step")).otherwise(F.col("step") - CONTEXT)
    return long.select("sample_id", "scene_id", "pixel_id", "start_t", "part", step.cast("bigint").alias("step"), "ts", r4("s2_ndvi").alias("s2_ndvi"))


@query(
    sql(
        FILLED,
        SAMPLES,
        body=f"""SELECT sample_id, {CONTEXT} AS n_context, {TARGET} AS n_target, 1 AS n_bands,
          round(max(v) FILTER (part = 'context' AND step = 0), 4) + 0.0::DOUBLE AS first_context, round(max(v) FILTER (part = 'context' AND step = {CONTEXT - 1}), 4) + 0.0::DOUBLE AS last_context,
          round(max(v) FILTER (part = 'target' AND step = {TARGET - 1}), 4) + 0.0::DOUBLE AS last_target, round(sum(v), 4) + 0.0::DOUBLE AS total
        FROM sample_frames GROUP BY 1""",
    )
)
def q_packed_samples(spark, sf):
    packed = store.pack_samples(samples(spark, sf), ["s2_ndvi"], ["sample_id"])
    by_time = packed.withColumns({"ct": C.transpose("context"), "tt": C.transpose("target")})

    def add(m):
        return F.aggregate(m, F.lit(0.0), lambda a, row: a + row[0])

    return by_time.select(
        "sample_id",
        F.size("ct").alias("n_context"),
        F.size("tt").alias("n_target"),
        F.size("context").alias("n_bands"),
        r4(F.col("ct")[0][0]).alias("first_context"),
        r4(F.element_at("ct", -1)[0]).alias("last_context"),
        r4(F.element_at("tt", -1)[0]).alias("last_target"),
        r4(add(F.col("ct")) + add(F.col("tt"))).alias("total"),
    )


def season_sql(shift: int, compat: bool) -> str:
    keep = "AND EXISTS (SELECT 1 FROM starts u WHERE u.start_t = s.start_t + 1 AND year(u.target_date) = year(s.target_date))" if compat else ""
    return sql(
        Sql.FRAMES,
        f"""starts AS (SELECT start_t, DATE '{fx.DAY0}' + CAST(5 * (start_t + {CONTEXT}) AS INTEGER) AS target_date
          FROM (SELECT unnest(range({fx.N_FRAMES - CONTEXT - TARGET - shift + 1})) AS start_t)
          WHERE month(DATE '{fx.DAY0}' + CAST(5 * (start_t + {CONTEXT}) AS INTEGER)) BETWEEN 6 AND 8)""",
        body=f"""SELECT p.scene_id, p.pixel_id, s.start_t, s.target_date, {CONTEXT} AS n_context, {TARGET} AS n_target
        FROM (SELECT DISTINCT scene_id, pixel_id FROM frames) p CROSS JOIN starts s WHERE true {keep}""",
    )


def _season(spark, sf, shift, compat):
    packed = windows.pack_series(dense(spark, sf, ("s2_ndvi",)), ["s2_ndvi"])
    cut = windows.season_windows(packed, CONTEXT, TARGET, shift, compat)
    return cut.select("scene_id", "pixel_id", "start_t", F.col("target")[0]["ts"].alias("target_date"), F.size("context").alias("n_context"), F.size("target").alias("n_target"))


@query(season_sql(18, False))
def q_season_windows(spark, sf):
    return _season(spark, sf, 18, False)


@query(season_sql(18, True))
def q_season_windows_compat(spark, sf):
    return _season(spark, sf, 18, True)


@query(
    sql(
        Sql.FRAMES,
        body="""SELECT scene_id, CAST(year(ts) AS INTEGER) AS year, count(DISTINCT ts) - 1 AS idx, max(ts) AS ts FROM frames WHERE month(ts) < 9 GROUP BY 1, 2""",
    )
)
def q_season_last_frame(spark, sf):
    return windows.last_summer_frame(fx.frames(spark, sf), keys=("scene_id",)).orderBy("scene_id", "year")


@query(
    sql(
        Sql.FRAMES,
        body="""SELECT scene_id, ts, dense_rank() OVER (PARTITION BY scene_id ORDER BY ts) - 1 AS t FROM (SELECT DISTINCT scene_id, ts FROM frames)""",
    )
)
def q_frame_index(spark, sf):
    return series.frame_index(fx.frames(spark, sf))


# --- weather ---------------------------------------------------------------------

RESAMPLED = Sql.FRAMES + "," + Sql.WEATHER + """, wf AS (
      SELECT f.scene_id, f.pixel_id, f.t, f.ts, sum(w.era5_tp) AS era5_tp, max(w.era5_maxt) AS era5_maxt, min(w.era5_mint) AS era5_mint, avg(w.era5_t) AS era5_t,
        avg(w.era5_sp) AS era5_sp, sum(w.era5_sr) AS era5_sr, avg(w.era5_ap) AS era5_ap, avg(w.era5_dp) AS era5_dp
      FROM (SELECT *, lag(ts) OVER (PARTITION BY pixel_id ORDER BY ts) AS prev FROM frames) f
      LEFT JOIN weather w ON w.pixel_id = f.pixel_id AND w.day <= f.ts AND (f.prev IS NULL OR w.day > f.prev)
      GROUP BY 1, 2, 3, 4)"""

VARIABLES = ["era5_tp", "era5_maxt", "era5_mint", "era5_t", "era5_sp", "era5_sr", "era5_ap", "era5_dp"]


def weather_frames(spark, sf):
    readings = fx.weather(spark, sf)
    return weather.match_to_frames(readings, fx.frames(spark, sf), weather.frame_variables(readings.columns))


@query(sql(RESAMPLED, body=f"SELECT pixel_id, ts, {', '.join(f'round({v}, 4) AS {v}' for v in VARIABLES)} FROM wf"))
def q_weather_resample(spark, sf):
    return weather_frames(spark, sf).select("pixel_id", "ts", *[r4(v).alias(v) for v in VARIABLES])


@query(
    sql(
        RESAMPLED,
        body="""SELECT f.scene_id, f.x AS pixel_id, f.t, f.s2_mask, round(b.era5_tp, 4) AS era5_tp, round(b.era5_t, 4) AS era5_t
          FROM frames f LEFT JOIN wf b ON b.pixel_id = f.pixel_id AND b.t = f.t + 18""",
    )
)
def q_weather_lead(spark, sf):
    # pixels numbered anew in each scene, frames with gaps
    local = lambda df: df.withColumn("pixel_id", F.col("pixel_id") % 5)
    readings, frames = local(fx.weather(spark, sf)), local(fx.frames(spark, sf))
    matched = weather.match_to_frames(readings, frames, weather.frame_variables(readings.columns))
    led = weather.lead_weather(frames.join(matched, ["scene_id", "pixel_id", "ts"]), ["era5_tp", "era5_t"], 18)
    return led.select("scene_id", "pixel_id", "t", "s2_mask", r4("era5_tp").alias("era5_tp"), r4("era5_t").alias("era5_t"))


@query(
    sql(
        f"raw AS (SELECT (o_custkey % {Sql.P}) // 5 AS scene_id, datediff('day', DATE '{fx.DAY0}', CAST(o_orderdate AS DATE)) AS day, o_totalprice FROM orders)",
        "ph AS (SELECT scene_id, day % 5 AS phase, count(*) FILTER (o_totalprice > 50000) AS n_valid FROM raw GROUP BY 1, 2)",
        "best AS (SELECT scene_id, arg_min(phase, -n_valid * 10 + phase) AS phase FROM ph GROUP BY 1)",
        body="""SELECT raw.scene_id, CAST(day AS INTEGER) AS day, count(*) AS n FROM raw JOIN best ON best.scene_id = raw.scene_id AND raw.day % 5 = best.phase
        GROUP BY raw.scene_id, day""",
    )
)
def q_frame_cadence(spark, sf):
    p = fx.pixel_count(spark, sf)
    raw = fx.table(spark, sf, "orders").select(
        F.floor((F.col("o_custkey") % p) / 5).alias("scene_id"),
        fx.day_of("o_orderdate").alias("day"),
        F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice")).alias("v"),
    )
    return weather.keep_best_orbit(raw, "v").groupBy("scene_id", "day").agg(F.count("*").alias("n"))


# --- sampling --------------------------------------------------------------------

MASKS = Sql.GRID + f""", masks AS (
      SELECT "row", col, f AS forest, CASE WHEN ("row" + col) % 3 <> 0 THEN 0 ELSE f / 2 END AS drought
      FROM (SELECT "row", col, (z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) AS f FROM grid)),
    placed AS (SELECT *, 6 + (col + 0.5::DOUBLE) * 0.03125 AS lon, 48 - ("row" + 0.5::DOUBLE) * 0.03125 AS lat,
                      md5(concat_ws(':', '7', "row", col)) AS h FROM masks)"""


def masks(spark, sf):
    forest = raster.rescale01(fx.grid(spark, sf)).withColumnRenamed("z", "forest")
    drought = forest.select("row", "col", F.when((F.col("row") + F.col("col")) % 3 != 0, 0.0).otherwise(F.col("forest") / 2).alias("drought"))
    m = fx.grid_side(spark, sf)
    return sampling.scene_cells(forest, drought), GridMeta(6.0, 48.0, 0.03125, 0.03125, m, m)


@query(sql(MASKS, body="""SELECT "row", col, round(forest, 4) AS forest, round(drought, 4) AS drought, lon, lat FROM placed WHERE forest > 0.3 AND drought > 0.2 ORDER BY h LIMIT 40"""))
def q_positive_scenes(spark, sf):
    cells, meta = masks(spark, sf)
    return sampling.positive_scenes(cells, meta, 0.3, 0.2, 40, seed=7).select("row", "col", r4("forest").alias("forest"), r4("drought").alias("drought"), "lon", "lat")


@query(
    sql(
        MASKS,
        body=f"""SELECT "row", col, round(forest, 4) AS forest, lon, lat, sx AS seg_x, sy AS seg_y FROM (
          SELECT *, row_number() OVER (PARTITION BY sx, sy ORDER BY h) AS rn FROM (
            SELECT *, col // ({Sql.M} // 3) AS sx, "row" // ({Sql.M} // 2) AS sy FROM placed WHERE forest > 0.3 AND drought = 0) WHERE sx < 3 AND sy < 2) WHERE rn <= 9""",
    )
)
def q_negative_scenes_stratified(spark, sf):
    cells, meta = masks(spark, sf)
    return sampling.negative_scenes(cells, meta, 0.3, 50, seed=7).select("row", "col", r4("forest").alias("forest"), "lon", "lat", "seg_x", "seg_y")


@query(
    sql(
        Sql.FRAMES,
        Sql.STATIC_RAW,
        f"""elig AS (SELECT f.scene_id, f.pixel_id FROM (SELECT scene_id, pixel_id, count(*) FILTER (s2_mask = 0) AS n FROM frames GROUP BY 1, 2) f
             JOIN (SELECT pixel_id, avg(nullif("CLAY0_5", -9999)) AS clay FROM static_raw GROUP BY 1) s USING (pixel_id)
             WHERE n > 20 AND clay > 25),
          starts AS (SELECT unnest(range({fx.N_FRAMES - CONTEXT - TARGET + 1})) AS start_t)""",
        body="""SELECT scene_id, start_t, pixel_id FROM (
          SELECT *, row_number() OVER (PARTITION BY scene_id, start_t ORDER BY md5(concat_ws(':', '3', scene_id, start_t, pixel_id))) AS rn FROM elig CROSS JOIN starts) WHERE rn <= 2""",
    )
)
def q_pixels_per_scene(spark, sf):
    usable = fx.frames(spark, sf).groupBy("scene_id", "pixel_id").agg((F.count(F.when(F.col("s2_mask") == 0, 1)) > 20).cast("int").alias("to_sample"))
    forest = B.clean_missing(fx.static_raw(spark, sf), ["CLAY0_5"]).groupBy("pixel_id").agg(F.avg("CLAY0_5").alias("forest"))
    eligible = usable.join(forest, "pixel_id").filter(C.eligible_pixel("to_sample", "forest", 25.0))
    starts = F.sequence(F.lit(0), F.lit(fx.N_FRAMES - CONTEXT - TARGET))
    candidates = eligible.select("scene_id", "pixel_id", F.explode(starts).alias("start_t"))
    return sampling.draw_pixels(candidates, 2, seed=3).select("scene_id", "start_t", "pixel_id")


@query(
    sql(
        Sql.FRAMES,
        SAMPLE_KEYS,
        body="""SELECT sample_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', sample_id)), sample_id) <= (SELECT CAST(floor(0.05 * count(*)) AS BIGINT) FROM sample_keys) AS is_val
        FROM sample_keys""",
    )
)
def q_val_split(spark, sf):
    return sampling.validation_split(sample_keys(spark, sf).select("sample_id"), 0.05, seed=42)


BBOX = [6.0, 46.0, 6.2, 46.1]
TIMES = ["1996-01-01", "2000-12-31"]
IN_RANGE = f"lon BETWEEN {BBOX[0]} AND {BBOX[2]} AND lat BETWEEN {BBOX[1]} AND {BBOX[3]} AND start >= DATE '{TIMES[0]}' AND \"end\" <= DATE '{TIMES[1]}'"


@query(sql(Sql.FRAMES, SAMPLE_KEYS, body=f"SELECT sample_id, start, \"end\", lon, lat, CASE WHEN {IN_RANGE} THEN 'train' ELSE 'test' END AS split FROM sample_keys"))
def q_bbox_time_split(spark, sf):
    return sampling.split_by_range(sample_keys(spark, sf), BBOX, TIMES).select("sample_id", "start", "end", "lon", "lat", "split")


@query(
    sql(
        Sql.FRAMES,
        """st AS (SELECT pixel_id, min(ts) AS start, max(ts) AS "end", round(min(s2_B08), 4) AS lo, round(max(s2_B08), 4) AS hi, 6 + pixel_id / 64.0::DOUBLE AS lon, 46 + pixel_id / 128.0::DOUBLE AS lat FROM frames GROUP BY pixel_id)""",
        body=f"""SELECT pixel_id, lo, hi, unnest(CASE WHEN lon BETWEEN {BBOX[0]} AND {BBOX[2]} AND lat BETWEEN {BBOX[1]} AND {BBOX[3]} THEN ['train', 'test'] ELSE ['unused'] END) AS split FROM st""",
    )
)
def q_stats_routing(spark, sf):
    f = fx.frames(spark, sf)
    found = located(f.groupBy("pixel_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), r4(F.min("s2_B08")).alias("lo"), r4(F.max("s2_B08")).alias("hi")))
    return sampling.route_stats(found, bbox=BBOX).select("pixel_id", "lo", "hi", "split")


@query(sql(Sql.FRAMES, SCENES, SAMPLE_KEYS, body="""SELECT sample_id, scene_id, CASE WHEN scene_id IN (SELECT scene_id FROM scene_places WHERE bright) THEN 'kept' ELSE 'purged' END AS state FROM sample_keys"""))
def q_keep_list_purge(spark, sf):
    keep = scene_places(spark, sf).filter("bright")
    every = sample_keys(spark, sf).select("sample_id", "scene_id")
    kept = sampling.keep_listed(every, keep).withColumn("state", F.lit("kept"))
    return kept.unionByName(sampling.purged(every, keep).withColumn("state", F.lit("purged")))


@query(sql(Sql.FRAMES, SAMPLE_KEYS, body="SELECT scene_id, count(*) AS n FROM sample_keys WHERE NOT (lon > 6.1 AND lat < 46.12) GROUP BY 1"))
def q_half_plane_purge(spark, sf):
    left = sampling.drop_half_planes(sample_keys(spark, sf), 6.1, "more", 46.12, "less")
    return left.groupBy("scene_id").agg(F.count("*").alias("n"))


# --- grids -----------------------------------------------------------------------

@query(
    sql(
        Sql.FRAMES,
        Sql.GRID,
        f"px AS (SELECT DISTINCT scene_id, pixel_id FROM frames), pl AS (SELECT *, pixel_id * 1.7::DOUBLE + 0.3 AS lon, {Sql.M} - (pixel_id * 0.9::DOUBLE + 0.2) AS lat FROM px)",
        body=f"""SELECT scene_id, pixel_id, round(z, 4) AS z FROM pl LEFT JOIN grid ON col = CAST(floor(lon) AS BIGINT) AND "row" = CAST(floor({Sql.M} - lat) AS BIGINT)""",
    )
)
def q_static_overlay(spark, sf):
    meta = meta_of(spark, sf)
    pixels = fx.frames(spark, sf).select("scene_id", "pixel_id").distinct()
    placed = pixels.withColumns({"lon": F.col("pixel_id") * 1.7 + 0.3, "lat": meta.height - (F.col("pixel_id") * 0.9 + 0.2)})
    return raster.overlay(placed, fx.grid(spark, sf), meta, ["z"]).select("scene_id", "pixel_id", r4("z").alias("z"))


TARGET_GRID = f"""side AS (SELECT {Sql.M} AS m),
    tgt AS (SELECT r AS "row", c AS col, m FROM (SELECT m, unnest(range(0, CAST(floor(m / 1.6) AS BIGINT))) AS r FROM side)
            CROSS JOIN (SELECT unnest(range(0, CAST(floor({Sql.M} / 1.6) AS BIGINT))) AS c))"""


@query(sql(Sql.GRID, TARGET_GRID, body="""SELECT t."row", t.col, round(z, 4) AS z FROM tgt t LEFT JOIN grid g ON g."row" = floor((t."row" + 0.5) * 1.6) AND g.col = floor((t.col + 0.5) * 1.6)"""))
def q_align_nearest(spark, sf):
    found, _ = raster.resample(fx.grid(spark, sf), meta_of(spark, sf), 1.6, method="near")
    return found.select("row", "col", r4("z").alias("z"))


def bilinear_sql(target: str, scale_x: str, scale_y: str) -> str:
    return f""", pos AS (SELECT "row", col, {scale_x} AS x, {scale_y} AS y FROM {target}),
    cor AS (SELECT "row", col, floor(x) + j AS c, floor(y) + i AS r,
                   (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w
            FROM pos CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j))
    SELECT cor."row", cor.col, round(CASE WHEN sum(w) FILTER (z IS NOT NULL) > 0 THEN sum(w * z) / sum(w) FILTER (z IS NOT NULL) END, 4) AS z
    FROM cor LEFT JOIN grid g ON g."row" = cor.r AND g.col = cor.c GROUP BY 1, 2"""


@query(sql(Sql.GRID, TARGET_GRID, body="").rstrip() + bilinear_sql("tgt", "(col + 0.5::DOUBLE) * 1.6 - 0.5", '("row" + 0.5::DOUBLE) * 1.6 - 0.5'))
def q_align_bilinear(spark, sf):
    found, _ = raster.resample(fx.grid(spark, sf), meta_of(spark, sf), 1.6)
    return found.select("row", "col", r4("z").alias("z"))


SNAPPED = f"""side AS (SELECT {Sql.M} AS m),
    snap AS (SELECT m, floor(0.4 / 1.6) AS l, ceil((m + 0.7) / 1.6) AS t, ceil((m + 0.4) / 1.6) AS r, floor(0.7 / 1.6) AS b FROM side),
    tgt AS (SELECT rr AS "row", cc AS col, m, l, t FROM (SELECT *, unnest(range(0, CAST(t - b AS BIGINT))) AS rr FROM snap)
            CROSS JOIN (SELECT unnest(range(0, CAST(r - l AS BIGINT))) AS cc FROM snap))"""


@query(
    sql(Sql.GRID, SNAPPED, body="").rstrip()
    + bilinear_sql("tgt", "(l * 1.6 + (col + 0.5::DOUBLE) * 1.6 - 0.4) - 0.5", '(m + 0.7 - (t * 1.6 - ("row" + 0.5::DOUBLE) * 1.6)) - 0.5')
)
def q_align_nocrop(spark, sf):
    m = fx.grid_side(spark, sf)
    found, _ = raster.align_uncropped(fx.grid(spark, sf), GridMeta(0.4, m + 0.7, 1.0, 1.0, m, m), 1.6, 1.6)
    return found.select("row", "col", r4("z").alias("z"))


def coarsen_cte(k: str) -> str:
    return f"""cover AS (SELECT z, "row" AS r0, col AS c0, unnest(range(CAST(floor("row" / {k} + 1e-9) AS BIGINT), CAST(ceil(("row" + 1) / {k} - 1e-9) AS BIGINT))) AS r FROM grid),
    cover2 AS (SELECT *, unnest(range(CAST(floor(c0 / {k} + 1e-9) AS BIGINT), CAST(ceil((c0 + 1) / {k} - 1e-9) AS BIGINT))) AS c FROM cover),
    coarse AS (SELECT r AS "row", c AS col, sum(z * (least((r + 1) * {k}, r0 + 1) - greatest(r * {k}, r0)) * (least((c + 1) * {k}, c0 + 1) - greatest(c * {k}, c0))) AS z
               FROM cover2 WHERE r < floor({Sql.M} / {k}) AND c < floor({Sql.M} / {k}) GROUP BY 1, 2)"""


@query(sql(Sql.GRID, coarsen_cte("2.5::DOUBLE"), body='SELECT "row", col, round(z, 4) AS z FROM coarse'))
def q_coarsen_sum(spark, sf):
    found, _ = raster.coarsen_sum(fx.grid(spark, sf), meta_of(spark, sf), 2.5)
    return found.select("row", "col", r4("z").alias("z"))


@query(sql(Sql.GRID, coarsen_cte("4.0::DOUBLE"), body='SELECT "row", col, round((z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()), 4) AS z FROM coarse'))
def q_coarsen_rescale(spark, sf):
    found, _ = raster.coarsen_rescale(fx.grid(spark, sf), meta_of(spark, sf), 4.0)
    return found.select("row", "col", r4("z").alias("z"))


@query(sql(Sql.GRID, body='SELECT "row", col, round((z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()), 4) AS z FROM grid'))
def q_rescale01(spark, sf):
    return raster.rescale01(fx.grid(spark, sf)).select("row", "col", r4("z").alias("z"))


@query(sql(Sql.TILES, body='SELECT "row", col, round(arg_min(z, tile_id), 4) AS z FROM tiles WHERE z IS NOT NULL GROUP BY 1, 2'))
def q_mosaic(spark, sf):
    return raster.mosaic(fx.tiles(spark, sf)).select("row", "col", r4("z").alias("z"))


# Seven rasters of their own origin and cell size, on one grid; odd numbers keep centres off the edges.
def raster_places(spark, sf):
    m, i = fx.grid_side(spark, sf), F.col("raster_id")
    size = 0.7013 + (i % 3) * 0.4021
    place = [(i * 1.3717 - 2.0).alias("ulx"), (m - i * 0.8309 + 3.0).alias("uly"), size.alias("dx"), (size + 0.1007).alias("dy"), F.lit(m).alias("width"), F.lit(m).alias("height")]
    return fx.tiles(spark, sf).select(F.col("tile_id").alias("raster_id")).distinct().select("raster_id", ((i * 5) % 7).alias("priority"), *place)


RASTERS = Sql.TILES + f""", places AS (
      SELECT tile_id, (tile_id * 5) % 7 AS priority, tile_id * 1.3717::DOUBLE - 2.0::DOUBLE AS ulx, {Sql.M} - tile_id * 0.8309::DOUBLE + 3.0::DOUBLE AS uly,
        0.7013::DOUBLE + (tile_id % 3) * 0.4021::DOUBLE AS dx, 0.7013::DOUBLE + (tile_id % 3) * 0.4021::DOUBLE + 0.1007::DOUBLE AS dy FROM (SELECT DISTINCT tile_id FROM tiles)),
    box AS (SELECT CAST(floor(min(ulx) / 1.1::DOUBLE) AS BIGINT) AS x0, CAST(ceil(max(uly) / 1.1::DOUBLE) AS BIGINT) AS y1,
      CAST(ceil(max(ulx + {Sql.M} * dx) / 1.1::DOUBLE) AS BIGINT) AS x1, CAST(floor(min(uly - {Sql.M} * dy) / 1.1::DOUBLE) AS BIGINT) AS y0 FROM places),
    tr AS (SELECT unnest(range(y1 - y0)) AS r FROM box), tcs AS (SELECT unnest(range(x1 - x0)) AS c FROM box),
    hits AS (SELECT r, c, tile_id, priority, CAST(floor((uly - ((y1 * 1.1::DOUBLE) - (r + 0.5::DOUBLE) * 1.1::DOUBLE)) / dy) AS BIGINT) AS sr, CAST(floor(((x0 * 1.1::DOUBLE) + (c + 0.5::DOUBLE) * 1.1::DOUBLE - ulx) / dx) AS BIGINT) AS sc
      FROM tr CROSS JOIN tcs CROSS JOIN box CROSS JOIN places)"""


@query(sql(RASTERS, body='SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, round(arg_min(z, priority), 4) AS z FROM hits JOIN tiles t ON t.tile_id = hits.tile_id AND t."row" = sr AND t.col = sc WHERE z IS NOT NULL GROUP BY 1, 2'))
def q_mosaic_rasters(spark, sf):
    places = raster_places(spark, sf)
    cells = fx.tiles(spark, sf).withColumnRenamed("tile_id", "raster_id")
    return mosaic_rasters(cells, places, common_grid(places, 1.1, 1.1)).withColumn("z", r4("z"))


def holed(spark, sf):
    """The first tile: a quarter of its cells are missing, and one block is wider than the search distance."""
    block = F.col("row").between(0, 23) & F.col("col").between(0, 23)
    return fx.grid(spark, sf).withColumn("z", F.when((31 * F.col("row") + 17 * F.col("col")) % 4 != 0, F.when(~block, F.col("z"))))


HOLED = Sql.GRID + """, holed AS (SELECT "row", col, CASE WHEN (31 * "row" + 17 * col) % 4 <> 0 AND NOT ("row" BETWEEN 0 AND 23 AND col BETWEEN 0 AND 23) THEN z END AS z FROM grid)"""

DIRECTIONS8 = [(0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, -1), (1, -1), (-1, 1)]


def fill_sql() -> str:
    steps = ", ".join(f"({i}, {dr}, {dc}, {1.0 if dr == 0 or dc == 0 else 2**0.5!r}, {10 if dr == 0 or dc == 0 else 7})" for i, (dr, dc) in enumerate(DIRECTIONS8))
    return sql(
        HOLED,
        f"""dir(d, dr, dc, unit, reach) AS (VALUES {steps}),
        look AS (SELECT h."row", h.col, d.d, s.s, d.unit, g.z FROM holed h CROSS JOIN dir d JOIN (SELECT unnest(range(1, 11)) AS s) s ON s.s <= d.reach
                 JOIN holed g ON g."row" = h."row" + s.s * d.dr AND g.col = h.col + s.s * d.dc AND g.z IS NOT NULL WHERE h.z IS NULL),
        near AS (SELECT "row", col, d, arg_min(z, s) AS z, min(s) * any_value(CAST(unit AS DOUBLE)) AS dist FROM look GROUP BY 1, 2, 3),
        est AS (SELECT "row", col, sum(z / dist) / sum(1 / dist) AS z FROM near GROUP BY 1, 2)""",
        body="""SELECT h."row", h.col, round(coalesce(h.z, e.z), 4) AS z, h.z IS NULL AS was_missing FROM holed h LEFT JOIN est e ON e."row" = h."row" AND e.col = h.col""",
    )


@query(fill_sql())
def q_fill_nodata(spark, sf):
    return raster.fill_nodata(holed(spark, sf), 10, TILE).withColumn("z", r4("z"))


BORDERED = Sql.GRID + f""", bordered AS (SELECT "row", col, CASE WHEN "row" BETWEEN 3 AND {Sql.M} - 5 AND col BETWEEN 2 AND {Sql.M} - 4 AND "row" <> 10 THEN z END AS z FROM grid)"""


@query(
    sql(
        BORDERED,
        f"""v AS (SELECT min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM bordered WHERE z IS NOT NULL)""",
        body="""SELECT b."row", b.col, round(CASE WHEN b."row" BETWEEN r0 AND r1 AND b.col BETWEEN c0 AND c1 THEN coalesce(z, -9999) ELSE -9999 END, 4) AS z,
          CAST(b."row" - r0 AS INTEGER) AS crop_row, (SELECT count(*) FROM (SELECT "row" FROM bordered GROUP BY 1 HAVING count(z) = 0)) AS missing_rows FROM bordered b CROSS JOIN v""",
    )
)
def q_crop_pad(spark, sf):
    m = fx.grid_side(spark, sf)
    inside = F.col("row").between(3, m - 5) & F.col("col").between(2, m - 4) & (F.col("row") != 10)
    bordered = fx.grid(spark, sf).withColumn("z", F.when(inside, F.col("z")))
    cropped = raster.crop_to_valid(bordered)
    first_row = cropped.agg(F.max("row0")).scalar()
    empty = raster.missing_lines(bordered).agg(F.count("*")).scalar()
    padded = raster.pad_to(cropped, bordered)
    return padded.select("row", "col", r4("z").alias("z"), (F.col("row") - first_row).alias("crop_row"), empty.alias("missing_rows"))


RASTER = f"""edges AS (SELECT poly_id, px AS x0, py AS y0, lead(px) OVER w AS x1, lead(py) OVER w AS y1 FROM polygons WINDOW w AS (PARTITION BY poly_id, ring_id ORDER BY seq)),
    lines AS (SELECT unnest(range({Sql.M})) AS "row"),
    cross_x AS (SELECT poly_id, "row", x0 + (({Sql.M} - ("row" + 0.5::DOUBLE)) - y0) * (x1 - x0) / (y1 - y0) AS cx
                FROM edges JOIN lines ON x1 IS NOT NULL AND y0 <> y1 AND least(y0, y1) <= {Sql.M} - ("row" + 0.5::DOUBLE) AND {Sql.M} - ("row" + 0.5::DOUBLE) < greatest(y0, y1)),
    inside AS (SELECT poly_id, "row", c.col FROM cross_x x JOIN (SELECT unnest(range({Sql.M})) AS col) c ON x.cx <= c.col + 0.5::DOUBLE GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
    burned AS (SELECT DISTINCT "row", col FROM inside)"""


@query(sql(Sql.GRID, Sql.POLYGONS, RASTER, body="""SELECT g."row", g.col, CASE WHEN b."row" IS NULL THEN 0 ELSE 1 END AS mask FROM grid g LEFT JOIN burned b ON b."row" = g."row" AND b.col = g.col"""))
def q_rasterise(spark, sf):
    cells = fx.grid(spark, sf).select("row", "col")
    return raster.burn_mask(fx.polygons(spark, sf), cells, meta_of(spark, sf))


@query(
    sql(
        Sql.GRID,
        body="""SELECT min(x) AS min_x, max(x) AS max_x, count(DISTINCT x) AS n_x, (max(x) - min(x)) / (count(DISTINCT x) - 1) AS step_x,
          min(y) AS min_y, max(y) AS max_y, count(DISTINCT y) AS n_y, (max(y) - min(y)) / (count(DISTINCT y) - 1) AS step_y
          FROM (SELECT 6 + (col + 0.5::DOUBLE) * 0.03125 AS x, 48 - ("row" + 0.5::DOUBLE) * 0.03125 AS y FROM grid)""",
    )
)
def q_grid_meta(spark, sf):
    points = fx.grid(spark, sf).select(C.cell_centre("col", 6.0, 0.03125).alias("lon"), C.cell_centre("row", 48.0, -0.03125).alias("lat"))
    return raster.grid_summary(points)


# --- terrain ---------------------------------------------------------------------

def _nb(name: str, dr: int, dc: int) -> str:
    return f'LEFT JOIN grid {name} ON {name}."row" = g."row" + ({dr}) AND {name}.col = g.col + ({dc})'


OFFSETS = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}
AROUND = (
    Sql.GRID
    + ', nb0 AS (SELECT g."row", g.col, g.z, '
    + ", ".join(f"{n}_.z AS {n}_raw, coalesce({n}_.z, g.z) AS {n}" for n in OFFSETS)
    + " FROM grid g "
    + " ".join(_nb(f"{n}_", *o) for n, o in OFFSETS.items())
    + """), nb AS (SELECT *, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / 8 AS p, ((nw + 2 * n + ne) - (sw + 2 * s + se)) / 8 AS q,
      (w + e) / 2 - z AS zd, (n + s) / 2 - z AS ze, (-nw + ne + sw - se) / 4 AS zf, (e - w) / 2 AS zg, (n - s) / 2 AS zh FROM nb0),
    sf AS (SELECT *, degrees(atan(sqrt(p * p + q * q))) AS slope, CASE WHEN p <> 0 OR q <> 0 THEN CASE WHEN degrees(atan2(-p, -q)) < 0 THEN degrees(atan2(-p, -q)) + 360 ELSE degrees(atan2(-p, -q)) END END AS aspect,
      coalesce(2 * (zd * zh * zh + ze * zg * zg - zf * zg * zh) / nullif(zg * zg + zh * zh, 0), 0) AS plan_curv,
      coalesce(-2 * (zd * zg * zg + ze * zh * zh + zf * zg * zh) / nullif(zg * zg + zh * zh, 0), 0) AS profile_curv FROM nb)"""
)


def _surface(spark, sf):
    return terrain.surface(fx.grid(spark, sf), 1.0, 1.0, TILE)


@query(sql(AROUND, body='SELECT "row", col, round(slope, 4) AS slope FROM sf'))
def q_slope(spark, sf):
    return _surface(spark, sf).select("row", "col", r4("slope").alias("slope"))


@query(sql(AROUND, body='SELECT "row", col, round(aspect, 4) AS aspect, round(cos(radians(aspect)), 4) + 0.0::DOUBLE AS northing, round(sin(radians(aspect)), 4) + 0.0::DOUBLE AS easting FROM sf'))
def q_aspect_components(spark, sf):
    return _surface(spark, sf).select("row", "col", r4("aspect").alias("aspect"), r4(C.northing("aspect")).alias("northing"), r4(C.easting("aspect")).alias("easting"))


@query(
    sql(
        AROUND,
        body='SELECT "row", col, round(sqrt(('
        + " + ".join(f"coalesce(({n}_raw - z) * ({n}_raw - z), 0)" for n in OFFSETS)
        + ") / nullif("
        + " + ".join(f"CASE WHEN {n}_raw IS NULL THEN 0 ELSE 1 END" for n in OFFSETS)
        + ", 0)), 4) AS rugg FROM nb",
    )
)
def q_ruggedness(spark, sf):
    return _surface(spark, sf).select("row", "col", r4("rugg").alias("rugg"))


@query(sql(AROUND, body='SELECT "row", col, round(plan_curv, 4) + 0.0::DOUBLE AS plan_curv, round(profile_curv, 4) + 0.0::DOUBLE AS profile_curv, round((plan_curv + profile_curv) / 2, 4) + 0.0::DOUBLE AS curv FROM sf'))
def q_curvature(spark, sf):
    return _surface(spark, sf).select("row", "col", *[r4(c).alias(c) for c in ("plan_curv", "profile_curv", "curv")])


BOX = Sql.GRID + """, box AS (SELECT g."row", g.col, g.z, count(*) AS n, avg(h.z) AS mean, stddev_pop(h.z) AS sd, min(h.z) AS lo, max(h.z) AS hi
      FROM grid g JOIN grid h ON h."row" BETWEEN g."row" - 3 AND g."row" + 3 AND h.col BETWEEN g.col - 5 AND g.col + 5 GROUP BY 1, 2, 3)"""


@query(sql(BOX, body="""SELECT "row", col, round(CASE WHEN z < mean THEN (z - mean) / (mean - lo) WHEN z > mean THEN (z - mean) / (hi - mean) ELSE 0 END, 4) + 0.0::DOUBLE AS rtp FROM box"""))
def q_relative_position(spark, sf):
    return terrain.relative_position(fx.grid(spark, sf), 11, 7, TILE).withColumn("rtp", r4("rtp"))


@query(sql(BOX, body="""SELECT "row", col, round(coalesce((z - mean) / nullif(sd, 0), 0), 4) + 0.0::DOUBLE AS dev FROM box"""))
def q_deviation(spark, sf):
    return terrain.deviation(fx.grid(spark, sf), 11, 7, TILE).withColumn("dev", r4("dev"))


CODES = {"ne": 1, "e": 2, "se": 4, "s": 8, "sw": 16, "w": 32, "nw": 64, "n": 128}
POINTER = (
    AROUND
    + ', drops AS (SELECT "row", col, unnest(['
    + ", ".join(f"{{'code': {code}, 'fall': (z - {n}_raw) / {2**0.5 if len(n) == 2 else 1.0!r}::DOUBLE}}" for n, code in CODES.items())
    + """]) AS k FROM nb),
    best AS (SELECT "row", col, k.code AS code, row_number() OVER (PARTITION BY "row", col ORDER BY k.fall DESC, k.code) AS rn FROM drops WHERE k.fall > 0),
    ptr AS (SELECT g."row", g.col, coalesce(b.code, 0) AS pointer FROM grid g LEFT JOIN best b ON b."row" = g."row" AND b.col = g.col AND b.rn = 1)"""
)
FLOW = (
    POINTER
    + """, nxt AS (SELECT "row", col, pointer, "row" + CASE WHEN pointer IN (1, 64, 128) THEN -1 WHEN pointer IN (4, 8, 16) THEN 1 ELSE 0 END AS nr,
             col + CASE WHEN pointer IN (1, 2, 4) THEN 1 WHEN pointer IN (16, 32, 64) THEN -1 ELSE 0 END AS nc FROM ptr),
    walk AS (SELECT "row", col FROM nxt UNION ALL SELECT n.nr, n.nc FROM walk w JOIN nxt n ON n."row" = w."row" AND n.col = w.col WHERE n.pointer <> 0),
    flow AS (SELECT "row", col, count(*) AS acc FROM walk GROUP BY 1, 2)"""
)


@query(sql(POINTER, body='SELECT "row", col, pointer FROM ptr'))
def q_d8_pointer(spark, sf):
    return _surface(spark, sf).select("row", "col", "pointer")


@query(sql(FLOW, body='SELECT "row", col, acc FROM flow', recursive=True))
def q_flow_accumulation(spark, sf):
    return terrain.flow_accumulation(_surface(spark, sf))


@query(sql(FLOW, body='SELECT f."row", f.col, round(ln(acc / nullif(tan(radians(slope)), 0)), 4) + 0.0::DOUBLE AS twi FROM flow f JOIN sf s ON s."row" = f."row" AND s.col = f.col', recursive=True))
def q_wetness_index(spark, sf):
    base = cut_lineage(_surface(spark, sf))  # the flow and the slope come from it
    return terrain.wetness(base, terrain.flow_accumulation(base)).withColumn("twi", r4("twi"))


#: Lowest ways from the outlets inwards: a cell is taken up again when a lower one is found.
FILL = (
    Sql.GRID
    + """, cells AS (SELECT *, row_number() OVER (ORDER BY "row", col) AS id FROM grid),
    pairs AS (SELECT a.id AS source, b.id AS target, b."row" AS br, b.col AS bc, b.z AS bz FROM cells a JOIN cells b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND a.id <> b.id),
    outlets AS (SELECT c.* FROM cells c LEFT JOIN (SELECT target, count(*) AS n FROM pairs GROUP BY target) k ON k.target = c.id WHERE coalesce(k.n, 0) < 8),
    flood(id, r, c, z, filled) USING KEY (id) AS (
      SELECT id, "row", col, z, z FROM outlets
      UNION
      SELECT p.target, p.br, p.bc, p.bz, min(greatest(p.bz, f.filled)) FROM flood f JOIN pairs p ON p.source = f.id LEFT JOIN recurring.flood k ON k.id = p.target
      WHERE k.id IS NULL OR greatest(p.bz, f.filled) < k.filled GROUP BY 1, 2, 3, 4)"""
)


def _filled(spark, sf):
    return fill_depressions(fx.grid(spark, sf), TILE, 2)


@query(sql(FILL, body='SELECT r AS "row", c AS col, round(z, 4) AS z, round(filled, 4) AS filled FROM flood', recursive=True))
def q_filled_surface(spark, sf):
    return _filled(spark, sf).select("row", "col", r4("z").alias("z"), r4("filled").alias("filled"))


RAISED = FILL + ', raised AS (SELECT r AS "row", c AS col, filled AS z FROM flood), ' + FLOW.replace(Sql.GRID + ", ", "").replace(" grid ", " raised ")


@query(sql(RAISED, body='SELECT "row", col, acc FROM flow', recursive=True))
def q_filled_flow(spark, sf):
    """Accumulation where no water is held back in a pit; it ends on the level of a filled one."""
    full = _filled(spark, sf).select("row", "col", F.col("filled").alias("z"))
    return terrain.flow_accumulation(terrain.surface(full, 1.0, 1.0, TILE))


MULTI = (
    AROUND
    + f""", side AS (SELECT {Sql.M} AS m),
    cells AS (SELECT r AS "row", c AS col FROM (SELECT unnest(range(m)) AS r FROM side) CROSS JOIN (SELECT unnest(range({Sql.M})) AS c)),
    c_t AS (SELECT r AS "row", c AS col FROM (SELECT unnest(range(CAST(floor(m / 5.0) AS BIGINT))) AS r FROM side) CROSS JOIN (SELECT unnest(range(CAST(floor({Sql.M} / 5.0) AS BIGINT))) AS c)),
    c_grid AS (SELECT t."row", t.col, g.z FROM c_t t JOIN grid g ON g."row" = t."row" * 5 + 2 AND g.col = t.col * 5 + 2),
    c_nb AS (SELECT g."row", g.col, g.z, """
    + ", ".join(f"coalesce({n}_.z, g.z) AS {n}" for n in OFFSETS)
    + " FROM c_grid g "
    + " ".join(_nb(f"{n}_", *o).replace("JOIN grid", "JOIN c_grid") for n, o in OFFSETS.items())
    + """), c_sf AS (SELECT "row", col, degrees(atan(sqrt(pow(((ne + 2 * e + se) - (nw + 2 * w + sw)) / 40, 2) + pow(((nw + 2 * n + ne) - (sw + 2 * s + se)) / 40, 2)))) AS slope FROM c_nb)"""
)


@query(
    sql(
        MULTI,
        body="""SELECT x."row", x.col, round(a.slope, 4) AS slope_20, round(b.slope, 4) AS slope_100 FROM cells x
          LEFT JOIN sf a ON a."row" = x."row" AND a.col = x.col LEFT JOIN c_sf b ON b."row" = x."row" // 5 AND b.col = x.col // 5""",
    )
)
def q_multi_resolution(spark, sf):
    found = terrain.multi_resolution(fx.grid(spark, sf), meta_of(spark, sf), {"20": 1, "100": 5}, wanted=("slope",), size=TILE)
    return found.select("row", "col", r4("slope_20").alias("slope_20"), r4("slope_100").alias("slope_100"))


# --- scores ----------------------------------------------------------------------

ERRORS = "per AS (SELECT sample_id, count(*) AS n_steps, sum((pred - truth) * (pred - truth)) AS sse FROM predictions GROUP BY 1)"


@query(
    sql(
        FILLED,
        PREDICTIONS,
        ERRORS,
        body="""SELECT round(sqrt(sum(sse) / sum(n_steps)), 6) AS rmse, round(avg(sse / n_steps), 8) AS l2,
          round(sqrt(sum(sse) / (max(n_steps) * ceil(count(*) / 64.0))), 6) AS rmse_compat FROM per""",
    )
)
def q_rmse(spark, sf):
    pairs = predictions(spark, sf)
    found = scores.rmse(pairs).withColumns({"l2": scores.loss("l2")(pairs).scalar(), "rmse_compat": scores.rmse(pairs, compat_batch=64).scalar()})
    return found.select(r4("rmse", 6).alias("rmse"), r4("l2", 8).alias("l2"), r4("rmse_compat", 6).alias("rmse_compat"))


@query(
    sql(
        FILLED,
        PREDICTIONS,
        body="""SELECT track, count(*) AS n, round(sqrt(avg((pred - truth) ** 2)), 6) AS rmse FROM (SELECT pred, truth, 'track_' || (step % 2) AS track FROM predictions) GROUP BY 1""",
    )
)
def q_metric_states(spark, sf):
    """Each run stores sums per track, one of them twice; the errors of all runs come from the sums."""
    pairs, folder = cut_lineage(predictions(spark, sf)), scratch_path(spark)
    runs = pairs.withColumns({"run": F.floor(F.col("step") / 6).cast("int"), "track": F.concat(F.lit("track_"), (F.col("step") % 2).cast("string"))})
    states = scores.metric_states(runs)
    store.write_states(states.withColumn("sse", F.col("sse") + 1), folder)
    for run in range(TARGET // 6):
        store.write_states(states.filter(F.col("run") == run), folder)
    return scores.merged_rmse(spark.read.parquet(folder), ["track"]).select("track", "n", r4("rmse", 6).alias("rmse"))


@query(sql(FILLED, PREDICTIONS, ERRORS, body="SELECT sample_id, n_steps, round(sse / n_steps, 8) AS mse, round(sqrt(sse / n_steps), 6) AS rmse FROM per"))
def q_per_sample_scores(spark, sf):
    parts = scores.sample_errors(predictions(spark, sf))
    worse = parts.withColumns({c: F.col(c) * 2 + 1 for c in ("sse", "mse", "rmse")})  # a second worker's scores of the same samples
    found = scores.merge_scores(worse.unionByName(parts))
    return found.select("sample_id", "n_steps", r4("mse", 8).alias("mse"), r4("rmse", 6).alias("rmse"))


@query(
    sql(
        Sql.FRAMES,
        "lc AS (SELECT p_partkey AS pixel_id, p_size AS landcover FROM part)",
        "ix AS (SELECT pixel_id, t, (s2_B08 - s2_B04) / (s2_B08 + s2_B04) AS nd FROM frames)",
        body="""SELECT pixel_id, t, round(CASE WHEN landcover BETWEEN 10 AND 30 THEN chg END, 4) + 0.0::DOUBLE AS change FROM (
          SELECT a.pixel_id, a.t, (a.nd - b.nd + 1) / 2 AS chg FROM ix a LEFT JOIN ix b ON b.pixel_id = a.pixel_id AND b.t = a.t - 1) LEFT JOIN lc USING (pixel_id)""",
    )
)
def q_change_map(spark, sf):
    cover = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("pixel_id"), F.col("p_size").alias("landcover"))
    found = series.change(ndvi_frames(spark, sf), "s2_ndvi").join(cover, "pixel_id", "left")
    return found.select("pixel_id", "t", r4(C.vegetation_only("change", "landcover")).alias("change"))


REPORT = f"""SELECT s.sample_id, any_value(s.lon) AS lon, any_value(s.lat) AS lat, p.step, any_value(s.start) + CAST(5 * (p.step + 1) AS INTEGER) AS date,
          round(any_value(p.pred), 4) + 0.0::DOUBLE AS pred, round(any_value(p.truth), 4) + 0.0::DOUBLE AS truth, round(avg(s.v), 4) + 0.0::DOUBLE AS context_mean
        FROM sample_frames s JOIN predictions p ON p.sample_id = s.sample_id
        WHERE s.part = 'context' AND {IN_RANGE}"""


def _report(spark, sf, limit):
    found = scores.prediction_report(samples(spark, sf), predictions(spark, sf), "s2_ndvi", bbox=BBOX, time_range=TIMES, limit=limit, seed=5)
    return found.select("sample_id", "lon", "lat", F.col("step").cast("bigint").alias("step"), "date", r4("pred").alias("pred"), r4("truth").alias("truth"), r4("context_mean").alias("context_mean"))


@query(sql(FILLED, PREDICTIONS, body=f"{REPORT} GROUP BY s.sample_id, p.step"))
def q_prediction_report(spark, sf):
    return _report(spark, sf, None)


@query(
    sql(
        FILLED,
        PREDICTIONS,
        body=f"""{REPORT} AND s.sample_id IN (SELECT sample_id FROM sample_keys WHERE {IN_RANGE} ORDER BY md5(concat_ws(':', '5', sample_id)) LIMIT 10) GROUP BY s.sample_id, p.step""",
    )
)
def q_prediction_preview(spark, sf):
    return _report(spark, sf, 10)


# --- trials ----------------------------------------------------------------------

TRIALS = """runs AS (SELECT 'config_(hidden_dim=' || hidden_dim || ')_(num_layers=' || num_layers || ')' AS trial, epoch,
      CAST(round(sqrt(avg(value)) / 100, 6) AS VARCHAR) AS rmse FROM (
        SELECT ['32', '64', '128'][1 + user_id % 3] AS hidden_dim, ['2', '4', '8', '10'][1 + (user_id // 3) % 4] AS num_layers, CAST(day(ts) % 10 AS INTEGER) AS epoch, value FROM events)
      GROUP BY hidden_dim, num_layers, epoch)"""


def trial_scores(spark, sf):
    """Scores per trial and epoch, kept as text."""
    events = fx.table(spark, sf, "events")
    user = F.col("user_id")
    hidden = F.element_at(F.array(*[F.lit(v) for v in ("32", "64", "128")]), (1 + user % 3).cast("int"))
    layers = F.element_at(F.array(*[F.lit(v) for v in ("2", "4", "8", "10")]), (1 + F.floor(user / 3) % 4).cast("int"))
    name = F.concat(F.lit("config_(hidden_dim="), hidden, F.lit(")_(num_layers="), layers, F.lit(")"))
    runs = events.groupBy(name.alias("trial"), (F.dayofmonth("ts") % 10).cast("int").alias("epoch")).agg(F.round(F.sqrt(F.avg("value")) / 100, 6).cast("string").alias("rmse"))
    return runs


@query(sql(TRIALS, body="""SELECT trial, min(CAST(rmse AS DOUBLE)) AS best_rmse, arg_min(epoch, (CAST(rmse AS DOUBLE), epoch)) AS best_epoch FROM runs GROUP BY 1"""))
def q_best_epochs(spark, sf):
    return tuning.best_epochs(trial_scores(spark, sf))


@query(sql(TRIALS, body="""SELECT trial, min(CAST(rmse AS DOUBLE)) AS best_rmse, arg_min(epoch, (CAST(rmse AS DOUBLE), epoch)) AS best_epoch FROM runs GROUP BY 1 ORDER BY 2, 1 LIMIT 1"""))
def q_best_trial(spark, sf):
    return tuning.best_trial(trial_scores(spark, sf))


def parameter_grid(spark, sf):
    """Parameter values seen in the data."""
    item = fx.table(spark, sf, "lineitem")
    lists = item.agg(F.collect_set(F.col("l_linenumber") * 16).alias("hidden_dim"), F.collect_set("l_returnflag").alias("num_layers"))
    return tuning.trial_grid(lists)


GRID12 = """combos AS (SELECT hidden_dim, num_layers, 'config_(hidden_dim=' || hidden_dim || ')_(num_layers=' || num_layers || ')' AS trial
      FROM (SELECT DISTINCT l_linenumber * 16 AS hidden_dim FROM lineitem) CROSS JOIN (SELECT DISTINCT l_returnflag AS num_layers FROM lineitem))"""


@query(sql(GRID12, body="SELECT * FROM combos"))
def q_trial_grid(spark, sf):
    return parameter_grid(spark, sf)


DONE = """done AS (SELECT DISTINCT 'config_(hidden_dim=' || (l_linenumber * 16) || ')_(num_layers=' || l_returnflag || ')' AS trial FROM lineitem GROUP BY l_linenumber, l_returnflag
      HAVING avg(l_quantity) > (SELECT avg(l_quantity) FROM lineitem))"""


@query(sql(GRID12, DONE, body="SELECT * FROM combos WHERE trial NOT IN (SELECT trial FROM done)"))
def q_pending_trials(spark, sf):
    item = fx.table(spark, sf, "lineitem")
    overall = item.agg(F.avg("l_quantity")).scalar()
    runs = item.groupBy((F.col("l_linenumber") * 16).alias("hidden_dim"), F.col("l_returnflag").alias("num_layers")).agg(F.avg("l_quantity").alias("q"))
    name = F.concat(F.lit("config_(hidden_dim="), "hidden_dim", F.lit(")_(num_layers="), "num_layers", F.lit(")"))
    done = runs.filter(F.col("q") > overall).select(name.alias("trial"))
    return tuning.pending_trials(parameter_grid(spark, sf), done)


# --- stores: written, changed and read back in the shared folder ------------------------

@query(sql(Sql.FRAMES, SCENES, body="SELECT DISTINCT lon, lat, CAST(CASE WHEN bright THEN 2 ELSE 1 END AS BIGINT) AS listed FROM scene_places"))
def q_scene_list_files(spark, sf):
    places, folder = scene_places(spark, sf), scratch_path(spark)
    paths = [f"{folder}/bright", f"{folder}/every"]
    for path, rows in zip(paths, (places.filter("bright"), places)):
        scene_source.write_scenes(rows.select("lon", "lat"), path)
    read = scene_source.read_scenes(spark, paths)
    listed = read.groupBy("lon", "lat").agg(F.count("*").alias("listed"))
    return scene_source.union_scenes(*[scene_source.read_scenes(spark, p) for p in paths]).join(listed, ["lon", "lat"])


@query(sql(BAND_STATS, body="""SELECT CAST(scene_id AS BIGINT) AS scene_id, band, round(min(v), 4) AS "min", round(max(v), 4) AS "max", 'train' AS split FROM band_rows GROUP BY 1, 2"""))
def q_stats_store(spark, sf):
    per_scene, folder = stats.band_stats(fx.frames(spark, sf), fx.BANDS).withColumn("split", F.lit("train")), scratch_path(spark)
    low = per_scene.withColumn("min", F.lit(-1.0))
    store.write_stats(low.filter("scene_id % 4 = 0"), folder)  # replaced below
    for i in (0, 1):
        store.write_stats(per_scene.filter(F.col("scene_id") % 2 == i), folder)
    return spark.read.parquet(folder).select(F.col("scene_id").cast("bigint").alias("scene_id"), "band", r4("min").alias("min"), r4("max").alias("max"), "split")


@query(sql(Sql.FRAMES, SAMPLE_KEYS, body="SELECT sample_id, scene_id, start_t, CASE WHEN start_t < 200 THEN 2 ELSE 1 END AS batch FROM sample_keys"))
def q_sample_store(spark, sf):
    """All samples, then the early ones of the same scenes again: their names replace those of the first batch."""
    keys, folder = sample_keys(spark, sf).select("sample_id", "scene_id", "start_t").withColumn("split", F.lit("train")), scratch_path(spark)
    for batch, rows in ((1, keys), (2, keys.filter("start_t < 200"))):
        store.write_samples(rows.withColumn("batch", F.lit(batch)), folder)
    return spark.read.parquet(folder).select("sample_id", F.col("scene_id").cast("bigint").alias("scene_id"), "start_t", "batch")


@query(sql(FILLED, PREDICTIONS, body="SELECT sample_id, step, round(CASE WHEN step < 9 THEN pred ELSE pred + 1 END, 4) + 0.0::DOUBLE AS pred FROM predictions"))
def q_prediction_store(spark, sf):
    """The first write wins; of two rows with one key in a batch the smaller."""
    rows, folder = cut_lineage(predictions(spark, sf).select("sample_id", "step", "pred")), scratch_path(spark)
    store.write_predictions(rows.filter("step < 9"), folder)
    again = rows.withColumn("pred", F.col("pred") + 1)
    store.write_predictions(again.unionByName(again.withColumn("pred", F.col("pred") + 1)), folder)
    return spark.read.parquet(folder).select("sample_id", "step", r4("pred").alias("pred"))


@query("""SELECT 'config_(line=' || l_linenumber || ')_(flag=' || l_returnflag || ')' AS trial, CAST(month(l_shipdate) AS INTEGER) AS epoch, round(avg(l_quantity), 4) AS rmse
       FROM lineitem GROUP BY l_linenumber, l_returnflag, 2""")
def q_score_files(spark, sf):
    """Score lists as text in one folder per trial, read together, written and read as a table of numbers."""
    item, folder = fx.table(spark, sf, "lineitem"), scratch_path(spark)
    name = F.concat(F.lit("config_(line="), "l_linenumber", F.lit(")_(flag="), "l_returnflag", F.lit(")"))
    scored = item.groupBy(name.alias("trial"), F.month("l_shipdate").alias("epoch")).agg(F.round(F.avg("l_quantity"), 4).alias("rmse"))
    entry = F.struct(F.col("rmse").cast("string").alias("RMSE_drought"), F.col("epoch").cast("string").alias("epoch"))
    lists = scored.groupBy("trial").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("value"))  # at most twelve epochs each
    lists.write.partitionBy("trial").text(f"{folder}/runs")
    found = store.read_scores(spark, f"{folder}/runs/*/*.txt")
    named = F.url_decode(F.regexp_replace("trial", "^trial=", ""))  # as the writer escapes folder names
    store.write_scores(found.withColumn("trial", named), f"{folder}/table")
    return spark.read.schema("trial string, epoch int, rmse double").option("header", True).csv(f"{folder}/table")


@query(
    sql(
        Sql.DENSE,
        body="""SELECT CAST(scene_id AS BIGINT) AS scene_id, 'raw' AS stage, count(*) AS n, round(sum(s2_B08), 4) AS total FROM frames GROUP BY 1
          UNION ALL SELECT CAST(scene_id AS BIGINT), 'clean', count(*), round(sum(s2_B08), 4) FROM dense GROUP BY 1""",
    )
)
def q_cube_store(spark, sf):
    frames, folder = fx.frames(spark, sf).select("scene_id", "pixel_id", "t", "s2_B08"), scratch_path(spark)
    store.write_cubes(frames, folder, "train", raw=True)
    store.write_cubes(frames.filter("scene_id % 2 = 0"), folder, "train", raw=True)  # the same scenes again
    store.write_cubes(dense(spark, sf, ("s2_B08",)), folder, "train", raw=False)
    read = [store.read_cubes(spark, folder, "train", raw).withColumn("stage", F.lit(name)) for raw, name in ((True, "raw"), (False, "clean"))]
    cubes = read[0].select("scene_id", "stage", "s2_B08").unionByName(read[1].select("scene_id", "stage", "s2_B08"))
    return cubes.groupBy(F.col("scene_id").cast("bigint").alias("scene_id"), "stage").agg(F.count("*").alias("n"), r4(F.sum("s2_B08")).alias("total"))


# --- forecasting (no SQL equivalent) and the whole build --------------------------------

@query()
def q_forecast(spark, sf):
    tagged = sampling.split_by_range(samples(spark, sf), time_range=["1995-01-01", "1999-12-31"])
    return forecast_scores(tagged, ["s2_ndvi"], "s2_ndvi", TARGET)


@query()
def q_grid_search(spark, sf):
    return tune(samples(spark, sf), ["s2_ndvi"], "s2_ndvi", TARGET, {"reg_param": [0.001, 0.1], "elastic_net": [0.0, 0.5]}, val_fraction=0.2, seed=42)


LEADS = 3


def short_samples(spark, sf):
    """Two context frames, three target frames: few enough features for SQL to solve the model."""
    packed = windows.pack_series(filled_ndvi(spark, sf), ["s2_ndvi"])
    return named_samples(windows.sliding_windows(packed, 2, LEADS))


def _ridge_sql(reg: float, train: str, rows: str) -> str:
    """Per step: coefficients of the training rows from their covariances, and the error on the others."""
    return f"""SELECT step, count(*) AS n, sqrt(avg((pred - y) ** 2)) AS rmse FROM (
        SELECT r.step, r.y, m.my + b1 * (r.x1 - m.m1) + b2 * (r.x2 - m.m2) AS pred FROM {rows} r JOIN (
          SELECT *, ((s22 + {reg}) * c1 - s12 * c2) / ((s11 + {reg}) * (s22 + {reg}) - s12 * s12) AS b1, ((s11 + {reg}) * c2 - s12 * c1) / ((s11 + {reg}) * (s22 + {reg}) - s12 * s12) AS b2 FROM (
            SELECT step, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12, covar_pop(x2, x2) AS s22, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2
            FROM {rows} WHERE {train} GROUP BY step)) m USING (step) WHERE NOT ({train})) GROUP BY step"""


SHORT = FILLED + f""", short AS (SELECT a.pixel_id, a.t AS start_t, DATE '{fx.DAY0}' + CAST(5 * a.t AS INTEGER) AS start, DATE '{fx.DAY0}' + CAST(5 * (a.t + {1 + LEADS}) AS INTEGER) AS "end",
      a.v AS x1, b.v AS x2, c.t - a.t - 2 AS step, c.v AS y,
      strftime(DATE '{fx.DAY0}' + CAST(5 * a.t AS INTEGER), '%Y_%-m_%-d_') || strftime(DATE '{fx.DAY0}' + CAST(5 * (a.t + {1 + LEADS}) AS INTEGER), '%Y_%-m_%-d_')
        || (6 + a.pixel_id / 64.0::DOUBLE) || '_' || (46 + a.pixel_id / 128.0::DOUBLE) || '_5_1_0' AS sample_id
      FROM filled a JOIN filled b ON b.pixel_id = a.pixel_id AND b.t = a.t + 1 JOIN filled c ON c.pixel_id = a.pixel_id AND c.t BETWEEN a.t + 2 AND a.t + {1 + LEADS}
      WHERE a.t + {1 + LEADS} < {fx.N_FRAMES})"""
EARLY = "start >= DATE '1995-01-01' AND \"end\" <= DATE '1999-12-31'"


@query(sql(SHORT, body=f"SELECT step, n, round(rmse, 6) AS rmse FROM ({_ridge_sql(0.05, EARLY, 'short')})"))
def q_ridge_forecast(spark, sf):
    tagged = sampling.split_by_range(short_samples(spark, sf), time_range=["1995-01-01", "1999-12-31"])
    found = forecast_scores(tagged, ["s2_ndvi"], "s2_ndvi", LEADS, reg_param=0.05)
    return found.select("step", "n", r4("rmse", 6).alias("rmse"))


RIDGES = (0.001, 0.1, 1.0)


RIDGE_GRID = sql(
    SHORT,
    """ranked AS (SELECT s.*, rk <= floor(0.2 * cnt) AS is_val FROM short s JOIN (
          SELECT sample_id, row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id) AS rk, count(*) OVER () AS cnt FROM (SELECT DISTINCT sample_id FROM short)) USING (sample_id))""",
    body=" UNION ALL ".join(
        f"SELECT 'config_(reg_param={r})' AS trial, {r}::DOUBLE AS reg_param, round(sqrt(sum(n * rmse * rmse) / sum(n)), 6) AS rmse FROM ({_ridge_sql(r, 'NOT is_val', 'ranked')})" for r in RIDGES
    ),
)


@query(RIDGE_GRID)
def q_ridge_grid(spark, sf):
    found = tune(short_samples(spark, sf), ["s2_ndvi"], "s2_ndvi", LEADS, {"reg_param": list(RIDGES)}, val_fraction=0.2, seed=42)
    return found.select("trial", "reg_param", r4("rmse", 6).alias("rmse"))


@query(RIDGE_GRID)
def q_resumed_search(spark, sf):
    """The same grid in rounds of one trial; stopped after the first, then gone on with."""
    rows, folder = short_samples(spark, sf), scratch_path(spark)
    for rounds in (1, None):
        found = search(rows, ["s2_ndvi"], "s2_ndvi", LEADS, {"reg_param": list(RIDGES)}, folder, val_fraction=0.2, seed=42, batch=1, max_batches=rounds)
    return found.select("trial", F.regexp_extract("trial", r"reg_param=([^)]+)", 1).cast("double").alias("reg_param"), r4("rmse", 6).alias("rmse"))


DATASET = (
    clean_cte(36)
    + ", "
    + Sql.STATIC_RAW
    + ", "
    + Sql.WEATHER
    + f""", elig AS (SELECT DISTINCT f.scene_id, f.pixel_id FROM frames f JOIN cs USING (pixel_id)
             JOIN (SELECT pixel_id, avg(nullif("DEM", -9999)) AS dem FROM static_raw GROUP BY 1) s USING (pixel_id) WHERE to_sample = 1 AND dem > 900),
    starts AS (SELECT start_t FROM (SELECT unnest(range({fx.N_FRAMES - CONTEXT - TARGET - 18 + 1})) AS start_t)
               WHERE month(DATE '{fx.DAY0}' + CAST(5 * (start_t + {CONTEXT}) AS INTEGER)) BETWEEN 6 AND 8),
    wcal AS (SELECT d.pixel_id, d.t, w.tp, w.maxt FROM dense d LEFT JOIN (
      SELECT pixel_id, greatest(CAST(ceil(datediff('day', DATE '{fx.DAY0}', day) / 5.0) AS INTEGER), 0) AS t, sum(era5_tp) AS tp, max(era5_maxt) AS maxt FROM weather GROUP BY 1, 2) w
      ON w.pixel_id = d.pixel_id AND w.t = d.t),
    {fill_cte("wtp", "wcal", "tp", hold=False)}, {fill_cte("wmx", "wcal", "maxt", hold=False)},
    {Sql.GRID}, at_layers AS (SELECT s.scene_id, s.pixel_id, a.z AS fine, CASE WHEN (b."row" + b.col) % 9 <> 0 THEN b.z END AS coarse, CASE WHEN (b."row" + b.col) % 9 <> 0 THEN b.z * 2 END AS doubled
      FROM (SELECT DISTINCT scene_id, pixel_id FROM static_raw) s
      LEFT JOIN grid a ON a.col = floor((6 + s.pixel_id / 64.0::DOUBLE - 5.9871::DOUBLE) / 0.0217::DOUBLE) AND a."row" = floor((46.9003::DOUBLE - (46 + s.pixel_id / 128.0::DOUBLE)) / 0.0431::DOUBLE)
      LEFT JOIN grid b ON b.col = floor((6 + s.pixel_id / 64.0::DOUBLE - 5.7113::DOUBLE) / 0.1709::DOUBLE) AND b."row" = floor((48.9003::DOUBLE - (46 + s.pixel_id / 128.0::DOUBLE)) / 0.1237::DOUBLE)),
    laid AS (SELECT pixel_id, coalesce(fine, avg(fine) OVER w) AS fine, coalesce(coarse, avg(coarse) OVER w) AS coarse, coalesce(doubled, avg(doubled) OVER w) AS doubled FROM at_layers WINDOW w AS (PARTITION BY scene_id)),
    cd_co AS (SELECT pixel_id, t, f, DATE '{fx.DAY0}' + CAST(5 * t AS INTEGER) AS ts FROM co),
    drawn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, start_t ORDER BY md5(concat_ws(':', '0', scene_id, start_t, pixel_id))) AS rn FROM elig CROSS JOIN starts) WHERE rn <= 2)"""
)


@query(
    sql(
        DATASET,
        body=f"""SELECT scene_id, d.pixel_id, start_t, {CONTEXT} AS n_context, {TARGET} AS n_target, round(a.f, 4) + 0.0::DOUBLE AS first_ndvi, round(b.f, 4) + 0.0::DOUBLE AS last_ndvi,
          round(l.fine, 4) AS fine, round(l.coarse, 4) AS coarse, round(l.doubled, 4) AS doubled, round(wa.v, 4) AS first_tp, round(wb.v, 4) AS last_tp, round(wm.v, 4) AS first_maxt, a.ts AS "start", b.ts AS "end",
          strftime(a.ts, '%Y_%-m_%-d_') || strftime(b.ts, '%Y_%-m_%-d_') || (6 + d.pixel_id / 64.0::DOUBLE) || '_' || (46 + d.pixel_id / 128.0::DOUBLE) || '_5_1_18' AS sample_id
        FROM drawn d JOIN laid l ON l.pixel_id = d.pixel_id JOIN wtp wa ON wa.pixel_id = d.pixel_id AND wa.t = start_t + 18 LEFT JOIN wtp wb ON wb.pixel_id = d.pixel_id AND wb.t = start_t + {CONTEXT + TARGET + 17}
        JOIN wmx wm ON wm.pixel_id = d.pixel_id AND wm.t = start_t + 18 JOIN cd_co a ON a.pixel_id = d.pixel_id AND a.t = start_t JOIN cd_co b ON b.pixel_id = d.pixel_id AND b.t = start_t + {CONTEXT + TARGET - 1}""",
    )
)
def q_dataset_build(spark, sf):
    frames = B.add_ndvi(fx.frames(spark, sf))
    static = (
        fx.static_raw(spark, sf)
        .groupBy("scene_id", "pixel_id")
        .agg(*[F.avg(C.to_missing(b)).alias(b) for b in ("DEM", "CLAY0_5")])
        .withColumns({"FOREST_MASK": F.lit(1.0) * (F.col("DEM") > 900).cast("int"), "DROUGHT_MASK": F.lit(0.0)})
    )
    static, readings = located(static), fx.weather(spark, sf)
    config = DatasetConfig(width=5, height=1, n_frames=fx.N_FRAMES, context=CONTEXT, target=TARGET, shift=18, max_gap=36, remove_pct=0.05, loess_frac=0.07, forest_thresh=0.5, pixels_per_scene=2)
    m, cells = fx.grid_side(spark, sf), fx.grid(spark, sf)
    near, far = GridMeta(5.9871, 46.9003, 0.0217, 0.0431, m, m), GridMeta(5.7113, 48.9003, 0.1709, 0.1237, m, m)
    gaps = cells.withColumn("z", F.when((F.col("row") + F.col("col")) % 9 != 0, F.col("z")).otherwise(-1.0))
    layers = [Layer("fine", cells, near), Layer("coarse", gaps, far, nodata=-1.0), Layer("doubled", gaps.withColumn("z", F.col("z") * 2), far, nodata=-2.0)]
    built = build_dataset(frames, static, readings, config, fx.DAY0, layers)
    return built.samples.select(
        "scene_id",
        "pixel_id",
        "start_t",
        *[r4(c).alias(c) for c in ("fine", "coarse", "doubled")],
        F.size("context").alias("n_context"),
        F.size("target").alias("n_target"),
        r4(F.col("context")[0]["s2_ndvi"]).alias("first_ndvi"),
        r4(F.element_at("target", -1)["s2_ndvi"]).alias("last_ndvi"),
        r4(F.col("context")[0]["era5_tp"]).alias("first_tp"),
        r4(F.element_at("target", -1)["era5_tp"]).alias("last_tp"),
        r4(F.col("context")[0]["era5_maxt"]).alias("first_maxt"),
        "start",
        "end",
        "sample_id",
    )
