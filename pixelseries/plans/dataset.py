"""The whole data set build: frames, layers and weather in, samples and statistics out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import HELPER_BANDS, KEY_COLUMNS, add_ndvi, bands_with_prefix, static_bands
from ..functions.columns import eligible_pixel
from ..functions.keys import make_key
from ..operators.clean import clean_series, fill_static
from ..operators.layers import Layer, attach_layers
from ..operators.sampling import draw_pixels
from ..operators.series import PIXEL, densify, fill_by_time
from ..operators.stats import band_stats
from ..operators.weather import frame_variables, lead_weather, match_to_calendar
from ..operators.windows import cut_windows, pack_series, season_starts, sliding_starts
from ..session import cut_lineage
from ..sources import store


@dataclass(frozen=True)
class DatasetConfig:
    """Settings of a build; the defaults are the published run."""

    n_frames: int = 469
    context: int = 54
    target: int = 18
    shift: int = 18
    max_gap: int | None = 36  # None: no cloud cleaning, every pixel is usable
    remove_pct: float = 0.05
    loess_frac: float = 0.07
    target_in_summer: bool = True
    drought_labels: bool = False
    forest_thresh: float = 0.8
    drought_thresh: float = 0.0
    pixels_per_scene: int | None = 100
    seed: int = 0
    cadence_days: int = 5
    width: int = 128
    height: int = 128
    compat: bool = False


@dataclass(frozen=True)
class Dataset:
    raw: DataFrame
    frames: DataFrame
    static: DataFrame
    stats: DataFrame
    samples: DataFrame
    bands: list[str] = field(default_factory=list)


def prepare_frames(frames: DataFrame, weather: DataFrame, config: DatasetConfig, day0: str) -> DataFrame:
    """Dense frames with cleaned satellite bands and gap-free weather.

    The calendar comes first: every frame has the weather since the one before it,
    whether there is an image or not.
    """
    dense = densify(frames, config.n_frames, bands=bands_with_prefix(frames, "s2"))
    dense = dense.withColumn("ts", F.date_add(F.lit(day0).cast("date"), F.col("t") * config.cadence_days))
    if config.max_gap is None:
        cleaned = dense.withColumn("to_sample", F.lit(1))
    else:
        cleaned = clean_series(dense, config.max_gap, config.remove_pct, config.loess_frac)
    variables = frame_variables(weather.columns)
    matched = match_to_calendar(weather, day0, config.cadence_days, config.n_frames, variables)
    return fill_by_time(cleaned.join(matched, [*PIXEL, "t"], "left"), list(variables))


def eligible_pixels(frames: DataFrame, static: DataFrame, config: DatasetConfig) -> DataFrame:
    flags = frames.groupBy(*PIXEL).agg(F.max("to_sample").alias("to_sample"))
    drought = "DROUGHT_MASK" if config.drought_labels else None
    ok = eligible_pixel("to_sample", "FOREST_MASK", config.forest_thresh, drought, config.drought_thresh)
    return static.join(flags, list(PIXEL)).filter(ok).select(*PIXEL)


def cut_samples(frames: DataFrame, static: DataFrame, bands: list[str], config: DatasetConfig) -> DataFrame:
    """Samples of the drawn pixels: satellite and led weather per frame, static bands once per sample.

    Pixels are filtered before their windows exist, and drawn before the
    windows are cut, so only the kept windows are ever built.
    """
    era5 = [b for b in bands if b.startswith("era5")]
    kept = frames.join(eligible_pixels(frames, static, config), list(PIXEL), "left_semi")
    packed = pack_series(lead_weather(kept, era5, config.shift), bands)
    if config.target_in_summer:
        starts = season_starts(F.col("series"), config.context, config.target, config.shift, config.compat)
    else:
        starts = sliding_starts(F.col("series"), config.context, config.target, config.shift)
    if config.pixels_per_scene is not None:
        candidates = packed.select(*PIXEL, F.explode(starts).alias("start_t"))
        drawn = draw_pixels(candidates, config.pixels_per_scene, config.seed)
        drawn = drawn.groupBy(*PIXEL).agg(F.array_sort(F.collect_list("start_t")).alias("starts"))
        packed, starts = packed.join(drawn, list(PIXEL)), F.col("starts")
    cut = cut_windows(packed, starts, config.context, config.target)
    layers = static.drop(*HELPER_BANDS)
    return named(cut.drop("starts").join(layers, list(PIXEL)), config)


def named(samples: DataFrame, config: DatasetConfig) -> DataFrame:
    """Add the first and last date, and the name where the place is known."""
    found = samples.withColumns({"start": F.col("context")[0]["ts"], "end": F.element_at("target", -1)["ts"]})
    if not {"lon", "lat"} <= set(samples.columns):
        return found
    return found.withColumn("sample_id", make_key("start", "end", "lon", "lat", F.lit(config.width), F.lit(config.height), config.shift))


def build_dataset(frames: DataFrame, static: DataFrame, weather: DataFrame, config: DatasetConfig, day0: str, layers: Sequence[Layer] = ()) -> Dataset:
    """Clean all scenes at once and cut their samples.

    ``frames(scene_id, pixel_id, t, ts, s2_*)``, ``static(scene_id, pixel_id,
    <layers>, FOREST_MASK, DROUGHT_MASK)``, with ``lon, lat`` for samples with a
    name, and readings ``weather(scene_id, pixel_id, day, era5_*)``. ``layers`` of any
    grids become further static bands of the pixels by ``lon, lat``. The vegetation
    index is added if it is missing. The cleaned frames feed three consumers and are
    checkpointed once, when this is called.
    """
    if "s2_ndvi" not in frames.columns:
        frames = add_ndvi(frames)
    prepared = cut_lineage(prepare_frames(frames, weather, config, day0))
    if layers:
        static = cut_lineage(attach_layers(static, layers))
    statics = [b for b in static_bands(static) if b not in HELPER_BANDS]
    filled = fill_static(static, statics)
    bands = [b for b in bands_with_prefix(prepared, "s2") if b not in HELPER_BANDS] + bands_with_prefix(prepared, "era5")
    stats = band_stats(prepared, bands).unionByName(band_stats(filled, statics))
    return Dataset(frames, prepared, filled, stats, cut_samples(prepared, filled, bands, config), bands)


def write_dataset(dataset: Dataset, root: str, split: str) -> None:
    """Raw and cleaned cubes, statistics (training splits only) and samples.

    Samples keep their dates and place, and the name if they have one, so that the
    stored ones can be split, reported and matched with predictions.
    """
    identity = [k for k in ("sample_id", "start", "end") if k in dataset.samples.columns]
    keys = [k for k in KEY_COLUMNS if k in dataset.samples.columns] + ["start_t", *identity]
    store.write_cubes(dataset.raw, f"{root}/cubes", split, raw=True)
    store.write_cubes(dataset.frames, f"{root}/cubes", split, raw=False)
    if "train" in split:
        store.write_stats(dataset.stats.withColumn("split", F.lit(split)), f"{root}/stats")
    layers = [c for c in static_bands(dataset.static) if c in dataset.samples.columns and c not in keys]
    packed = store.pack_samples(dataset.samples, dataset.bands, keys + layers)
    name = ["sample_id"] if "sample_id" in keys else ["pixel_id", "start_t"]
    store.write_samples(packed.withColumn("split", F.lit(split)), f"{root}/samples", name)
