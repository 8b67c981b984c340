"""Weather readings on satellite frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import PIXEL

# How each weather variable is reduced to one value per frame.
WEATHER_AGGREGATES = {"sp": "mean", "tp": "sum", "sr": "sum", "t": "mean", "maxt": "max", "mint": "min", "ap": "mean", "dp": "mean"}


_PARTS = {"mean": ("sum", "count"), "sum": ("sum",), "max": ("max",), "min": ("min",)}
_AGG = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def match_to_frames(
    readings: DataFrame,
    frames: DataFrame,
    variables: Mapping[str, str],
    keys: Sequence[str] = PIXEL,
    reading_time: str = "day",
    frame_time: str = "ts",
) -> DataFrame:
    """Aggregate the readings in ``(previous frame, this frame]`` for every frame.

    Readings are first reduced per pixel and date, so a pixel contributes at
    most one row per date.  These rows and the frame dates are laid on one time
    line and each reading looks up the next frame date: no range join.
    Readings after the last frame are dropped; a frame without readings is
    kept with missing values.
    """
    used = {(v, part) for v, how in variables.items() for part in _PARTS[how]}
    parts = [(f"__{v}_{part}", v, part) for v, part in sorted(used)]
    daily = readings.groupBy(*keys, F.col(reading_time).cast("date").alias("__at")).agg(*[_AGG[part](v).alias(n) for n, v, part in parts])
    dates = frames.select(*keys, F.col(frame_time).cast("date").alias("__at")).distinct()
    line = daily.withColumn("__frame", F.lit(None).cast("date")).unionByName(
        dates.withColumn("__frame", F.col("__at")), allowMissingColumns=True
    )
    # latest first; at equal dates the frame comes before its readings
    backwards = Window.partitionBy(*keys).orderBy(F.desc("__at"), F.desc_nulls_last("__frame")).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last("__frame", ignorenulls=True).over(backwards)
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    merged = (
        line.withColumn(frame_time, owner)
        .filter(F.col(frame_time).isNotNull())
        .groupBy(*keys, frame_time)
        .agg(*[merge[part](n).alias(n) for n, _, part in parts])
    )

    def result(v: str, how: str):
        return F.try_divide(F.col(f"__{v}_sum"), F.col(f"__{v}_count")) if how == "mean" else F.col(f"__{v}_{how}")

    return merged.select(*keys, frame_time, *[result(v, how).alias(v) for v, how in variables.items()])


def frame_variables(columns: Sequence[str], prefix: str = "era5_") -> dict[str, str]:
    """How each weather column of a table is reduced to one value per frame."""
    found = {c: WEATHER_AGGREGATES.get(c.removeprefix(prefix)) for c in columns if c.startswith(prefix)}
    unknown = [c for c, how in found.items() if how is None]
    if unknown:
        raise ValueError(f"no aggregate known for {', '.join(unknown)}")
    return found


def match_to_calendar(
    readings: DataFrame, day0: str, cadence_days: int, n_frames: int, variables: Mapping[str, str], keys: Sequence[str] = PIXEL, reading_time: str = "day"
) -> DataFrame:
    """The same on a regular calendar, frame ``t`` being day0 + t * cadence: ``(keys..., t, variables...)``.

    The frame of a reading is arithmetic on its date, so this is one grouping, and a
    frame without an image has its own weather. Readings up to day0 belong to frame
    0, readings after the last frame to none.
    """
    days = F.datediff(F.col(reading_time).cast("date"), F.lit(day0).cast("date"))
    t = F.greatest(F.ceil(days / cadence_days), F.lit(0)).cast("int")
    how = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}
    placed = readings.withColumn("t", t).filter(F.col("t") < n_frames)
    return placed.groupBy(*keys, "t").agg(*[how[h](v).alias(v) for v, h in variables.items()])


def lead_weather(df: DataFrame, variables: Sequence[str], shift: int, keys: Sequence[str] = PIXEL) -> DataFrame:
    """Give each frame the weather of frame ``t + shift``; missing where there is no such frame."""
    if shift == 0:
        return df
    later = Window.partitionBy(*keys).orderBy("t").rangeBetween(shift, shift)
    return df.withColumns({v: F.first(v).over(later) for v in variables})


def best_orbit_phase(frames: DataFrame, value: str, scene: str = "scene_id", day: str = "day", cadence: int = 5) -> DataFrame:
    """Per scene, the phase ``day mod cadence`` with most valid cells; the lowest phase of equals."""
    counts = frames.groupBy(scene, F.pmod(day, F.lit(cadence)).cast("int").alias("phase")).agg(F.count(value).alias("n_valid"))
    best = F.max(F.struct(F.col("n_valid"), (-F.col("phase")).alias("neg"))).alias("__best")
    return counts.groupBy(scene).agg(best).select(scene, (-F.col("__best.neg")).alias("phase"), F.col("__best.n_valid").alias("n_valid"))


def keep_best_orbit(frames: DataFrame, value: str, scene: str = "scene_id", day: str = "day", cadence: int = 5) -> DataFrame:
    """Frames on the best-covered phase of their scene."""
    best = best_orbit_phase(frames, value, scene, day, cadence).select(scene, "phase")
    tagged = frames.withColumn("phase", F.pmod(day, F.lit(cadence)).cast("int"))
    return tagged.join(best, [scene, "phase"], "left_semi").drop("phase")
