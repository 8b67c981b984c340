"""Context/target samples cut from pixel series.

A series is packed into one array per pixel (its length is the number of
frames).  Windows are then array slices: the only shuffle is the one that
brought the pixel together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import PIXEL


def pack_series(df: DataFrame, bands: Sequence[str], keys: Sequence[str] = PIXEL, ts: str | None = "ts") -> DataFrame:
    """One row per pixel with ``series array<struct<t, [ts,] bands>>`` in frame order; expects dense frames.

    Two rows of one frame are an error: they would shift the windows after them.
    """
    fields = ["t"] + ([ts] if ts else []) + list(bands)
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("series"))
    twice = F.size(F.array_distinct("series.t")) < F.size("series")
    checked = F.when(twice, F.raise_error(F.lit("two rows of one pixel for a frame")).cast(packed.schema["series"].dataType)).otherwise(F.col("series"))
    return packed.withColumn("series", checked)


def _need_frames(n: Column, context: int, target: int, shift: int) -> Column:
    short = F.lit(context + target) > n - F.lit(shift)
    return F.when(short, F.raise_error(F.lit("series is shorter than context + target + shift frames")).cast("int")).otherwise(n)


def sliding_starts(series: Column, context: int, target: int, shift: int = 0, stride: int = 1) -> Column:
    """All window starts ``0 .. n - shift - context - target``; an error when there is none."""
    n = _need_frames(F.size(series), context, target, shift)
    return F.sequence(F.lit(0), n - F.lit(shift + context + target), F.lit(stride))


def season_starts(series: Column, context: int, target: int, shift: int = 0, compat: bool = False) -> Column:
    """Window starts whose first target frame lies in June to August.

    ``compat`` leaves out the last start of each year.
    """
    every = sliding_starts(series, context, target, shift)

    def target_date(s: Column) -> Column:
        return F.get(series, s + F.lit(context))["ts"]

    def in_season(s: Column) -> Column:
        return F.month(target_date(s)).between(6, 8)

    if not compat:
        return F.filter(every, in_season)
    last = F.size(series) - F.lit(shift + context + target)

    def followed(s: Column) -> Column:
        after = s + F.lit(1)
        return in_season(s) & (after <= last) & in_season(after) & (F.year(target_date(s)) == F.year(target_date(after)))

    return F.filter(every, followed)


def cut_windows(packed: DataFrame, starts: Column, context: int, target: int, keys: Sequence[str] = PIXEL) -> DataFrame:
    """One row per pixel and start: ``context`` and ``target`` arrays of frame structs."""
    carried = [c for c in packed.columns if c not in keys and c != "series"]
    exploded = packed.select(*keys, *carried, "series", F.explode(starts).alias("start_t"))
    return exploded.select(
        *keys,
        *carried,
        "start_t",
        F.slice("series", F.col("start_t") + 1, F.lit(context)).alias("context"),
        F.slice("series", F.col("start_t") + 1 + F.lit(context), F.lit(target)).alias("target"),
    )


def sliding_windows(packed: DataFrame, context: int, target: int, shift: int = 0, stride: int = 1, keys: Sequence[str] = PIXEL) -> DataFrame:
    return cut_windows(packed, sliding_starts(F.col("series"), context, target, shift, stride), context, target, keys)


def season_windows(packed: DataFrame, context: int, target: int, shift: int = 0, compat: bool = False, keys: Sequence[str] = PIXEL) -> DataFrame:
    return cut_windows(packed, season_starts(F.col("series"), context, target, shift, compat), context, target, keys)


def long_samples(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Packed samples -> one row per frame with ``part`` (context/target) and ``step`` counted over both."""
    def tagged(part: str) -> Column:
        return F.transform(F.col(part), lambda f: f.withField("part", F.lit(part)))

    both = F.concat(tagged("context"), tagged("target"))
    return samples.select(*keys, F.posexplode(both).alias("step", "frame")).select(*keys, "step", "frame.*")


def band_matrix(frames_array: Column | str, bands: Sequence[str]) -> Column:
    """Frame structs -> ``array(band, time)`` of doubles, the layout samples are stored in."""
    frames_array = F.col(frames_array) if isinstance(frames_array, str) else frames_array
    return F.array(*[frames_array[b].cast("array<double>") for b in bands])


def last_summer_frame(calendar: DataFrame, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Per year, the last frame before 1 September and its index within the year."""
    early = F.col(ts) < F.make_date(F.year(ts), F.lit(9), F.lit(1))
    return (
        calendar.select(*keys, ts)
        .distinct()
        .filter(early)
        .groupBy(*keys, F.year(ts).alias("year"))
        .agg((F.count("*") - 1).alias("idx"), F.max(ts).alias(ts))
    )
