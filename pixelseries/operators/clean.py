"""Cloud cleaning of satellite series and filling of weather and static gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import bands_with_prefix, smoothable_bands
from ..functions.columns import clear_only, to_missing
from .loess import PASSES, smooth_series
from .series import PIXEL, fill_by_index, flag_usable


def mask_clouds(df: DataFrame, bands: Sequence[str], mask: str = "s2_mask") -> DataFrame:
    """Keep values only where the mask is 0; rows stay."""
    return df.withColumns({b: clear_only(b, mask) for b in bands})


def weekly_quantile(df: DataFrame, band: str, q: float, keys: Sequence[str] = PIXEL, ts: str = "ts") -> DataFrame:
    """Quantile of a band per pixel and ISO week of year, all years pooled."""
    return df.groupBy(*keys, F.weekofyear(ts).alias("week")).agg(F.percentile(band, F.lit(q)).alias("q"), F.count(band).alias("n"))


def _quantile(values: Column, q: float) -> Column:
    """As ``percentile``, of sorted values: a few per pixel and week, so arrays cost less than its hash tables."""
    place = (F.size(values) - 1) * F.lit(float(q))
    below, above = F.floor(place).cast("int"), F.ceil(place).cast("int")
    low, high = F.get(values, below).cast("double"), F.get(values, above).cast("double")
    return F.when(low == high, low).otherwise((above - place) * low + (place - below) * high)


def drop_low_values(df: DataFrame, bands: Sequence[str], q: float, keys: Sequence[str] = PIXEL, ts: str = "ts") -> DataFrame:
    """Values below the pixel's quantile of that week of year go missing; the quantile itself stays."""
    week = Window.partitionBy(*keys, F.weekofyear(ts))
    pooled = {f"__q{i}": F.collect_list(b).over(week) for i, b in enumerate(bands)}
    kept = {b: F.when(F.col(b) >= _quantile(F.sort_array(f"__q{i}"), q), F.col(b)) for i, b in enumerate(bands)}
    return df.withColumns(pooled).withColumns(kept).drop(*pooled)


def clean_series(df: DataFrame, max_gap: int, remove_pct: float, loess_frac: float, passes: int = PASSES, keys: Sequence[str] = PIXEL) -> DataFrame:
    """Mask clouds, drop low outliers per week, flag usable pixels, fill and smooth them.

    Expects dense frames partitioned or partitionable by ``keys``; every step
    works within a pixel.
    """
    bands = bands_with_prefix(df, "s2")
    smooth = smoothable_bands(df)
    # the mask itself is an s2 layer, but must not be lost before it is used
    cleaned = drop_low_values(mask_clouds(df, [b for b in bands if b != "s2_mask"]), [b for b in bands if b != "s2_mask"], remove_pct, keys)
    flagged = flag_usable(cleaned, "s2_ndvi", max_gap, keys)
    filled = fill_by_index(flagged, smooth, keys, where=F.col("to_sample") == 1)
    return smooth_series(filled, smooth, loess_frac, passes, keys, usable="to_sample")


def fill_static(df: DataFrame, bands: Sequence[str], scene: str = "scene_id") -> DataFrame:
    """Missing or nodata static values become the scene's mean of that band."""
    df = df.withColumns({b: to_missing(b) for b in bands})
    means = df.groupBy(scene).agg(*[F.avg(b).alias(f"__m_{b}") for b in bands])
    filled = {b: F.coalesce(F.col(b), F.col(f"__m_{b}")) for b in bands}
    return df.join(means, scene, "left").withColumns(filled).drop(*[f"__m_{b}" for b in bands])


def attach_flag(pixels: DataFrame, flags: DataFrame, keys: Sequence[str] = PIXEL) -> DataFrame:
    """Bring ``to_sample`` onto a pixel table; pixels without a flag count as usable."""
    return pixels.join(flags.select(*keys, "to_sample"), list(keys), "left").withColumn("to_sample", F.coalesce("to_sample", F.lit(1)))
