"""Band selection by naming convention: ``s2_*``, ``era5_*``, everything else static."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import normalized_difference, to_missing

# Helper layers that never reach a sample.
HELPER_BANDS = ("s2_mask", "s2_avail", "s2_SCL", "to_sample", "FOREST_MASK", "DROUGHT_MASK")
KEY_COLUMNS = ("scene_id", "pixel_id", "x", "y", "lon", "lat", "t", "ts")


class MissingBandError(ValueError):
    """A band needed for a derived band is not there."""


def bands_with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def smoothable_bands(df: DataFrame) -> list[str]:
    """The continuous satellite bands: reflectances and the vegetation index."""
    return bands_with_prefix(df, "s2_B", "s2_ndvi")


def static_bands(df: DataFrame, keys: Sequence[str] = KEY_COLUMNS) -> list[str]:
    return [c for c in df.columns if not c.startswith(("s2", "era5")) and c not in keys]


def canonical_order(df: DataFrame, keys: Sequence[str] = KEY_COLUMNS) -> list[str]:
    """Satellite, then static, then weather bands."""
    return bands_with_prefix(df, "s2") + static_bands(df, keys) + bands_with_prefix(df, "era5")


def select_canonical(df: DataFrame, keys: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """Key columns first, bands in canonical order."""
    return df.select(*[k for k in keys if k in df.columns], *canonical_order(df, keys))


def drop_helper_bands(df: DataFrame, bands: Sequence[str] = HELPER_BANDS) -> DataFrame:
    return df.drop(*bands)


def _need(df: DataFrame, name: str, *bands: str) -> None:
    missing = [b for b in bands if b not in df.columns]
    if missing:
        raise MissingBandError(f"{name} needs {', '.join(missing)}")


def add_ndvi(df: DataFrame, eps: float = 0.0) -> DataFrame:
    _need(df, "NDVI", "s2_B04", "s2_B08")
    return df.withColumn("s2_ndvi", normalized_difference("s2_B08", "s2_B04", eps))


def add_ndwi(df: DataFrame, eps: float = 0.0) -> DataFrame:
    _need(df, "NDWI", "s2_B03", "s2_B08")
    return df.withColumn("s2_ndwi", normalized_difference("s2_B08", "s2_B03", eps))


def add_derived_bands(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Compute NDVI and NDWI where wanted; the other names are static layers (see ``overlay``)."""
    for name, add in (("NDVI", add_ndvi), ("NDWI", add_ndwi)):
        if name in wanted:
            df = add(df)
    return df


def clean_missing(df: DataFrame, bands: Sequence[str], nodata: float = -9999.0) -> DataFrame:
    return df.withColumns({b: to_missing(b, nodata) for b in bands})


def any_missing(band: str) -> Column:
    return F.bool_or(F.col(band).isNull())


def all_missing(band: str) -> Column:
    return F.count(F.col(band)) == 0
