"""Band statistics and min-max normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import min_max_scaled


def band_stats(df: DataFrame, bands: Sequence[str], by: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Min and max of each band per scene over time and space: ``(by..., band, min, max)``."""
    found = df.groupBy(*by).agg(*[f(b).alias(f"{n}_{i}") for i, b in enumerate(bands) for n, f in (("min", F.min), ("max", F.max))])
    rows = [
        F.struct(F.lit(b).alias("band"), F.col(f"min_{i}").cast("double").alias("min"), F.col(f"max_{i}").cast("double").alias("max"))
        for i, b in enumerate(bands)
    ]
    return found.select(*by, F.inline(F.array(*rows)))


def global_stats(stats: DataFrame) -> DataFrame:
    """Min of the minima and max of the maxima per band."""
    return stats.groupBy("band").agg(F.min("min").alias("min"), F.max("max").alias("max"))


def normalise(df: DataFrame, bands: Sequence[str], stats: DataFrame | None, compat: bool = False) -> DataFrame:
    """``(v - min) / (max - min)`` with the stats of all scenes; missing where max = min.

    Without stats this is an error, or ``1 - v`` under ``compat``.
    """
    if stats is None:
        if not compat:
            raise ValueError("normalisation needs band statistics")
        return df.withColumns({b: F.lit(1.0) - F.col(b) for b in bands})
    ends = stats.agg(
        F.struct(
            *[
                agg(F.when(F.col("band") == b, F.col(end))).alias(f"{end}_{i}")
                for i, b in enumerate(bands)
                for end, agg in (("min", F.min), ("max", F.max))
            ]
        )
    ).scalar()
    return df.withColumns({b: min_max_scaled(b, ends[f"min_{i}"], ends[f"max_{i}"]) for i, b in enumerate(bands)})
