"""Per-pixel series: dense frames, gaps, interpolation.

A pixel series has at most one row per frame, so its length is bounded by the
frame calendar.  All operators here partition by the pixel key; chained, they
share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ("scene_id", "pixel_id")


def frame_index(frames: DataFrame, scene: str = "scene_id", ts: str = "ts") -> DataFrame:
    """Frame number ``t`` from 0 for every distinct date of a scene."""
    calendar = frames.select(scene, ts).distinct()
    return calendar.withColumn("t", F.dense_rank().over(Window.partitionBy(scene).orderBy(ts)) - 1)


def densify(frames: DataFrame, n_frames: int, keys: Sequence[str] = PIXEL, bands: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """One row per pixel and frame ``0..n_frames-1``; new rows have missing bands.

    Each row also emits the absent frames between it and the next row (the
    first row those before it), so one window replaces a calendar join.
    ``carry`` columns are constant per pixel and are repeated. A frame outside
    the calendar and a second row for a frame are errors.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    lo = F.when(F.lag("t").over(w).isNull(), F.lit(0)).otherwise(F.col("t"))
    hi = F.greatest(F.coalesce(F.lead("t").over(w) - 1, F.lit(n_frames - 1)), F.col("t"))
    outside = F.raise_error(F.concat(F.lit(f"frame outside 0..{n_frames - 1}: "), F.coalesce(F.col("t").cast("string"), F.lit("none")))).cast("int")
    twice = F.raise_error(F.concat(F.lit("two rows of one pixel for frame "), F.col("t").cast("string"))).cast("int")
    rows = (
        frames.select(*keys, *carry, F.when(F.col("t").between(0, n_frames - 1), F.col("t").cast("int")).otherwise(outside).alias("t"), *bands)
        .withColumns({"__lo": F.when(F.lag("t").over(w) == F.col("t"), twice).otherwise(lo), "__hi": hi})
        .withColumn("__t", F.explode(F.sequence("__lo", "__hi")))
    )
    here = F.col("__t") == F.col("t")
    return rows.select(*keys, *carry, F.col("__t").alias("t"), *[F.when(here, F.col(b)).alias(b) for b in bands])


def _neighbours(value: str, x: Column, keys: Sequence[str]) -> tuple[Column, Column]:
    """Last and next known ``(x, value)``, the current row included.

    The forward look-up is a backward frame over the reversed order: a frame
    that ends at ``unboundedFollowing`` would be rescanned for every row.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(x.alias("x"), F.col(value).alias("v")))
    upto = (Window.unboundedPreceding, 0)
    before = F.last(known, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.asc("t")).rowsBetween(*upto))
    after = F.last(known, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("t")).rowsBetween(*upto))
    return before, after


def _lerp(value: str, x: Column, p: Column, n: Column, hold_ends: bool) -> Column:
    inside = p["v"] + (n["v"] - p["v"]) * F.try_divide(x - p["x"], n["x"] - p["x"])
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(p.isNotNull() & n.isNotNull(), inside)
    return filled.otherwise(F.coalesce(p["v"], n["v"])) if hold_ends else filled


def _interpolate(df: DataFrame, bands: Sequence[str], x: Column, keys: Sequence[str], hold_ends: bool, where: Column | None = None) -> DataFrame:
    pairs = [_neighbours(band, x, keys) for band in bands]
    # all bands in one projection: one sort per direction
    found = df.withColumns({f"__{side}{i}": c for i, pair in enumerate(pairs) for side, c in zip("pn", pair)})
    filled = {b: _lerp(b, x, F.col(f"__p{i}"), F.col(f"__n{i}"), hold_ends) for i, b in enumerate(bands)}
    if where is not None:
        filled = {b: F.when(where, new).otherwise(F.col(b)) for b, new in filled.items()}
    return found.withColumns(filled).drop(*[f"__{s}{i}" for i in range(len(bands)) for s in "pn"])


def fill_by_index(df: DataFrame, bands: Sequence[str], keys: Sequence[str] = PIXEL, where: Column | None = None) -> DataFrame:
    """Linear by frame number; the ends hold the nearest known value.

    Rows outside ``where`` keep their values.
    """
    return _interpolate(df, bands, F.col("t").cast("double"), keys, hold_ends=True, where=where)


def fill_by_time(df: DataFrame, bands: Sequence[str], keys: Sequence[str] = PIXEL, ts: str = "ts") -> DataFrame:
    """Linear in time; values before the first and after the last known one stay missing.

    Zone-free time stamps count without a zone: no hour is lost or gained at a clock change.
    """
    kind = df.schema[ts].dataType.typeName()
    if kind == "date":
        x = F.unix_date(ts)
    elif kind == "timestamp_ntz":
        x = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    else:
        x = F.unix_micros(ts)
    x = x.cast("double")
    return _interpolate(df, bands, x, keys, hold_ends=False)


def longest_gap(df: DataFrame, value: str, keys: Sequence[str] = PIXEL) -> DataFrame:
    """Length and first frame of the longest missing run of each pixel; the first of equals wins.

    Expects dense frames.  Without a gap both ``max_gap`` and ``gap_start`` are 0.
    """
    last_known = F.last(F.when(F.col(value).isNotNull(), F.col("t")), ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    )
    first = F.min("t").over(Window.partitionBy(*keys))
    runs = df.withColumn("__begin", F.coalesce(last_known + 1, first)).withColumn(
        "__run", F.when(F.col(value).isNull(), F.col("t") - F.col("__begin") + 1).otherwise(0)
    )
    best = F.max(F.struct(F.col("__run").alias("run"), (-F.col("__begin")).alias("neg_begin")))
    return (
        runs.groupBy(*keys)
        .agg(best.alias("__best"), F.count(F.col(value)).alias("n_known"))
        .select(
            *keys,
            F.col("__best.run").cast("bigint").alias("max_gap"),
            F.when(F.col("__best.run") > 0, -F.col("__best.neg_begin")).otherwise(0).cast("bigint").alias("gap_start"),
            F.col("n_known"),
        )
    )


def flag_usable(df: DataFrame, value: str, max_gap: int, keys: Sequence[str] = PIXEL) -> DataFrame:
    """Add ``to_sample``: some value is known and no missing run exceeds ``max_gap``.

    Same rule as :func:`longest_gap`, as windows: the flag lands on every row
    without a join back.
    """
    pixel = Window.partitionBy(*keys)
    history = pixel.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    last_known = F.last(F.when(F.col(value).isNotNull(), F.col("t")), ignorenulls=True).over(history)
    run = F.when(F.col(value).isNull(), F.col("t") - F.coalesce(last_known, F.min("t").over(pixel) - 1)).otherwise(0)
    return (
        df.withColumn("__run", run)
        .withColumn("to_sample", ((F.max("__run").over(pixel) <= max_gap) & (F.count(F.col(value)).over(pixel) > 0)).cast("int"))
        .drop("__run")
    )


def change(df: DataFrame, value: str, out: str = "change", keys: Sequence[str] = PIXEL, order: str = "t") -> DataFrame:
    """``(v[t] - v[t-1] + 1) / 2``; missing where frame ``t - 1`` is, too."""
    previous = F.first(value).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(-1, -1))
    return df.withColumn(out, (F.col(value) - previous + 1) / 2)
