"""Column -> Column helpers: band arithmetic, missing values, masks, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA = -9999.0

# Metres -> degrees for the three supported resolutions.
DEGREES_PER_RESOLUTION = {20: 0.00018, 100: 0.0009, 500: 0.0045}


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


# --- bands -----------------------------------------------------------------

def normalized_difference(a: Column | str, b: Column | str, eps: float = 0.0) -> Column:
    """``(a - b) / (a + b + eps)``; missing where the denominator is zero."""
    a, b = _c(a), _c(b)
    return F.try_divide(a - b, a + b + F.lit(eps) if eps else a + b)


def to_missing(value: Column | str, nodata: float = NODATA) -> Column:
    """NaN and the nodata sentinel become NULL."""
    value = _c(value).cast("double")
    return F.when(~F.isnan(value) & (value != F.lit(nodata)), value)


def clear_only(value: Column | str, mask: Column | str = "s2_mask") -> Column:
    """Value where the cloud mask is 0, else missing."""
    return F.when(_c(mask) == 0, _c(value))


def vegetation_only(value: Column | str, landcover: Column | str, low: int = 10, high: int = 30) -> Column:
    """Value where the land-cover class is vegetation (``low..high``, both included)."""
    return F.when(_c(landcover).between(low, high), _c(value))


def min_max_scaled(value: Column | str, low: Column, high: Column) -> Column:
    """``(v - low) / (high - low)``; missing when the range is empty."""
    return F.try_divide(_c(value) - low, high - low)


def northing(aspect: Column | str) -> Column:
    return F.cos(F.radians(_c(aspect)))


def easting(aspect: Column | str) -> Column:
    return F.sin(F.radians(_c(aspect)))


def degrees_for_resolution(metres: Column | str) -> Column:
    """Cell size in degrees of a 20, 100 or 500 m grid, NULL for any other resolution."""
    entries = [F.lit(v) for pair in DEGREES_PER_RESOLUTION.items() for v in pair]
    return F.try_element_at(F.create_map(*entries), _c(metres).cast("int"))


# --- geometry --------------------------------------------------------------

def cell_centre(index: Column | str, origin: float | Column, size: float | Column) -> Column:
    """Coordinate of the centre of cell ``index``."""
    return F.lit(origin) + (_c(index) + F.lit(0.5)) * F.lit(size)


def cell_index(coordinate: Column | str, origin: float | Column, size: float | Column) -> Column:
    """Index of the cell that holds ``coordinate``."""
    return F.floor((_c(coordinate) - F.lit(origin)) / F.lit(size)).cast("bigint")


def in_bbox(lon: Column | str, lat: Column | str, bbox) -> Column:
    """Inside ``[min_x, min_y, max_x, max_y]``, bounds included; true without a box."""
    if bbox is None:
        return F.lit(True)
    return _c(lon).between(bbox[0], bbox[2]) & _c(lat).between(bbox[1], bbox[3])


def in_time_range(start: Column | str, end: Column | str, time_range) -> Column:
    """``start >= lo and end <= hi``; true without a range."""
    if time_range is None:
        return F.lit(True)
    lo, hi = (F.lit(v).cast("date") for v in time_range)
    return (_c(start) >= lo) & (_c(end) <= hi)


def beyond(coordinate: Column | str, bound: float, side: str) -> Column:
    """Strictly on the ``less`` or ``more`` side of a bound."""
    if side not in ("less", "more"):
        raise ValueError("side must be 'less' or 'more'")
    return _c(coordinate) < bound if side == "less" else _c(coordinate) > bound


# --- dates -----------------------------------------------------------------

def in_summer(ts: Column | str) -> Column:
    """June to August."""
    return F.month(_c(ts)).between(6, 8)


def forecast_date(start: Column | str, step: Column | str, cadence_days: int = 5) -> Column:
    """Date of forecast ``step`` (from 0), counted from ``start``."""
    return F.date_add(_c(start), F.lit(cadence_days) * (_c(step).cast("int") + F.lit(1)))


# --- scene predicates ------------------------------------------------------

def positive_scene(forest: Column | str, drought: Column | str, forest_min: float, drought_min: float) -> Column:
    return (_c(forest) > forest_min) & (_c(drought) > drought_min)


def negative_scene(forest: Column | str, drought: Column | str, forest_min: float) -> Column:
    return (_c(forest) > forest_min) & (_c(drought) == 0)


def eligible_pixel(to_sample, forest, forest_min: float, drought=None, drought_min: float = 0.0) -> Column:
    """Usable after cleaning, enough forest and, with labels, enough drought."""
    ok = (_c(to_sample).cast("int") == 1) & (_c(forest) > forest_min)
    return ok if drought is None else ok & (_c(drought) > drought_min)


# --- arrays and text -------------------------------------------------------

def transpose(matrix: Column | str) -> Column:
    """``array(band, time)`` -> ``array(time, band)``."""
    matrix = _c(matrix)
    return F.transform(
        F.sequence(F.lit(0), F.size(matrix[0]) - 1),
        lambda i: F.transform(matrix, lambda row: row[i]),
    )


def to_bool(text: Column | str) -> Column:
    """Usual spellings of true and false; anything else is an error."""
    word = F.lower(F.trim(_c(text).cast("string")))
    return (
        F.when(word.isin("yes", "true", "t", "y", "1"), F.lit(True))
        .when(word.isin("no", "false", "f", "n", "0"), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(word, F.lit("NULL")))).cast("boolean"))
    )


def seeded_order(seed: int | str, *keys: Column | str) -> Column:
    """Deterministic pseudo-random sort key: ``md5(seed:key:key...)``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_c(k).cast("string") for k in keys]))
