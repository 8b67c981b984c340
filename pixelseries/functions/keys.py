"""Sample and cube names <-> columns.

``sy_sm_sd_ey_em_ed_lon_lat_w_h[_shift]`` without zero padding; samples carry
the shift (11 parts), cubes do not (10 parts).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import _c

KEY_FIELDS = ("start", "end", "lon", "lat", "width", "height", "shift")


def make_key(start, end, lon, lat, width, height, shift=None) -> Column:
    """Name without suffix; pass ``shift`` for samples, leave it out for cubes."""
    dates = [part(_c(d)) for d in (start, end) for part in (F.year, F.month, F.day)]
    rest = [_c(v) for v in (lon, lat, width, height)]
    if shift is not None:
        rest.append(_c(shift) if not isinstance(shift, int) else F.lit(shift))
    return F.concat_ws("_", *[v.cast("string") for v in dates + rest])


def key_body(file_name) -> Column:
    """Drop the directory, an ``experiment_`` prefix and the ``.npz`` suffix."""
    return F.regexp_extract(_c(file_name), r"(\d{4}_\d{1,2}_\d{1,2}_\d{4}_.*)(?=\.npz)", 1)


def parse_key(key) -> Column:
    """Struct of ``KEY_FIELDS``; ``shift`` is NULL for cube names."""
    parts = F.split(_c(key), "_")

    def part(i: int, kind: str) -> Column:
        return F.get(parts, F.lit(i)).cast(kind)

    def date_at(i: int) -> Column:
        return F.make_date(part(i, "int"), part(i + 1, "int"), part(i + 2, "int"))

    return F.struct(
        date_at(0).alias("start"),
        date_at(3).alias("end"),
        part(6, "double").alias("lon"),
        part(7, "double").alias("lat"),
        part(8, "int").alias("width"),
        part(9, "int").alias("height"),
        part(10, "int").alias("shift"),
    )
