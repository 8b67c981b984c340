"""Dictionary of bands: description, source and how a band is interpolated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Band names, and the order of the satellite and weather bands in a sample.
SATELLITE_BANDS = ("B02", "B03", "B04", "B08", "B8A")
WEATHER_VARIABLES = ("sp", "tp", "sr", "t", "maxt", "mint", "ap", "dp")
SOIL_DEPTHS_CM = ("0_5", "5_15", "15_30", "30_60", "60_100", "100_200")
SOIL_FAMILIES = {
    "CLAY": "share of clay in percent",
    "FED": "density of the fine earth in g/cm3",
    "GRAV": "share of gravel in percent",
    "SAND": "share of sand in percent",
    "CARB": "organic carbon in g/kg",
    "PH": "acidity (pH)",
}
TERRAIN_FAMILIES = {
    "slope": "steepness in degrees",
    "easting": "how far the slope faces east",
    "northing": "how far the slope faces north",
    "rugg": "height differences to the neighbours",
    "curv": "mean of plan and profile curvature",
    "twi": "wetness by upslope area and steepness",
}
OTHER_LAYERS = {
    "NDVI": "vegetation index from red and near infrared",
    "NDWI": "water index from green and near infrared",
    "FC": "mix of tree species",
    "FH": "height of the vegetation in metres",
    "SDEP": "depth of the soil in cm",
    "FOREST_MASK": "1 where forest grows",
    "DROUGHT_MASK": "1 where a drought was recorded",
}
INDEXES = ("NDVI", "NDWI")
RESOLUTIONS_M = (20, 100, 500)


def band_rows() -> list[tuple[str, str, str]]:
    """``band, description, source`` in order; soil and terrain names follow a rule."""
    found = [(f"{f}{d}", f"{text}, {d.replace('_', ' to ')} cm deep", "soil maps") for f, text in SOIL_FAMILIES.items() for d in SOIL_DEPTHS_CM]
    for metres in RESOLUTIONS_M:
        suffix, at = "" if metres == 20 else f"_{metres}", f"on cells of {metres} m"
        found.append((f"DEM{suffix}", f"height above sea level {at}", "elevation model"))
        found += [(f"{f}{suffix}", f"{text} {at}", "elevation model") for f, text in TERRAIN_FAMILIES.items()]
    source = {"FC": "vegetation maps", "FH": "vegetation maps", "SDEP": "soil maps"}
    return found + [(b, text, "satellite" if b in INDEXES else source.get(b, "labels")) for b, text in OTHER_LAYERS.items()]


def band_descriptions() -> dict[str, str]:
    return {band: text for band, text, _ in band_rows()}


def band_dictionary(spark: SparkSession) -> DataFrame:
    """``ord, band, description, source, provider, interpolation``: a fixed list of about 65 rows, safe to broadcast."""
    rows = [F.struct(F.lit(i).alias("ord"), *(F.lit(v).alias(n) for n, v in zip(("band", "description", "source"), row))) for i, row in enumerate(band_rows())]
    provider = F.when(F.col("source") == "satellite", "Sentinel 2").otherwise("Local data")
    return with_interpolation(spark.range(1).select(F.inline(F.array(*rows))).withColumn("provider", provider))


def with_interpolation(bands: DataFrame) -> DataFrame:
    """Satellite bands are interpolated linearly, all others by nearest neighbour."""
    return bands.withColumn("interpolation", F.when(F.col("provider") == "Sentinel 2", "linear").otherwise("nearest"))


def band_attributes(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Attributes of the bands in a table with a ``band`` column."""
    return found.join(F.broadcast(dictionary), "band", "left")
