"""Scene lists, tile lists and file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCENE_SCHEMA = "lon double, lat double"


def read_scenes(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``lon, lat`` lines of one or more files."""
    return spark.read.csv(paths if isinstance(paths, str) else list(paths), schema=SCENE_SCHEMA, ignoreLeadingWhiteSpace=True)


def write_scenes(scenes: DataFrame, path: str) -> None:
    """One ``lon, lat`` line per scene."""
    scenes.select(F.format_string("%s, %s", F.col("lon").cast("string"), F.col("lat").cast("string"))).write.mode("overwrite").text(path)


def union_scenes(*lists: DataFrame) -> DataFrame:
    """Several scene lists as one, each scene once."""
    result = lists[0]
    for other in lists[1:]:
        result = result.unionByName(other)
    return result.dropDuplicates(["lon", "lat"])


def read_tile_urls(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    return tile_attributes(spark.read.text(paths if isinstance(paths, str) else list(paths)).select(F.col("value").alias("url")))


def tile_attributes(urls: DataFrame) -> DataFrame:
    """File name, year, kilometre tile, resolution and EPSG code read from ``<name>_<year>_<E>-<N>_<res>_<epsg>_<x>.tif``."""
    name = F.element_at(F.split("url", "/"), -1)
    pattern = r"_(\d{4})_(\d+)-(\d+)_([0-9.]+)_(\d+)_\d+\.tif$"

    def part(i: int, kind: str):
        return F.regexp_extract("file_name", pattern, i).try_cast(kind)

    return urls.withColumn("file_name", name).withColumns(
        {
            "year": part(1, "int"),
            "east_km": part(2, "int"),
            "north_km": part(3, "int"),
            "resolution": part(4, "double"),
            "epsg": part(5, "int"),
        }
    )


def list_files(spark: SparkSession, folder: str, pattern: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Names of the files that match a glob, minus those with an excluded ending, by name; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    names = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path")
    for ending in exclude:
        names = names.filter(~F.col("file_name").endswith(ending))
    return names.orderBy("file_name")
