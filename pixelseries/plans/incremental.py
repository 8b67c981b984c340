"""Builds that go on from stored cubes: only scenes without one are read from the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import bands_with_prefix
from ..operators.series import PIXEL
from ..session import cut_lineage
from ..sources import store
from .dataset import Dataset, DatasetConfig, build_dataset

REQUEST = ["scene_id", "start", "end", "lon", "lat", "width", "height"]


def stored_requests(spark: SparkSession, root: str, like: DataFrame) -> DataFrame:
    """The requests whose raw cubes are stored under ``root``."""
    path = f"{root}/catalogue"
    return spark.read.schema(like.schema).parquet(path) if store.is_stored(spark, path) else like.filter("false")


def raw_cubes(requests: DataFrame, source: DataFrame, root: str, split: str) -> DataFrame:
    """Raw frames of all requested scenes; those not stored yet are taken from ``source`` and stored.

    ``requests`` has ``scene_id, start, end, lon, lat, width, height``, one row per scene; a cube of the same months,
    place and size is the same cube, also under another scene's name. ``source``
    is read for the other scenes alone, and only their files are written. A scene
    enters the catalogue after its cube is written: a run that is stopped leaves nothing that
    a later one would take for done.
    """
    spark = requests.sparkSession
    wanted = cut_lineage(requests.select(*REQUEST))
    have = stored_requests(spark, root, wanted)
    new = cut_lineage(store.to_build(wanted, have))
    if not new.isEmpty():
        store.write_cubes(source.join(new.select("scene_id"), "scene_id", "left_semi"), f"{root}/cubes", split, raw=True)
        new.write.mode("append").parquet(f"{root}/catalogue")
    names = store.same_cubes(wanted, stored_requests(spark, root, wanted))
    cubes = store.read_cubes(spark, f"{root}/cubes", split, raw=True).withColumnRenamed("scene_id", "stored_as")
    return cubes.join(names, "stored_as").drop("stored_as")


def build_requested(
    requests: DataFrame, source: DataFrame, static: DataFrame, weather: DataFrame, config: DatasetConfig, day0: str, root: str, split: str, **more
) -> Dataset:
    """The data set of all requested scenes: stored raw cubes and new ones, cleaned together."""
    frames = raw_cubes(requests, source, root, split)
    kind = dict(source.dtypes)["scene_id"]
    columns = [c for c in source.columns if c in {*PIXEL, "x", "y", "t", "ts"} or c in bands_with_prefix(source, "s2")]
    return build_dataset(frames.withColumn("scene_id", F.col("scene_id").cast(kind)).select(*columns), static, weather, config, day0, **more)
