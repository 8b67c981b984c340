"""Stores for cubes, stats, samples, predictions and scores.

Scenes differ a lot in size, so writers rebalance by the partition columns:
hot scenes are split over several files, small ones share a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import band_matrix
from ..operators.topk import one_per_key
from ..session import cut_lineage


def _write(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace just the partitions that occur in ``df``."""
    (
        df.hint("rebalance", *[F.col(c) for c in by])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether the folder exists, in whatever file system the path names."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def write_cubes(frames: DataFrame, path: str, split: str, raw: bool) -> None:
    """Frames of whole scenes, ``raw`` or cleaned."""
    tagged = frames.withColumns({"split": F.lit(split), "stage": F.lit("raw" if raw else "clean")})
    _write(tagged, path, ["split", "stage", "scene_id"])


def read_cubes(spark: SparkSession, path: str, split: str, raw: bool = False) -> DataFrame:
    stage = "raw" if raw else "clean"
    return spark.read.parquet(path).filter((F.col("split") == split) & (F.col("stage") == stage)).drop("split", "stage")


def cube_catalogue(frames: DataFrame) -> DataFrame:
    """First and last date, centre and size of every scene, reduced to pixels before it is counted."""
    pixels = frames.groupBy("scene_id", "x", "y").agg(F.min("ts").alias("__s"), F.max("ts").alias("__e"))
    return pixels.groupBy("scene_id").agg(
        F.min("__s").alias("start"),
        F.max("__e").alias("end"),
        (F.max("x") - F.min("x") + 1).cast("int").alias("width"),
        (F.max("y") - F.min("y") + 1).cast("int").alias("height"),
    )


def _catalogue_key(df: DataFrame) -> DataFrame:
    """Start and end month, place in millionths of a degree, size: integers, not floats."""
    return df.withColumns(
        {
            "__from": F.date_trunc("month", "start"),
            "__to": F.date_trunc("month", "end"),
            "__lon": F.round(F.col("lon") * 1e6).cast("bigint"),
            "__lat": F.round(F.col("lat") * 1e6).cast("bigint"),
        }
    )


_CATALOGUE = ["__from", "__to", "__lon", "__lat", "width", "height"]


def reusable(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Requested cubes that exist already."""
    have = _catalogue_key(catalogue).select(*_CATALOGUE)
    return _catalogue_key(requests).join(have, _CATALOGUE, "left_semi").select(*requests.columns)


def to_build(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Requested cubes that do not exist yet."""
    have = _catalogue_key(catalogue).select(*_CATALOGUE)
    return _catalogue_key(requests).join(have, _CATALOGUE, "left_anti").select(*requests.columns)


def same_cubes(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``scene_id, stored_as`` of the requested cubes that exist: of several equal ones the smallest name."""
    have = _catalogue_key(catalogue).groupBy(*_CATALOGUE).agg(F.min("scene_id").alias("stored_as"))
    return _catalogue_key(requests).join(have, _CATALOGUE).select("scene_id", "stored_as")


def write_stats(stats: DataFrame, path: str) -> None:
    """Band statistics by ``split`` and scene; a scene written again replaces the old one, others stay."""
    _write(stats, path, ["split", "scene_id"])


def pack_samples(samples: DataFrame, bands: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Samples in sink shape: ``context`` and ``target`` as ``array(band, time)``."""
    return samples.select(*keys, band_matrix("context", bands).alias("context"), band_matrix("target", bands).alias("target"))


def write_samples(samples: DataFrame, path: str, key: Sequence[str] = ("sample_id",)) -> None:
    """Packed samples by ``split`` and scene; a sample of the same name replaces the old one, others stay.

    Stored samples of the scenes that are written now are read back without the
    replaced names and written again with the new ones.
    """
    by = ["split", "scene_id"]
    if is_stored(samples.sparkSession, path):
        scenes = samples.select(*by).distinct()
        old = samples.sparkSession.read.schema(samples.schema).parquet(path)
        kept = old.join(scenes, by, "left_semi").join(samples.select(*by, *key), [*by, *key], "left_anti")
        samples = cut_lineage(kept.select(samples.columns).unionByName(samples))
    _write(samples, path, by)


def write_predictions(predictions: DataFrame, path: str, key: Sequence[str] = ("sample_id", "step")) -> None:
    """Append the predictions whose key is not stored yet: the first write wins.

    Of several rows of one batch with the same key the one with the smallest other
    values is taken. Rows meet by the first column of the key, so that the steps of
    a sample stay together: there should be many samples of few steps each.
    """
    spark = predictions.sparkSession
    stored = spark.read.schema(predictions.schema).parquet(path) if is_stored(spark, path) else None
    one_per_key(predictions, key, stored, key[:1]).write.mode("append").parquet(path)


def read_scores(spark: SparkSession, paths: Sequence[str] | str, metric: str = "RMSE_drought") -> DataFrame:
    """Score lists of many runs, numbers stored as text; the trial is the name of the folder."""
    files = spark.read.option("multiLine", True).schema(f"`{metric}` string, epoch string").json(paths if isinstance(paths, str) else list(paths))
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return files.select(
        F.url_decode(folder).alias("trial"), F.col("epoch").try_cast("int").alias("epoch"), F.col(metric).try_cast("double").alias("rmse")
    )


def add_score_lists(scores: DataFrame, path: str, metric: str = "RMSE_drought") -> None:
    """``trial, epoch, rmse`` as score lists, a folder per trial; lists that are there stay."""
    entry = F.struct(F.col("rmse").cast("string").alias(metric), F.col("epoch").cast("string").alias("epoch"))
    lists = scores.groupBy("trial").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("value"))  # one entry per epoch
    lists.write.mode("append").partitionBy("trial").text(path)


def score_lists(spark: SparkSession, path: str, metric: str = "RMSE_drought") -> DataFrame:
    """``trial, epoch, rmse`` of all lists that :func:`add_score_lists` wrote to ``path``; none if there are none."""
    if not is_stored(spark, path):
        return spark.createDataFrame([], "trial string, epoch int, rmse double")
    found = read_scores(spark, f"{path}/trial=*/*.txt", metric)
    return found.withColumn("trial", F.url_decode(F.regexp_replace("trial", "^trial=", "")))  # as the writer escapes folder names


def write_states(states: DataFrame, path: str) -> None:
    """Metric states by ``run``; a run written again replaces its old states, others stay."""
    _write(states, path, ["run"])


def write_scores(scores: DataFrame, path: str) -> None:
    """All epochs of all trials as CSV."""
    scores.write.mode("overwrite").option("header", True).csv(path)
