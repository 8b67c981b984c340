"""Hyper-parameter trials."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parameter_lists(spark: SparkSession, params: Mapping[str, Sequence]) -> DataFrame:
    """One row with one array column per parameter."""
    return spark.range(1).select(*[F.array(*[F.lit(v) for v in values]).alias(p) for p, values in params.items()])


def trial_grid(lists: DataFrame) -> DataFrame:
    """Every combination of the listed values, with its trial name ``config_(p=v)_(q=w)``."""
    params = lists.columns
    grid = lists
    for p in params:
        grid = grid.withColumn(p, F.explode(F.array_sort(p)))
    name = F.concat_ws("_", F.lit("config"), *[F.concat(F.lit(f"({p}="), F.col(p).cast("string"), F.lit(")")) for p in params])
    return grid.withColumn("trial", name)


def with_settings(trials: DataFrame, settings: str, values: Mapping[str, str]) -> DataFrame:
    """Write parameter columns into the nested ``settings`` struct; keys are dotted paths."""
    struct = F.col(settings)
    for path, column in values.items():
        struct = struct.withField(path, F.col(column))
    return trials.withColumn(settings, struct)


def pending_trials(grid: DataFrame, done: DataFrame, mode: str = "add") -> DataFrame:
    """``add``: the trials without a run yet; ``overwrite``: all of them."""
    if mode == "overwrite":
        return grid
    if mode != "add":
        raise ValueError("mode must be 'add' or 'overwrite'")
    return grid.join(done.select("trial").distinct(), "trial", "left_anti")


def best_epochs(scores: DataFrame) -> DataFrame:
    """Best score of each trial and its first epoch; scores are compared as numbers."""
    numeric = scores.select("trial", F.col("epoch").cast("int").alias("epoch"), F.col("rmse").cast("double").alias("rmse"))
    return numeric.groupBy("trial").agg(F.min("rmse").alias("best_rmse"), F.min(F.struct("rmse", "epoch")).getField("epoch").alias("best_epoch"))


def best_trial(scores: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` best trials."""
    return best_epochs(scores).orderBy("best_rmse", "trial").limit(n)
