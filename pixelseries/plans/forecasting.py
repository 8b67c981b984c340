"""Train, tune and score forecasts on packed samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.forecast import fit_forecaster, grid_search, moments, score_all, solve_all, training_rows
from ..operators.sampling import validation_split
from ..operators.tuning import parameter_lists, pending_trials, trial_grid
from ..session import cut_lineage
from ..sources import store


def forecast_scores(
    samples: DataFrame, bands: Sequence[str], target_band: str, horizon: int, train: str = "train", track: str = "test",
    static: Sequence[str] = (), stats: DataFrame | None = None, **setting: float
) -> DataFrame:
    """Fit on one split, predict another: error per target step.

    The windows of both are cut once and written: the fit reads them more than once.
    """
    both = samples.filter(F.col("split").isin(train, track))
    rows = cut_lineage(training_rows(both, bands, target_band, ("sample_id", "split"), static, stats))
    model = fit_forecaster(rows.filter(F.col("split") == train), horizon, **setting)
    scored = model.predict(rows.filter(F.col("split") == track))
    error = F.col("pred") - F.col("truth")
    return scored.groupBy("step").agg(F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("rmse")).orderBy("step")


def tune(samples: DataFrame, bands: Sequence[str], target_band: str, horizon: int, params: Mapping[str, Sequence[float]], val_fraction: float = 0.05, seed: int = 0) -> DataFrame:
    """Validation RMSE of every setting on an exact-size seeded split.

    The windows are cut once; the split then reads just the stored names.
    """
    rows = cut_lineage(training_rows(samples, bands, target_band))
    flagged = validation_split(rows, val_fraction, seed)
    return grid_search(flagged.filter(~F.col("is_val")), flagged.filter(F.col("is_val")), horizon, params)


def search(
    samples: DataFrame, bands: Sequence[str], target_band: str, horizon: int, params: Mapping[str, Sequence[float]], root: str,
    val_fraction: float = 0.05, seed: int = 0, batch: int = 8, patience: int | None = None, max_batches: int | None = None,
) -> DataFrame:
    """A grid search that goes on where it stopped: ``trial, epoch, rmse`` of all trials done.

    Training rows are stored under ``root/rows``, a score list per trial under ``root/trials``. Each
    round solves the next ``batch`` open trials in parallel from the same moments, scores
    them in one pass and stores the scores; trials stored before are not solved again.
    The search ends when no trial is open, after ``patience`` rounds without a better score,
    or after ``max_batches`` rounds of this call. A run that is killed loses one round.

    A root belongs to one set of samples, bands and splits.
    """
    spark = samples.sparkSession
    if not store.is_stored(spark, f"{root}/rows/_SUCCESS"):
        training_rows(samples, bands, target_band).write.mode("overwrite").parquet(f"{root}/rows")
    flagged = cut_lineage(validation_split(spark.read.parquet(f"{root}/rows"), val_fraction, seed))
    train, validation = flagged.filter(~F.col("is_val")), flagged.filter(F.col("is_val"))
    grid, trials, found = trial_grid(parameter_lists(spark, params)), f"{root}/trials", None
    rounds = idle = 0
    while (max_batches is None or rounds < max_batches) and (patience is None or idle < patience):
        done = store.score_lists(spark, trials)
        best = done.agg(F.min("rmse")).first()[0]
        todo = pending_trials(grid, done).orderBy("trial").limit(batch).collect()
        if not todo:
            break
        if found is None:
            found = moments(train, horizon)
        scored = score_all(validation, solve_all(spark, found, [{p: float(t[p]) for p in params} for t in todo]), horizon)
        names = spark.createDataFrame([(i, t["trial"]) for i, t in enumerate(todo)], "i long, trial string")
        new = cut_lineage(names.join(scored, "i").select("trial", F.lit(0).alias("epoch"), "rmse"))
        store.add_score_lists(new, trials)
        rounds += 1
        idle = 0 if best is None or new.agg(F.min("rmse")).first()[0] < best else idle + 1
    return store.score_lists(spark, trials)
