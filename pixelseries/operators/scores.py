"""Baselines, errors and reports of forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import forecast_date, in_bbox, in_time_range, seeded_order
from .series import PIXEL
from .topk import first_n, one_per_key


def _baseline_report(per_sample: DataFrame) -> DataFrame:
    mean, last = F.avg("se_mean"), F.avg("se_last")
    return per_sample.agg(
        F.count("*").alias("n_samples"),
        mean.alias("mse_mean"),
        F.sqrt(mean).alias("rmse_mean"),
        last.alias("mse_persistence"),
        F.sqrt(last).alias("rmse_persistence"),
    )


def baseline_errors(samples: DataFrame, band: str, keys: Sequence[str]) -> DataFrame:
    """Per packed sample: squared error of the context mean and of the last context value."""
    context, target = F.col(f"context.{band}"), F.col(f"target.{band}")

    def mse(guess: Column) -> Column:
        total = F.aggregate(target, F.lit(0.0), lambda a, v: a + (v - guess) * (v - guess))
        return total / F.size(target)

    mean = F.aggregate(context, F.lit(0.0), lambda a, v: a + v) / F.size(context)
    with_guess = samples.withColumns({"__mean": mean, "__last": F.element_at(context, -1)})
    return with_guess.select(*keys, mse(F.col("__mean")).alias("se_mean"), mse(F.col("__last")).alias("se_last"))


def baseline_scores(samples: DataFrame, band: str) -> DataFrame:
    """MSE and RMSE of the mean and the persistence forecast: averaged per sample, then over samples."""
    return _baseline_report(baseline_errors(samples, band, []))


def sliding_baseline_scores(series: DataFrame, value: str, context: int, target: int, shift: int = 0, stride: int = 1, keys: Sequence[str] = PIXEL) -> DataFrame:
    """Same scores for all sliding windows of dense, filled series, without building the windows.

    Running sums of ``v`` and ``v^2`` give every window's moments from four
    rows, so the work is per frame and not per frame and window. Values count from
    the mean of their series, which leaves the errors as they are and keeps the sums
    of squares from cancelling.
    """
    order = Window.partitionBy(*keys).orderBy("t")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    series = series.withColumn("__centred", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    v = F.col("__centred")
    sums = series.select(*keys, "t", v.alias("__v"), F.sum(v).over(upto).alias("__s"), F.sum(v * v).over(upto).alias("__q"), F.max("t").over(Window.partitionBy(*keys)).alias("__end"))

    def between(c: str, first: int, last: int) -> Column:
        before = F.coalesce(F.lag(c, 1).over(order), F.lit(0.0)) if first == 0 else F.lead(c, first - 1).over(order)
        return F.lead(c, last).over(order) - before

    windows = sums.select(
        "t",
        "__end",
        (between("__s", 0, context - 1) / context).alias("mean"),
        F.lead("__v", context - 1).over(order).alias("last"),
        between("__s", context, context + target - 1).alias("s"),
        between("__q", context, context + target - 1).alias("q"),
    ).filter((F.col("t") + (context + target - 1 + shift) <= F.col("__end")) & (F.col("t") % stride == 0))

    def mse(guess: str) -> Column:
        g = F.col(guess)
        return F.greatest((F.col("q") - 2 * g * F.col("s") + target * g * g) / target, F.lit(0.0))

    return _baseline_report(windows.select(mse("mean").alias("se_mean"), mse("last").alias("se_last")))


def _squared_error(pred: str, truth: str) -> Column:
    return (F.col(pred) - F.col(truth)) * (F.col(pred) - F.col(truth))


def sample_errors(pairs: DataFrame, sample: Sequence[str] = ("sample_id",), pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Per sample: number of steps, sum of squared errors, MSE and RMSE."""
    sse = F.sum(_squared_error(pred, truth))
    n = F.count(_squared_error(pred, truth))
    return pairs.groupBy(*sample).agg(n.alias("n_steps"), sse.alias("sse"), (sse / n).alias("mse"), F.sqrt(sse / n).alias("rmse"))


def l2_loss(pairs: DataFrame, sample: Sequence[str] = ("sample_id",), pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Mean over the steps of a sample, then over samples."""
    return sample_errors(pairs, sample, pred, truth).agg(F.avg("mse").alias("l2"))


LOSSES = {"l2": l2_loss}


def loss(name: str):
    """Loss by name."""
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; have {', '.join(sorted(LOSSES))}")
    return LOSSES[name]


def rmse(pairs: DataFrame, by: Sequence[str] = (), pred: str = "pred", truth: str = "truth", compat_batch: int | None = None, sample: str = "sample_id") -> DataFrame:
    """Root of the mean squared error; sum and count merge across tasks.

    ``compat_batch`` divides by time steps per batch of that many samples, as
    if a batch were one observation per step.
    """
    sse = F.sum(_squared_error(pred, truth))
    if compat_batch is None:
        return pairs.groupBy(*by).agg(F.sqrt(sse / F.count(_squared_error(pred, truth))).alias("rmse"))
    per_sample = sample_errors(pairs, [*by, sample], pred, truth)
    batches = F.ceil(F.count("*") / compat_batch)
    return per_sample.groupBy(*by).agg(F.sqrt(F.sum("sse") / (F.max("n_steps") * batches)).alias("rmse"))


def metric_states(pairs: DataFrame, by: Sequence[str] = ("run", "track"), pred: str = "pred", truth: str = "truth") -> DataFrame:
    """``by..., sse, n``: what the error of any union of these pairs can be told from.

    Pairs with a missing side count nowhere; a group of such pairs has ``n`` 0.
    """
    error = _squared_error(pred, truth)
    return pairs.groupBy(*by).agg(F.coalesce(F.sum(error), F.lit(0.0)).alias("sse"), F.count(error).alias("n"))


def merged_rmse(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., n, rmse`` of stored states, without a look at the predictions; NULL where there is no pair."""
    return states.groupBy(*by).agg(F.sum("n").alias("n"), F.sqrt(F.try_divide(F.sum("sse"), F.sum("n"))).alias("rmse"))


def merge_scores(parts: DataFrame, sample: str = "sample_id") -> DataFrame:
    """One row per sample from the scores of several workers: of several, the one with the smallest values."""
    return one_per_key(parts, [sample])


def prediction_report(
    samples: DataFrame,
    predictions: DataFrame,
    band: str,
    key: str = "sample_id",
    bbox=None,
    time_range=None,
    limit: int | None = None,
    seed: int = 0,
    cadence_days: int = 5,
) -> DataFrame:
    """Prediction, truth and context mean per sample and step.

    ``samples`` carries ``key, start, end, lon, lat, context, target``;
    ``limit`` is a random preview of that many samples.
    """
    context = F.col(f"context.{band}")
    mean = F.aggregate(context, F.lit(0.0), lambda a, v: a + v) / F.size(context)
    chosen = samples.filter(in_bbox("lon", "lat", bbox) & in_time_range("start", "end", time_range))
    if limit is not None:
        picked = first_n(chosen.select(key).join(predictions.select(key).distinct(), key, "left_semi"), [seeded_order(seed, key), F.col(key)], limit)
        chosen = chosen.join(picked, key, "left_semi")
    truth = chosen.select(key, "start", "lon", "lat", mean.alias("context_mean"), F.posexplode(f"target.{band}").alias("step", "truth"))
    return (
        truth.join(predictions.select(key, "step", "pred"), [key, "step"])
        .select(key, "lon", "lat", "step", forecast_date("start", "step", cadence_days).alias("date"), "pred", "truth", "context_mean")
    )
