"""Multi-step forecasts: a context in, all target steps out, each step with coefficients of its own.

The model is linear with a ridge or elastic-net penalty. All it needs from the
training rows are their moments, which one pass sums up: every step and every
setting of a grid search is solved from the same moments. These have one row and
column per feature, so their size depends on the sample's shape and not on the
number of samples.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: More features than this would not fit the driver as a square matrix of moments.
MAX_FEATURES = 8192
#: Rows that a task multiplies at once.
ROWS = 1000


def _ends(stats: DataFrame | None, bands: Sequence[str]) -> dict[str, tuple[Column, Column]]:
    """Minimum and maximum of each band: two numbers per band, as literals."""
    if stats is None:
        return {}
    found = stats.filter(F.col("band").isin(list(bands))).groupBy("band").agg(F.min("min").cast("double"), F.max("max").cast("double")).collect()
    if missing := set(bands) - {band for band, _, _ in found}:
        raise ValueError(f"no statistics for {', '.join(sorted(missing))}")
    return {band: (F.lit(low), F.lit(high)) for band, low, high in found}


def context_features(samples: DataFrame, bands: Sequence[str], static: Sequence[str] = (), stats: DataFrame | None = None, out: str = "features") -> DataFrame:
    """All frame bands of all context frames, then the static bands, as one array.

    With ``stats`` (``band, min, max`` of the training scenes) values are scaled to
    0..1. A missing frame value takes the mean of its band's known frames in the
    sample; a band without any, and a missing static value, take the middle of the
    scale (0.5) or, unscaled, 0.
    """
    ends, neutral = _ends(stats, [*bands, *static]), F.lit(0.0 if stats is None else 0.5)

    def scaled(v: Column, b: str) -> Column:
        return v if b not in ends else F.try_divide(v - ends[b][0], ends[b][1] - ends[b][0])

    def frames(b: str) -> Column:
        values = F.transform(F.col(f"context.{b}").cast("array<double>"), lambda v: scaled(v, b))
        sums = F.aggregate(
            values,
            F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
            lambda a, v: F.when(v.isNull(), a).otherwise(F.struct((a["s"] + v).alias("s"), (a["n"] + 1).alias("n"))),
        )
        mean = F.coalesce(F.try_divide(sums["s"], sums["n"]), neutral)
        return F.zip_with(values, F.array_repeat(mean, F.size(values)), lambda v, m: F.coalesce(v, m))

    layers = F.array(*[F.coalesce(scaled(F.col(b).cast("double"), b), neutral) for b in static]).cast("array<double>")
    return samples.withColumn(out, F.flatten(F.array(*[frames(b) for b in bands], layers)))


def training_rows(samples: DataFrame, bands: Sequence[str], target_band: str, keys: Sequence[str] = ("sample_id",), static: Sequence[str] = (), stats: DataFrame | None = None) -> DataFrame:
    """One row per sample: ``features`` and the ``truth`` array; samples with a missing target are left out."""
    truth = F.col(f"target.{target_band}").cast("array<double>")
    rows = context_features(samples, bands, static, stats).select(*keys, "features", truth.alias("truth"))
    return rows.filter(F.forall("truth", lambda v: v.isNotNull()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != width * len(column):
        raise ValueError(f"every sample needs {width} values")
    return flat.reshape(len(column), width)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


@dataclass(frozen=True)
class Moments:
    """``n`` rows: means of features and targets, and their centred products per row."""

    n: int
    x_mean: np.ndarray
    y_mean: np.ndarray
    xx: np.ndarray
    xy: np.ndarray

    def solve(self, reg_param: float = 0.01, elastic_net: float = 0.0, sweeps: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients (features by steps) and intercepts.

        Half the mean squared error plus ``reg_param`` times the mix of absolute
        (share ``elastic_net``) and half squared coefficients is least.
        """
        lasso, ridge = reg_param * elastic_net, reg_param * (1 - elastic_net)
        if lasso == 0:
            b = np.linalg.lstsq(self.xx + ridge * np.eye(len(self.xx)), self.xy, rcond=None)[0]
        else:
            b = np.zeros_like(self.xy)
            for _ in range(sweeps):
                moved = 0.0
                for j in range(len(b)):
                    rest = self.xy[j] - self.xx[j] @ b + self.xx[j, j] * b[j]
                    new = np.sign(rest) * np.maximum(np.abs(rest) - lasso, 0) / max(self.xx[j, j] + ridge, 1e-300)
                    moved = max(moved, float(np.abs(new - b[j]).max()))
                    b[j] = new
                if moved < 1e-10:
                    break
        return b, self.y_mean - self.x_mean @ b


def moments(rows: DataFrame, horizon: int) -> Moments:
    """Two passes over ``rows``: means, then products about them; tasks send sums, never rows.

    ``rows`` are read three times: give rows that are written, not a long plan.
    """
    first = rows.select(F.size("features")).first()
    if first is None:
        raise ValueError("no training samples")
    p = first[0]
    if p > MAX_FEATURES:
        raise ValueError(f"{p} features; at most {MAX_FEATURES} are possible")
    rows = rows.select("features", "truth")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p + horizon + 1)  # the last one counts rows
        for part in _parts(batches):
            total[:p] += _matrix(part.column("features"), p).sum(axis=0)
            total[p:-1] += _matrix(part.column("truth"), horizon).sum(axis=0)
            total[-1] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    found = rows.mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    *totals, n = found.orderBy("i").toArrow().column("v").to_numpy()
    n = int(n)
    means = np.array(totals) / n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p + horizon))
        for part in _parts(batches):
            both = np.concatenate([_matrix(part.column("features"), p), _matrix(part.column("truth"), horizon)], axis=1) - means
            total += both[:, :p].T @ both
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p)), _lists(total)], names=["i", "line"])

    def added(table: pa.Table) -> pa.Table:
        lines = _matrix(table.column("line").combine_chunks(), p + horizon)
        return pa.table({"i": table.column("i").slice(0, 1), "line": _lists(lines.sum(axis=0, keepdims=True))})

    lines = rows.mapInArrow(products, "i long, line array<double>").groupBy("i").applyInArrow(added, "i long, line array<double>")
    every = _matrix(lines.orderBy("i").toArrow().column("line").combine_chunks(), p + horizon) / n
    return Moments(n, means[:p], means[p:], every[:, :p], every[:, p:])


@dataclass(frozen=True)
class Forecaster:
    coefficients: np.ndarray
    intercepts: np.ndarray

    def predict(self, rows: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
        """``(keys..., step, pred)``, and ``truth`` where the rows carry it."""
        b, a = self.coefficients, self.intercepts
        known = ["truth"] if "truth" in rows.columns else []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                guess = _matrix(part.column("features"), len(b)) @ b + a
                kept = [part.column(c) for c in [*keys, *known]]
                yield pa.RecordBatch.from_arrays([*kept, _lists(guess)], names=[*keys, *known, "guess"])

        source = rows.select(*keys, *known, "features")
        found = source.mapInArrow(run, source.drop("features").withColumn("guess", F.array(F.lit(0.0))).schema)
        pairs = F.arrays_zip(F.col("guess").alias("pred"), *[F.col(c) for c in known])
        return found.select(*keys, F.posexplode(pairs).alias("step", "pair")).select(*keys, "step", "pair.*")


def fit_forecaster(rows: DataFrame, horizon: int, **setting: float) -> Forecaster:
    return Forecaster(*moments(rows, horizon).solve(**setting))


def score_track(
    model: Forecaster, samples: DataFrame, bands: Sequence[str], target_band: str, track: str, keys: Sequence[str] = ("sample_id",), static: Sequence[str] = (), stats: DataFrame | None = None
) -> DataFrame:
    """Predictions for one test track; the track is a value of ``split``."""
    return model.predict(training_rows(samples.filter(F.col("split") == track), bands, target_band, keys, static, stats), keys)


def solve_all(spark: SparkSession, found: Moments, settings: Sequence[Mapping[str, float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Coefficients and intercepts of every setting, each solved by a task of its own.

    The moments go to the tasks once: their size is the square of the features, which
    are bounded, whatever the number of samples. What comes back is the models.
    """
    sent, width = spark.sparkContext.broadcast(found), found.xy.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, setting in zip(batch.column("i").to_pylist(), batch.column("setting").to_pylist()):
                b, a = sent.value.solve(**json.loads(setting))
                yield pa.RecordBatch.from_arrays([pa.array([i]), _lists(b.reshape(1, -1)), _lists(a.reshape(1, -1))], names=["i", "b", "a"])

    listed = spark.createDataFrame([(i, json.dumps(dict(s))) for i, s in enumerate(settings)], "i long, setting string")
    solved = listed.repartitionByRange(len(settings), "i").mapInArrow(run, "i long, b array<double>, a array<double>").orderBy("i").toArrow()
    return [(np.array(b).reshape(-1, width), np.array(a)) for b, a in zip(solved.column("b").to_pylist(), solved.column("a").to_pylist())]


def score_all(validation: DataFrame, models: Sequence[tuple[np.ndarray, np.ndarray]], horizon: int) -> DataFrame:
    """``i, rmse`` of every model from one pass over the validation rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors, n = np.zeros(len(models)), 0
        for part in _parts(batches):
            truth = _matrix(part.column("truth"), horizon)
            x = _matrix(part.column("features"), len(models[0][0]))
            errors += [float(((x @ b + a - truth) ** 2).sum()) for b, a in models]
            n += truth.size
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models))), pa.array(errors), pa.array([n] * len(models))], names=["i", "sse", "n"])

    return validation.select("features", "truth").mapInArrow(run, "i long, sse double, n long").groupBy("i").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"))


def grid_search(train: DataFrame, validation: DataFrame, horizon: int, params: Mapping[str, Sequence[float]]) -> DataFrame:
    """Validation RMSE of every parameter combination: ``(trial, <params>, rmse)``.

    The moments of the training rows give all models, and one pass over the
    validation rows scores them all.
    """
    settings = [dict(zip(params, values)) for values in product(*params.values())]
    scored = score_all(validation, solve_all(train.sparkSession, moments(train, horizon), settings), horizon)
    names = ["config_" + "_".join(f"({k}={v})" for k, v in s.items()) for s in settings]
    listed = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(t).alias("trial"), *[F.lit(v).alias(k) for k, v in s.items()]) for i, (t, s) in enumerate(zip(names, settings))])
    table = train.sparkSession.range(1).select(F.inline(listed))
    return table.join(scored, "i").select("trial", *params, "rmse")
