"""Robust local linear regression of pixel series.

Spark brings each series into one row and spreads the rows over the tasks; the
fit itself is a short numpy helper fed with Arrow batches.  As DataFrame
built-ins the same fit needs ``frames * neighbours`` rows per series and pass
(measured: 17 times slower), see README.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import PIXEL

# Fixed values of the published method: robustifying passes, residual scale, cut-offs.
PASSES = 3
MEDIANS = 6.0
NEAR, FAR = 0.001, 0.999


def loess_udf(frac: float, passes: int = PASSES):
    """``array<double> -> array<double>``: smoothed series on equally spaced frames.

    Each point is fitted from its ``int(frac * n)`` nearest frames with tricube
    weights; ``passes`` refits use bisquare weights of the residuals.  A series
    that is NULL or has gaps comes back as NULL.
    """

    # Nested, so that workers need numpy and pandas only, not this package.
    def smooth(series):
        import numpy as np
        import pandas as pd

        def neighbourhoods(n):
            """Per point: its neighbours, their distances and their tricube weights."""
            k = int(frac * n + 1e-10)
            if k < 2:
                raise ValueError(f"frac={frac} spans fewer than 2 of {n} frames")
            i = np.arange(n)
            left = np.clip(np.ceil(i - k / 2).astype(int), 0, n - k)
            near = left[:, None] + np.arange(k)
            dx = (near - i[:, None]).astype(float)
            reach = np.maximum(i - left, left + k - 1 - i)[:, None]
            share = np.abs(dx) / reach
            return near, dx, np.where(share >= FAR, 0.0, np.where(share <= NEAR, 1.0, (1 - share**3) ** 3))

        def moments(near, dx, tricube):
            """Per run of 64 points: the frames they use and matrices for the weighted sums of ``dx^p``."""
            runs = []
            for lo in range(0, len(near), 64):
                at = slice(lo, lo + 64)
                used = slice(near[at].min(), near[at].max() + 1)
                sums = np.zeros((3, len(near[at]), used.stop - used.start))
                for power in range(3):
                    np.put_along_axis(sums[power], near[at] - used.start, tricube[at] * dx[at] ** power, axis=1)
                runs.append((at, used, [m.T.copy() for m in sums]))
            return runs

        def weighted(values, power, runs):
            out = np.empty_like(values)
            for at, used, sums in runs:
                out[:, at] = values[:, used] @ sums[power]
            return out

        def fit(y, near, dx, tricube, runs):
            trust = np.ones_like(y)
            for done in range(passes + 1):
                w0, w1, w2 = (weighted(trust, power, runs) for power in (0, 1, 2))
                wy, wxy = (weighted(trust * y, power, runs) for power in (0, 1))
                ok = w0 > 0
                total = np.where(ok, w0, 1.0)
                centre, level = w1 / total, wy / total
                spread = w2 / total - centre * centre
                slope = (wxy / total - centre * level) / np.where(spread > 0, spread, 1.0)
                fitted = np.where(ok, level - centre * slope, y)
                # next to no weight off one point: sums cancel, so these few are fitted term by term
                row, at = np.nonzero(ok & (spread < 1e-2))
                if len(row):
                    w = tricube[at] * trust[row[:, None], near[at]]
                    w /= w.sum(axis=1, keepdims=True)
                    off = dx[at] - (w * dx[at]).sum(axis=1, keepdims=True)
                    tilt = off[:, :1] - dx[at][:, :1]  # minus the weighted centre
                    gain = 1 + tilt * off / np.maximum((w * off * off).sum(axis=1, keepdims=True), 1e-12)
                    fitted[row, at] = (w * gain * y[row[:, None], near[at]]).sum(axis=1)
                if done < passes:
                    miss = np.abs(y - fitted)
                    median = np.median(miss, axis=1, keepdims=True)
                    u = np.where(median > 0, miss / np.where(median > 0, MEDIANS * median, 1.0), (miss > 0) * 1.0)
                    u = np.where(u >= FAR, 1.0, np.where(u <= NEAR, 0.0, u))
                    trust = (1 - u * u) ** 2
            return fitted

        values = [None if s is None else np.asarray(s, dtype=float) for s in series]
        out = [None] * len(values)
        by_length: dict[int, list[int]] = {}
        for at, y in enumerate(values):
            if y is not None and len(y) and not np.isnan(y).any():
                by_length.setdefault(len(y), []).append(at)
        for n, where in by_length.items():
            hood = neighbourhoods(n)
            runs = moments(*hood)
            for lo in range(0, len(where), 256):
                block = where[lo : lo + 256]
                for at, fitted in zip(block, fit(np.stack([values[a] for a in block]), *hood, runs)):
                    out[at] = fitted
        return pd.Series(out, dtype=object)

    return F.pandas_udf(smooth, "array<double>")


def smooth_series(df: DataFrame, bands: Sequence[str], frac: float, passes: int = PASSES, keys: Sequence[str] = PIXEL, usable: str | None = None) -> DataFrame:
    """Replace ``bands`` of every pixel by their smoothed values; expects dense, filled frames.

    With ``usable`` only pixels whose flag is 1 are smoothed, the others keep
    their values.  All columns and rows are kept.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", *[c for c in rest if c != "t"]))).alias("rows"))
    udf = loess_udf(frac, passes)
    wanted = F.lit(True) if usable is None else F.col("rows")[0][usable] == 1
    smoothed = packed.select(*keys, "rows", *[udf(F.when(wanted, F.col(f"rows.{b}"))).alias(f"__{i}") for i, b in enumerate(bands)])
    rows = smoothed.select(*keys, *[f"__{i}" for i in range(len(bands))], F.posexplode("rows").alias("__i", "row"))
    new = {b: F.coalesce(F.get(f"__{i}", F.col("__i")), F.col(f"row.{b}")) for i, b in enumerate(bands)}
    return rows.select(*keys, *[new[c].alias(c) if c in new else F.col(f"row.{c}") for c in rest])
