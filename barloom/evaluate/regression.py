"""Pooled predictive regression with Driscoll-Kraay standard errors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .pairs import pair_table
from .places import joined


@dataclass(frozen=True)
class RegressionResult:
    beta: float
    beta_standard_error: float
    t_statistic: float
    p_value: float
    alpha: float
    r_squared: float
    observations: int
    kernel_lags: int
    effective_lags: int = 0


def _whole(value: Any, least: int) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= least


def check_lags(kernel_lags: Any, target_horizon_bars: Any) -> None:
    if kernel_lags is not None and not _whole(kernel_lags, 0):
        raise ValueError("kernel_lags must be an integer >= 0")
    if target_horizon_bars is not None and not _whole(target_horizon_bars, 1):
        raise ValueError("target_horizon_bars must be an integer >= 1")


def default_kernel_lags(n: int, *, target_horizon_bars: int | None = None) -> int:
    """Lags for n times: the usual rule of thumb, and at least the overlap of the targets."""
    if not _whole(n, 1):
        raise ValueError("n must be an integer >= 1")
    check_lags(None, target_horizon_bars)
    return max(1, math.floor(4 * (n / 100) ** (2 / 9)), (target_horizon_bars or 1) - 1)


def symbol_moments(pairs: DataFrame) -> DataFrame:
    """(feature, symbol, _n, _mx, _my, _sx, _vy, _cxy, _most, _least): what the regression needs of each series, from one aggregate."""
    return pairs.groupBy("feature", "symbol").agg(
        F.count("*").alias("_n"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.stddev_samp("x").alias("_sx"), F.coalesce(F.var_samp("y"), F.lit(0.0)).alias("_vy"),
        F.coalesce(F.covar_samp("x", "y"), F.lit(0.0)).alias("_cxy"), F.max("x").alias("_most"), F.min("x").alias("_least"),
    )


def zscored(pairs: DataFrame) -> DataFrame:
    """x in standard deviations of its feature and symbol; rows of constant series go. No symbol's rows meet in one task."""
    of_series = symbol_moments(pairs).filter("_sx > 0").select("feature", "symbol", "_mx", "_sx")
    return joined(pairs, of_series, ["feature", "symbol"]).withColumn("x", (F.col("x") - F.col("_mx")) / F.col("_sx")).select(*pairs.columns)


def pooled_moments(series: DataFrame, standardize: bool) -> DataFrame:
    """(feature, pairs, n, mx, my, vx, vy, cxy, identified) from those of the series.

    A standardised series has mean 0 and deviation 1, so no second pass over the pairs is needed; constant ones take no part.
    """
    n, part = F.col("_n"), F.col("_sx") > 0 if standardize else F.lit(True)
    scale = F.col("_sx") if standardize else F.lit(1.0)
    mx = F.lit(0.0) if standardize else F.col("_mx")
    used = series.withColumns({"_used": F.when(part, n), "_x": F.when(part, mx), "_y": F.when(part, F.col("_my"))})
    means = used.groupBy("feature").agg(
        F.sum("_n").alias("pairs"), F.sum("_used").alias("n"), F.try_divide(F.sum(F.col("_x") * F.col("_used")), F.sum("_used")).alias("mx"),
        F.try_divide(F.sum(F.col("_y") * F.col("_used")), F.sum("_used")).alias("my"),
    )
    dx, dy, free = F.col("_x") - F.col("mx"), F.col("_y") - F.col("my"), F.col("_used") - 1
    own = F.coalesce(F.col("_sx") * F.col("_sx"), F.lit(0.0)) / (scale * scale)
    sums = used.join(means, "feature").groupBy("feature", "pairs", "n", "mx", "my").agg(
        (F.sum(free * own + F.col("_used") * dx * dx) / F.col("n")).alias("vx"), (F.sum(free * F.col("_vy") + F.col("_used") * dy * dy) / F.col("n")).alias("vy"),
        (F.sum(free * F.col("_cxy") / scale + F.col("_used") * dx * dy) / F.col("n")).alias("cxy"),
        (F.max(part & (F.col("_most") > F.col("_least"))) if standardize else F.max("_most") > F.min("_least")).alias("_varies"),
    )
    return sums.withColumn("identified", F.coalesce((F.col("pairs") >= 3) & F.col("_varies"), F.lit(False))).drop("_varies")


def _kernel_sums(scores: DataFrame) -> DataFrame:
    """(feature, s00, s11, s01) by the Bartlett kernel of each feature's ``lag_limit``, from scores (h0, h1) that come sorted by feature and time,
    numbered by ``rn``.

    The kernel's sum is that of the squared moving sums of ``lag_limit`` + 1 scores, with zeros before and after them, over ``lag_limit`` + 1: every
    pair of scores stands together in as many of these windows as its weight says. The last scores are kept from batch to batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, lags, last, tail = None, 0, 0, np.zeros((2, 0))
        found: list[tuple] = []

        def add(scores: np.ndarray, ended: bool) -> np.ndarray:
            """Sums of all windows that end within the new scores, or also after them; the scores that later windows need."""
            nonlocal tail
            new = np.concatenate([tail, scores, np.zeros((2, lags if ended else 0))], 1)
            if new.shape[1] > lags:
                u, v = (np.lib.stride_tricks.sliding_window_view(h, lags + 1).sum(1) for h in new)
                found.append((feature, *(float(s) / (lags + 1) for s in (u @ u, v @ v, u @ v))))
            tail = new[:, new.shape[1] - lags :] if lags else new[:, :0]

        for batch in batches:
            names, limits, places = batch.column(0).to_pylist(), batch.column(1), batch.column(4).to_numpy()
            h = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)])
            marks = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)] if names else []
            for a, b in zip(marks, marks[1:]):
                if places[a] != (last + 1 if names[a] == feature else 1) or (np.diff(places[a:b]) != 1).any():
                    raise RuntimeError("scores came out of order")
                last = places[b - 1]
                if names[a] != feature:
                    if feature is not None:
                        add(np.zeros((2, 0)), True)
                    feature, lags = names[a], limits[a].as_py()
                    tail = np.zeros((2, lags))
                add(h[:, a:b], False)
        if feature is not None:
            add(np.zeros((2, 0)), True)
        columns = list(zip(*found)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.float64()) for c in columns[1:])], ["feature", "s00", "s11", "s01"])

    sums = scores.select("feature", "lag_limit", "h0", "h1", "rn").mapInArrow(run, "feature string, s00 double, s11 double, s01 double")
    return sums.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("s00", "s11", "s01")))


def regression_table(pairs: DataFrame, kernel_lags: int | None = None, target_horizon_bars: int | None = None, standardize: bool = True) -> DataFrame:
    """(feature, pairs, n, t, identified, alpha, beta, variance, r_squared, lags, effective_lags), all features at once.

    variance is that of beta by the Bartlett kernel over the scores summed per time. Features with too few
    pairs or one predictor value have null results. The pairs are read twice: for the moments of each series, and for the scores.
    """
    check_lags(kernel_lags, target_horizon_bars)
    series = stored(symbol_moments(pairs), "series")  # a row a series, needed three times
    line = (
        pooled_moments(series, standardize).withColumn("beta", F.when(F.col("identified"), F.try_divide("cxy", "vx")))
        .withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx"))
    )
    # the line in terms of x as it is, for each series
    scale, shift = (F.col("_sx"), F.col("_mx")) if standardize else (F.lit(1.0), F.lit(0.0))
    of_series = series.join(line.filter("identified"), "feature").filter(F.col("_sx") > 0 if standardize else F.lit(True)).select(
        "feature", "symbol", "alpha", "beta", shift.alias("_shift"), scale.alias("_scale")
    )
    x = (F.col("x") - F.col("_shift")) / F.col("_scale")
    residual = F.col("y") - F.col("alpha") - F.col("beta") * x
    scores = joined(pairs, of_series, ["feature", "symbol"]).groupBy("feature", "timestamp").agg(F.sum(residual).alias("h0"), F.sum(x * residual).alias("h1"))
    by_time = Window.partitionBy("feature").orderBy("timestamp")
    t = F.count("*").over(Window.partitionBy("feature"))
    rule = F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("t") / 100, F.lit(2 / 9))).cast("int"), F.lit((target_horizon_bars or 1) - 1))
    timed = scores.withColumn("t", t).withColumn("lags", rule if kernel_lags is None else F.lit(kernel_lags))
    timed = timed.withColumn("lag_limit", F.least(F.col("lags"), F.col("t") - 1).cast("int")).withColumn("rn", F.row_number().over(by_time))
    times = timed.filter("rn = 1").select("feature", "t", "lags", F.col("lag_limit").alias("effective_lags"))
    kernel = _kernel_sums(timed)
    n, sx = F.col("n"), F.col("n") * F.col("mx")
    bread = n * n * F.col("vx")
    variance = F.try_divide(sx * sx * F.col("s00") - 2 * sx * n * F.col("s01") + n * n * F.col("s11"), bread * bread)
    # with an intercept this is the squared correlation: no pass over the residuals
    r_squared = F.when(F.col("identified") & (F.col("vy") > 0), F.try_divide(F.col("cxy") * F.col("cxy"), F.col("vx") * F.col("vy")))
    return line.join(kernel, "feature", "left").join(times, "feature", "left").select(
        "feature", "pairs", F.when(F.col("identified"), n).alias("n"), "t", "identified", "alpha", "beta", variance.alias("variance"),
        r_squared.alias("r_squared"), "lags", "effective_lags",
    )


def p_value(t: float | None) -> float | None:
    """Two-sided, by the normal approximation."""
    return None if t is None else math.erfc(abs(t) / math.sqrt(2))


def newey_west_regression(df: DataFrame, feature: str, target: str, *, kernel_lags: int | None = None, target_horizon_bars: int | None = None,
                          standardize: bool = True) -> RegressionResult:
    """Regress the target on one feature; a zero standard error gives no t and no p instead of an error."""
    check_lags(kernel_lags, target_horizon_bars)
    row = regression_table(pair_table(df, [feature], target), kernel_lags, target_horizon_bars, standardize).first()
    if row is None or row["pairs"] < 3:
        raise ValueError(f"regression of {target!r} on {feature!r} needs at least 3 paired observations, got {row['pairs'] if row else 0}")
    if not row["identified"]:
        raise ValueError(f"feature {feature!r} has no variation after standardization; its slope is not identified")
    error = math.sqrt(max(row["variance"], 0.0))
    t = row["beta"] / error if error else math.nan
    return RegressionResult(
        row["beta"], error, t, math.nan if math.isnan(t) else p_value(t), row["alpha"],
        math.nan if row["r_squared"] is None else row["r_squared"], row["n"], row["lags"], row["effective_lags"],
    )
