"""One table that ranks features by their evidence."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import IDS
from ..shared import stored
from .buckets import bucketed, check_quantiles, quantile_spread
from .ic import time_series_table
from .pairs import need_columns, pair_table
from .regression import check_lags, p_value, regression_table


def default_features(df: DataFrame, target: str) -> list[str]:
    """All numeric and boolean columns but the ids and the target; other targets are among them."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in (*IDS, target)]
    ahead = [n for n in names if n.startswith(("next_", "fwd_"))]
    if ahead:
        warnings.warn(f"evaluating forward targets as features: {ahead}", stacklevel=3)
    return names


def evaluate_features(df: DataFrame, target: str, features: list[str] | None = None, target_horizon_bars: int | None = None, quantiles: int = 5) -> DataFrame:
    """(feature, mean_time_series_ic, beta, t_statistic, p_value, r_squared, observations, quantile_spread), strongest |t| first.

    All features go through one long table, written to the shared folder, and three grouped computations. What cannot be tested has nulls and 0 observations.
    """
    need_columns(df, "symbol", "timestamp", target)
    check_lags(None, target_horizon_bars)
    check_quantiles(quantiles)
    names = default_features(df, target) if features is None else list(features)
    if not names:
        raise ValueError("No feature columns to evaluate")
    pairs = stored(pair_table(df, names, target), "pairs")
    ics = time_series_table(pairs).groupBy("feature").agg(F.avg("ic").alias("mean_time_series_ic"))
    lines = regression_table(pairs, None, target_horizon_bars)
    spreads = quantile_spread(bucketed(pairs, quantiles), ["feature"])
    order = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, position int")
    t = F.when(F.col("variance") > 0, F.try_divide(F.col("beta"), F.sqrt("variance")))
    p = F.pandas_udf(lambda ts: ts.map(p_value, na_action="ignore"), "double")  # Spark has no erf
    out = order.join(ics, "feature", "left").join(lines, "feature", "left").join(spreads, "feature", "left")
    return (
        out.withColumn("t_statistic", t)
        .select(
            "feature", "mean_time_series_ic", "beta", "t_statistic", p("t_statistic").alias("p_value"), F.when(F.col("identified"), F.col("r_squared")).alias("r_squared"),
            F.coalesce("n", F.lit(0)).alias("observations"), "quantile_spread", "position",
        )
        .orderBy(F.abs("t_statistic").desc_nulls_last(), "position").drop("position")
    )
