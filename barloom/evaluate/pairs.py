"""Feature and target side by side, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import finite


def need_columns(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise KeyError(f"Column {name!r} not found in the feature frame")


def pair_table(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, symbol, timestamp, x, y): rows where both values are finite numbers, for all features from one scan."""
    need_columns(df, "symbol", "timestamp", target, *features)
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), finite(F.col(f)).alias("x")) for f in features))
    rows = df.select("symbol", "timestamp", finite(F.col(target)).alias("y"), F.inline(cells)).select("feature", "symbol", "timestamp", "x", "y")
    return rows.filter("x is not null and y is not null")


def correlation(x: str = "x", y: str = "y") -> Column:
    """Pearson correlation, null for constant columns and single rows (Spark's corr throws on constants)."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
