"""Quantile buckets of a feature and the target within them."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import has_long_groups
from .pairs import pair_table
from .places import TASK_ROWS, joined, percentiles


def check_quantiles(quantiles: int) -> None:
    if not isinstance(quantiles, int) or isinstance(quantiles, bool) or quantiles < 2:
        raise ValueError("quantiles must be an integer >= 2")


def percentile_table(rows: DataFrame, keys: list[str], value: str, shares: list[float], **more: Column) -> DataFrame:
    """(keys..., more..., p): exact percentiles of each group, by linear interpolation between the sorted values, and other aggregates.

    A percentile aggregate holds a group's values in memory; here equal values are counted first and only places of counts are sorted,
    over ranges of values where a group has more than ``WINDOW_ROWS`` rows.
    """
    known = rows.filter(F.col(value).isNotNull())
    found = percentiles(known, keys, value, shares, has_long_groups(known, keys, WINDOW_ROWS))
    return joined(rows.groupBy(*keys).agg(*(c.alias(n) for n, c in more.items())), found, keys) if more else found


#: Rows of a group whose counted values one task sorts.
WINDOW_ROWS = TASK_ROWS


def edge_table(pairs: DataFrame, keys: list[str], quantiles: int, long: bool | None = None) -> DataFrame:
    """(keys..., edges): inner quantile edges by linear interpolation between the sorted values."""
    shares = [i / quantiles for i in range(1, quantiles)]
    if long is None:
        long = has_long_groups(pairs, keys, WINDOW_ROWS)
    if long or "symbol" not in keys:
        return percentiles(pairs, keys, "x", shares, long).withColumnRenamed("p", "edges")
    place = Window.partitionBy(*keys).orderBy("x")
    ranked = pairs.select(*keys, "x", F.row_number().over(place).alias("rn"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    edges = []
    for share in shares:
        at = (F.col("n") - 1) * F.lit(share)
        low, high = (F.max(F.when(F.col("rn") == f(at) + 1, F.col("x"))) for f in (F.floor, F.ceil))
        part = F.max(at - F.floor(at))
        edges.append(low + (high - low) * part)
    return ranked.groupBy(*keys).agg(F.array(*edges).alias("edges"))


def bucketed(pairs: DataFrame, quantiles: int, by_symbol: bool = True) -> DataFrame:
    """``pairs`` with quantile, 1 to ``quantiles``; null in groups whose values fill fewer buckets."""
    check_quantiles(quantiles)
    keys = ["feature", "symbol"] if by_symbol else ["feature"]
    number = 1 + F.size(F.filter("edges", lambda e: F.col("x") > e))
    long = has_long_groups(pairs, keys, WINDOW_ROWS)
    placed = joined(pairs, edge_table(pairs, keys, quantiles, long), keys).withColumn("_bucket", number).drop("edges")
    if by_symbol and not long:
        marked = placed.withColumn("_filled", F.size(F.collect_set("_bucket").over(Window.partitionBy(*keys))))
    else:
        marked = joined(placed, placed.groupBy(*keys).agg(F.count_distinct("_bucket").alias("_filled")), keys)
    return marked.select(*pairs.columns, F.when(F.col("_filled") == quantiles, F.col("_bucket")).alias("quantile"))


def bucket_summary(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Target statistics of each bucket."""
    by = [*(keys or []), "quantile"]
    found = percentile_table(
        rows.filter("quantile is not null"), by, "y", [0.1, 0.5, 0.9], observations=F.count("*"), mean=F.avg("y"), standard_deviation=F.stddev_samp("y"),
        feature_min=F.min("x"), feature_max=F.max("x"),
    )
    p = F.col("p")
    return found.select(
        *by, "observations", "mean", p[1].alias("median"), "standard_deviation", p[0].alias("percentile_10"), p[2].alias("percentile_90"), "feature_min", "feature_max"
    )


def _warn_excluded(rows: DataFrame, feature: str, quantiles: int, by_symbol: bool) -> None:
    names = [r["symbol"] for r in rows.filter("quantile is null").select("symbol").distinct().orderBy("symbol").limit(21).collect()]
    if names and by_symbol:
        shown = ", ".join(map(str, names[:20])) + (", ..." if len(names) > 20 else "")
        warnings.warn(f"feature {feature!r}: symbols with too many repeated values for {quantiles} buckets were left out: {shown}", stacklevel=3)
    elif names:
        warnings.warn(f"feature {feature!r} has too many repeated values for {quantiles} buckets", stacklevel=3)


def target_by_feature_quantile(df: DataFrame, feature: str, target: str, quantiles: int = 5, by_symbol: bool = True) -> DataFrame:
    """Target statistics per bucket, lowest bucket first; a ValueError if no two buckets can be formed."""
    check_quantiles(quantiles)
    rows = bucketed(pair_table(df, [feature], target), quantiles, by_symbol)
    _warn_excluded(rows, feature, quantiles, by_symbol)
    out = bucket_summary(rows).orderBy("quantile")
    if len(out.select("quantile").take(2)) < 2:
        raise ValueError(f"No rows have both {feature!r} and {target!r} in at least two buckets")
    return out


def target_values_by_quantile(df: DataFrame, feature: str, target: str, quantiles: int = 5, by_symbol: bool = True) -> DataFrame:
    """(quantile, value): the target values of each bucket in long form; empty if every symbol is left out."""
    rows = bucketed(pair_table(df, [feature], target), quantiles, by_symbol)
    _warn_excluded(rows, feature, quantiles, by_symbol)
    return rows.filter("quantile is not null").select("quantile", F.col("y").alias("value"))


def quantile_spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., quantile_spread): mean of the top bucket minus that of the bottom one."""
    means = rows.filter("quantile is not null").groupBy(*keys, "quantile").agg(F.avg("y").alias("mean"))
    return means.groupBy(*keys).agg(
        F.when(F.count("*") >= 2, F.max_by("mean", "quantile") - F.min_by("mean", "quantile")).alias("quantile_spread")
    )
