"""Ranks and percentiles of groups of any size, from their different values, how often each comes and how many rows lie below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import has_long_groups, placed

#: Rows of a group that one task sorts; where a group has more, values are dealt and sorted by ranges.
TASK_ROWS = 1 << 20


def value_places(rows: DataFrame, groups: list[str], value: str, long: bool) -> DataFrame:
    """(groups..., value, _c, _place, _count): the different values, rows that have each, rows below it and rows of its group."""
    counted = rows.groupBy(*groups, value).agg(F.count("*").alias("_c"))
    if long:
        return placed(counted, groups, [value], "values", "_c")
    own = Window.partitionBy(*groups)
    below = F.sum("_c").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return counted.select("*", F.coalesce(below, F.lit(0)).alias("_place"), F.sum("_c").over(own).alias("_count"))


def joined(rows: DataFrame, others: DataFrame, groups: list[str], *more: str) -> DataFrame:
    """Rows with the columns of the others that agree in the groups, null among them, and in ``more``."""
    keys = [*groups, *more]
    named = others.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_on_{k}")) if k in groups else F.col(k) == F.col(f"_on_{k}")
    return rows.join(named, same).drop(*(f"_on_{k}" for k in keys))


def average_ranks(pairs: DataFrame, groups: list[str], *columns: str) -> DataFrame:
    """The pairs with the columns ranked within their groups; equal values share the mean of their places."""
    if not has_long_groups(pairs, groups, TASK_ROWS):
        def rank(c: str) -> Column:
            return F.rank().over(Window.partitionBy(*groups).orderBy(c)) + (F.count("*").over(Window.partitionBy(*groups, c)) - 1) / 2

        return pairs.withColumns({f"_r_{c}": rank(c) for c in columns}).drop(*columns).withColumnsRenamed({f"_r_{c}": c for c in columns})
    for c in columns:
        ranks = value_places(pairs, groups, c, True).select(*groups, c, (F.col("_place") + (F.col("_c") + 1) / 2).alias("_r"))
        pairs = joined(pairs, ranks, groups, c).drop(c).withColumnRenamed("_r", c)
    return pairs


def percentiles(rows: DataFrame, groups: list[str], value: str, shares: list[float], long: bool) -> DataFrame:
    """(groups..., p): exact percentiles of each group, by linear interpolation between the sorted values."""
    out = []
    for share in shares:
        at = (F.col("_count") - 1) * F.lit(share)
        low, high = (F.max(F.when((F.col("_place") <= f(at)) & (f(at) < F.col("_place") + F.col("_c")), F.col(value))) for f in (F.floor, F.ceil))
        out.append(low + (high - low) * F.max(at - F.floor(at)))
    return value_places(rows, groups, value, long).groupBy(*groups).agg(F.array(*out).alias("p"))
