"""Low, neutral and high states of features, and the tables behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import finite
from .buckets import bucketed, edge_table, percentile_table
from .ic import rolling_ic, time_series_ic
from .pairs import need_columns, pair_table
from .places import joined


#: Decimal places of a coefficient that count for its sign.
SIGN_PLACES = 12


#: States in the order in which they are shown.
STATES = ("low", "neutral", "high", "off", "on")


def state_rows(df: DataFrame, feature: str, target: str, by_symbol: bool = False) -> DataFrame:
    """(state, x, y): off and on for features with two values at most (the larger is on), else low, neutral and high by terciles.

    Where equal values leave two terciles they are low and high, where they leave one it is neutral. With ``by_symbol`` each symbol's values are
    taken by themselves.
    """
    keys = ["feature", "symbol"] if by_symbol else ["feature"]
    pairs = pair_table(df, [feature], target)
    ends = pairs.groupBy(*keys).agg(F.max("x").alias("top"), F.count_distinct("x").alias("values"))
    placed = joined(joined(pairs, edge_table(pairs, keys, 3), keys), ends, keys).withColumn("bin", F.size(F.filter("edges", lambda e: F.col("x") > e)))
    bins = placed.groupBy(*keys).agg(F.sort_array(F.collect_set("bin")).alias("bins"))  # three at most
    dense, n = F.array_position("bins", F.col("bin")), F.size("bins")
    state = (
        F.when(F.col("values") <= 2, F.when(F.col("x") == F.col("top"), "on").otherwise("off"))
        .when(n == 1, "neutral").when(n == 2, F.when(dense == 1, "low").otherwise("high"))
        .when(dense == 1, "low").when(dense == 2, "neutral").otherwise("high")
    )
    return joined(placed, bins, keys).select(state.alias("state"), "x", "y")


def _marks(rows: DataFrame, key: str, value: str, median: bool = False) -> DataFrame:
    """(key, observations, mean, percentile_10, _25, _75, _90) and, if asked for, median."""
    names = ["percentile_10", "percentile_25", "percentile_75", "percentile_90", *(["median"] if median else [])]
    shares = [0.1, 0.25, 0.75, 0.9, *([0.5] if median else [])]
    found = percentile_table(rows.filter(F.col(key).isNotNull()), [key], value, shares, observations=F.count("*"), mean=F.avg(value))
    return found.select(key, "observations", "mean", *(F.col("p")[i].alias(n) for i, n in enumerate(names)))


def spread_by_state(df: DataFrame, features: list[str], target: str, by_symbol: bool = False) -> DataFrame:
    """(feature, state, observations, mean, percentile_10, _25, _75, _90) of the target."""
    out = None
    for f in features:
        one = _marks(state_rows(df, f, target, by_symbol), "state", "y").select(F.lit(f).alias("feature"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None or not out.limit(1).count():
        raise ValueError(f"No rows have both a feature and {target!r}")
    return out


def violin_marks(df: DataFrame, feature: str, target: str, quantiles: int = 5, by_symbol: bool = True) -> DataFrame:
    """(quantile, observations, mean, percentiles, median, overall_mean): what a violin figure of the buckets marks."""
    rows = bucketed(pair_table(df, [feature], target), quantiles, by_symbol)
    marks = _marks(rows, "quantile", "y", median=True)
    overall = rows.agg(F.avg("y").alias("overall_mean"))  # one row, of the pairs without a bucket too
    return marks.withColumn("_one", F.lit(1)).join(F.broadcast(overall.withColumn("_one", F.lit(1))), "_one").drop("_one")


def overall_mean(df: DataFrame, target: str) -> DataFrame:
    """(overall_mean,): mean of the finite target values, the line of the state figure."""
    need_columns(df, target)
    return df.agg(F.avg(finite(F.col(target))).alias("overall_mean"))


def rolling_ic_panels(df: DataFrame, feature: str, target: str, window: int, method: str = "spearman") -> tuple[DataFrame, DataFrame]:
    """Rolling coefficients, and (symbol, full_ic, windows, share_same_sign): how many windows have the sign of the whole sample.

    Signs are those of coefficients rounded to ``SIGN_PLACES``: what is left of a zero by rounding errors has none.
    """
    rolling = rolling_ic(df, feature, target, window, method)
    full = time_series_ic(df, feature, target, method, 2).withColumnRenamed("ic", "full_ic")
    same = (F.signum(F.round("ic", SIGN_PLACES)) == F.signum(F.round("full_ic", SIGN_PLACES))).cast("double")
    share = rolling.join(full, "symbol").groupBy("symbol").agg(F.max("full_ic").alias("full_ic"), F.count("*").alias("windows"), F.avg(same).alias("share_same_sign"))
    return rolling, share


def panel_share(df: DataFrame, feature: str, target: str, window: int, method: str = "spearman") -> DataFrame:
    """(full_ic, windows, share_same_sign) over all symbols: the mean of their coefficients, and how many windows have its sign.

    Symbols with too few pairs for a coefficient are left out of the mean; without one, or if it is 0, there is no share.
    """
    full = time_series_ic(df, feature, target, method).agg(F.avg("ic").alias("full_ic")).withColumn("_one", F.lit(1))
    rolled = rolling_ic(df, feature, target, window, method).agg(
        F.count("*").alias("windows"), F.count_if(F.round("ic", SIGN_PLACES) > 0).alias("_up"), F.count_if(F.round("ic", SIGN_PLACES) < 0).alias("_down")
    )
    whole = F.signum(F.round("full_ic", SIGN_PLACES))
    same = F.when(whole > 0, F.col("_up")).when(whole < 0, F.col("_down"))
    return full.join(F.broadcast(rolled.withColumn("_one", F.lit(1))), "_one").select("full_ic", "windows", F.try_divide(same, "windows").alias("share_same_sign"))
