"""The features that row expressions and window frames can state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Group, register


def _c() -> Column:
    return F.col("close")


def previous_close(g: Group) -> Column:
    return g.shared(1, "previous_close", lambda: g.lag("close", 1))


def _log_return(g: Group) -> Column:
    return g.shared(1, "log_return", lambda: F.ln(F.try_divide(_c(), g.lag("close", 1))))


def _mean_close(g: Group, window: int) -> Column:
    return g.shared(1, f"mean_close_{window}", lambda: g.full(_c(), F.avg("close"), 1 - window, 0))


def _vwap(g: Group) -> Column:
    def build() -> Column:
        traded = (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")
        total = F.when(F.col("volume").isNotNull(), g.running("volume", F.col("volume")))
        return F.when(traded.isNotNull(), F.try_divide(g.running("traded", traded), total))

    return g.shared(1, "vwap", build)


@register("returns", 1, "Log return since the bar before.", "ln(close / previous close)")
def log_return(g: Group) -> Column:
    return _log_return(g)


@register("returns", 1, "Relative change of the close since the bar before.", "close / previous close - 1")
def simple_return(g: Group) -> Column:
    return F.try_divide(_c(), previous_close(g)) - 1


@register("target", 0, "Return over the bars to come.", "close in `bars` bars / close - 1", defaults={"bars": 1})
def next_n_bar_return(g: Group, bars: int) -> Column:
    ahead = g.shared(1, f"close_in_{bars}", lambda: g.lead("close", bars))
    return F.try_divide(ahead, _c()) - 1


@register("target", 0, "Spread of the log returns of the bars to come.", "sample deviation of the next `bars` log returns", defaults={"bars": 20}, minimum={"bars": 2})
def next_n_bar_realized_volatility(g: Group, bars: int) -> Column:
    r = _log_return(g)
    return g.shared(2, f"volatility_in_{bars}", lambda: g.full(r, F.stddev_samp(r), 1, bars))


@register("trend", lambda p: p["window"], "Mean close over the last bars.", "mean of the last `window` closes", defaults={"window": 20})
def moving_average(g: Group, window: int) -> Column:
    return _mean_close(g, window)


@register("trend", lambda p: p["window"], "Distance of the close from its mean.", "close / moving average - 1", defaults={"window": 20})
def price_vs_moving_average(g: Group, window: int) -> Column:
    return F.try_divide(_c(), _mean_close(g, window)) - 1


@register("trend", lambda p: p["periods"], "Relative change of the close over several bars.", "close / close `periods` bars ago - 1", defaults={"periods": 20})
def rate_of_change(g: Group, periods: int) -> Column:
    ago = g.shared(1, f"close_{periods}_ago", lambda: g.lag("close", periods))
    return F.try_divide(_c(), ago) - 1


@register("volatility", lambda p: p["window"], "Spread of the log returns between the last prices.", "sample deviation of the `window` - 1 log returns between the last `window` closes",
          defaults={"window": 20}, minimum={"window": 3})
def rolling_standard_deviation(g: Group, window: int) -> Column:
    r = _log_return(g)
    return g.shared(2, f"deviation_{window}", lambda: g.full(r, F.stddev_samp(r), 2 - window, 0))


@register("volatility", 0, "Range of the bar relative to its close.", "(high - low) / close")
def bar_range_percent(g: Group) -> Column:
    return F.try_divide(F.col("high") - F.col("low"), _c())


@register("volume", lambda p: p["window"], "Volume relative to its mean.", "volume / mean of the last `window` volumes", defaults={"window": 20})
def volume_ratio(g: Group, window: int) -> Column:
    mean = g.shared(1, f"mean_volume_{window}", lambda: g.full(F.col("volume"), F.avg("volume"), 1 - window, 0))
    return F.try_divide(F.col("volume"), mean)


@register("volume", 0, "Money traded in the bar.", "close * volume")
def dollar_volume(g: Group) -> Column:
    return _c() * F.col("volume")


@register("volume", 1, "Relative change of the volume since the bar before; infinite after an empty bar.", "volume / previous volume - 1")
def volume_change(g: Group) -> Column:
    before = g.shared(1, "previous_volume", lambda: g.lag("volume", 1))
    rose = (before == 0) & (F.col("volume") > 0)
    return F.when(rose, F.lit(float("inf"))).otherwise(F.try_divide(F.col("volume"), before) - 1)


@register("volume", 0, "Mean price so far, weighted by volume.", "running sum of (high + low + close) / 3 * volume / running sum of volume")
def vwap(g: Group) -> Column:
    return _vwap(g)


@register("volume", 0, "Distance of the close from the weighted mean price.", "close / vwap - 1")
def price_vs_vwap(g: Group) -> Column:
    return F.try_divide(_c(), _vwap(g)) - 1
