"""The features with a first-order recursion: exponential means of columns, put together by row expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import number
from .columns import previous_close
from .registry import Group, register

_SPANS = {"fast": 12, "slow": 26}


def wilder(g: Group, key: str, value: Column, window: int) -> Column:
    return g.smoothed(1, f"{key}_{window}", value, 1 / window, window)


def ema(g: Group, key: str, value: Column, span: int, stage: int = 1) -> Column:
    return g.smoothed(stage, f"{key}_{span}", value, 2 / (span + 1), span)


def _line(g: Group, fast: int, slow: int) -> Column:
    return number(ema(g, "ema", F.col("close"), fast) - ema(g, "ema", F.col("close"), slow))


def _signal(g: Group, fast: int, slow: int, signal: int) -> Column:
    return ema(g, f"signal_{fast}_{slow}", _line(g, fast, slow), signal, 2)


@register("trend", lambda p: p["window"], "Relative strength index from 0 to 100.", "100 - 100 / (1 + mean gain / mean loss), both smoothed by 1 / `window`",
          "recursive", {"window": 14}, {"window": 2})
def relative_strength_index(g: Group, window: int) -> Column:
    change = number(F.col("close") - previous_close(g))
    up, down = (wilder(g, key, F.when(change.isNotNull(), F.greatest(sign * change, F.lit(0.0))), window) for key, sign in (("gain", F.lit(1)), ("loss", F.lit(-1))))
    strength = 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(up, down))
    return number(F.when((up == 0) & (down == 0), None).when(down == 0, F.when(up.isNotNull(), 100.0)).otherwise(strength))


@register("trend", lambda p: p["slow"], "Fast minus slow exponential mean of the close.", "EMA(`fast`) - EMA(`slow`)", "recursive", _SPANS)
def macd_line(g: Group, fast: int, slow: int) -> Column:
    return _line(g, fast, slow)


@register("trend", lambda p: p["slow"] + p["signal"], "Exponential mean of the MACD line.", "EMA(`signal`) of the MACD line", "recursive", _SPANS | {"signal": 9})
def macd_signal(g: Group, fast: int, slow: int, signal: int) -> Column:
    return _signal(g, fast, slow, signal)


@register("trend", lambda p: p["slow"] + p["signal"], "MACD line minus its signal.", "MACD line - MACD signal", "recursive", _SPANS | {"signal": 9})
def macd_histogram(g: Group, fast: int, slow: int, signal: int) -> Column:
    return number(_line(g, fast, slow) - _signal(g, fast, slow, signal))


@register("volatility", lambda p: p["window"], "Smoothed true range.", "true range smoothed by 1 / `window`; true range: the largest of high - low and both distances to the previous close",
          "recursive", {"window": 14}, {"window": 2})
def average_true_range(g: Group, window: int) -> Column:
    before, high, low = previous_close(g), F.col("high"), F.col("low")
    return wilder(g, "true_range", F.greatest(number(high - low), number(F.abs(high - before)), number(F.abs(low - before))), window)
