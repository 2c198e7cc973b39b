"""Cleaning: every bar is charged to the first enabled rule that it breaks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import NUMBERS, PRICES


def _any(conditions: list[Column]) -> Column:
    """Whether one holds; a comparison with a missing value does not."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def _missing(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))


def _known(c: str) -> Column:
    """NaN compares as null: Spark would put it above every number."""
    return F.when(~_missing(c), F.col(c).cast("double"))


#: Config key -> (reason, condition), in the order in which bars are charged.
RULES: dict[str, tuple[str, Callable[[], Column]]] = {
    "drop_missing_numeric_values": ("missing or non-numeric price or volume", lambda: _any([_missing(c) for c in NUMBERS])),
    "drop_zero_prices": ("price at or below zero", lambda: _any([_known(c) <= 0 for c in PRICES])),
    "drop_negative_volume": ("volume below zero", lambda: _any([_known("volume") < 0])),
    "drop_high_lt_low": ("high below low", lambda: _any([_known("high") < _known("low")])),
    "drop_ohlc_violations": (
        "open or close outside the bar's range",
        lambda: _any([_known(c) < _known("low") for c in ("open", "close")] + [_known(c) > _known("high") for c in ("open", "close")]),
    ),
}


def first_broken(enabled: dict[str, bool] | None = None) -> Column:
    """Name of the first enabled rule that a bar breaks, or null."""
    enabled = enabled or {}
    out = F.lit(None).cast("string")
    for name in reversed(RULES):
        if enabled.get(name, True):
            out = F.when(RULES[name][1](), F.lit(name)).otherwise(out)
    return out


def rule_counts(df: DataFrame, enabled: dict[str, bool] | None = None) -> DataFrame:
    """(rule, bars): bars charged to each rule; clean ones under null."""
    return df.groupBy(first_broken(enabled).alias("rule")).agg(F.count("*").alias("bars"))


def clean_rows(df: DataFrame, enabled: dict[str, bool] | None = None) -> DataFrame:
    return df.filter(first_broken(enabled).isNull())


def cleaning_report(counts: dict[str | None, int], enabled: dict[str, bool]) -> dict:
    """The report from the bars charged to each rule; clean ones under None."""
    total = sum(counts.values())
    return {
        "initial_rows": total,
        "rules": {
            name: {"enabled": bool(enabled.get(name, True)), "dropped": counts.get(name, 0), "reason": reason}
            for name, (reason, _) in RULES.items()
        },
        "final_rows": counts.get(None, 0),
        "total_dropped": total - counts.get(None, 0),
    }


def clean_ohlcv(df: DataFrame, data_quality: dict[str, bool] | None = None) -> tuple[DataFrame, dict]:
    """(clean bars, report); the report takes one pass over the bars, the bars themselves stay lazy."""
    enabled = data_quality or {}
    counts = {r["rule"]: r["bars"] for r in rule_counts(df, enabled).collect()}
    return clean_rows(df, enabled), cleaning_report(counts, enabled)
