"""From bars and a configuration to feature columns."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FEATURES, FeatureSpec
from .features.registry import Group
from .schema import COLUMNS, IDS, NUMBERS, number
from .shared import HALO, STRETCH, has_long_groups, stretches


def selected_feature_configs(features: dict[str, Any] | None) -> list[dict[str, Any]]:
    """Enabled items whose category is included (an empty list includes all) and not excluded."""
    features = features or {}
    include, exclude = set(features.get("include_categories") or []), set(features.get("exclude_categories") or [])
    out = []
    for item in features.get("parameters") or []:
        if not item.get("enabled", True):
            continue
        category = _spec(item).category
        if (not include or category in include) and category not in exclude:
            out.append(item)
    return out


def _spec(item: dict[str, Any]) -> FeatureSpec:
    if item["function"] not in FEATURES:
        raise ValueError(f"unknown feature function {item['function']!r}")
    return FEATURES[item["function"]]


def resolve_feature(item: dict[str, Any]) -> tuple[str, FeatureSpec, dict[str, Any]]:
    """(output name, spec, parameters)."""
    params = {k: v for k, v in item.items() if k not in ("name", "function", "enabled")}
    return item["name"], _spec(item), params


def check_names(names: list[str]) -> None:
    for name in names:
        if name in IDS:
            raise ValueError(f"Feature column name {name!r} is a reserved identifier column")
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"Duplicate feature column name: {twice}")


#: Bars of one symbol that a task holds at most.
ROWS_PER_TASK = 1 << 20


def compute_features(df: DataFrame, config: dict[str, Any] | None, on_infinite: str = "raise", rows_per_task: int | None = None) -> DataFrame:
    """(symbol, timestamp, features in config order); one row for each bar.

    ``config`` is a whole configuration or its features table. Windows never leave a symbol, nor a
    day with reset_by_session. Infinite values raise when the result is computed, or become null with
    ``on_infinite="null"``. Rows without symbol or timestamp keep null features.

    A symbol with more than ``rows_per_task`` bars (``ROWS_PER_TASK`` by default) is cut into stretches of time that tasks compute each by itself, with
    the same results; the bars are then sorted by symbol and time and written to the shared folder first, when this is called.
    """
    features = (config or {}).get("features", config) or {}
    resolved = [resolve_feature(item) for item in selected_feature_configs(features)]
    return apply_features(df, resolved, bool(features.get("reset_by_session", False)), on_infinite, rows_per_task)


def apply_features(df: DataFrame, resolved: list[tuple[str, FeatureSpec, dict[str, Any]]], reset_by_session: bool = False,
                   on_infinite: str = "raise", rows_per_task: int | None = None) -> DataFrame:
    names = [name for name, _, _ in resolved]
    check_names(names)
    missing = [c for c in COLUMNS if c not in df.columns]
    if missing:
        raise KeyError(f"missing bar columns: {missing}")
    keys = ["symbol", "__day"] if reset_by_session else ["symbol"]
    bars = df.select("symbol", "timestamp", *(number(F.col(c)).alias(c) for c in NUMBERS))
    if reset_by_session:
        bars = bars.withColumn("__day", F.to_date("timestamp"))
    rows = ROWS_PER_TASK if rows_per_task is None else rows_per_task
    long = not reset_by_session and any(s.kind != "frame" or s.bounded for _, s, _ in resolved) and has_long_groups(bars, ["symbol"], rows)
    group = Group(keys, rows if long and any(s.kind != "frame" for _, s, _ in resolved) else None)
    columns, frames = {}, {}
    for name, spec, params in resolved:
        values = spec.check(params)
        if spec.kind == "frame":
            frames[name] = (spec, params)
        else:
            columns[name] = spec.function(group, **values)
    known = F.col("symbol").isNotNull()
    out = group.apply(bars)
    passed = list(dict.fromkeys(["symbol", "timestamp", *keys, *(NUMBERS if frames else ())]))
    out = out.select(*passed, *(_bounded(F.when(known, c), n, on_infinite).alias(_inner(n)) for n, c in columns.items()))
    cut = {n: f for n, f in frames.items() if long and f[0].bounded}
    if cut:
        back = max(spec.resolve_lookback(params) for spec, params in cut.values())
        out = _frames(stretches(out, keys, "timestamp", rows, back, 0, "frames"), [*keys, STRETCH], cut, on_infinite).drop("_place", "_count", "__length", STRETCH, HALO)
    whole = {n: f for n, f in frames.items() if n not in cut}
    if whole:
        out = _frames(out, keys, whole, on_infinite)
    return out.select("symbol", "timestamp", *(F.col(_inner(n)).alias(n) for n in names))


def _inner(name: str) -> str:
    """Feature columns have names of their own until the end: an output may be called like a bar column."""
    return f"__f_{name}"


def _bounded(column, name: str, on_infinite: str):
    infinite = F.abs(column) == float("inf")
    bad = F.lit(None).cast("double") if on_infinite == "null" else F.raise_error(F.lit(f"{name}: feature produced infinite values")).cast("double")
    return F.when(infinite, bad).otherwise(column)


def check_output(name: str, result: Any, frame: pd.DataFrame, own: pd.Series | None = None) -> pd.Series:
    """A frame feature's result if it keeps the contract, else an error that names the column; ``own`` marks the rows whose values are used."""
    if not isinstance(result, pd.Series):
        raise TypeError(f"{name}: feature must return a pandas Series")
    if len(result) != len(frame):
        raise ValueError(f"{name}: feature must have the same length as its bars")
    if not result.index.equals(frame.index):
        raise ValueError(f"{name}: feature must have the same index as its bars")
    if not pd.api.types.is_numeric_dtype(result):
        raise TypeError(f"{name}: feature must be numeric")
    used = result if own is None else result[own]
    if np.isinf(used.to_numpy(dtype=float, na_value=np.nan)).any():
        raise ValueError(f"{name}: feature produced infinite values")
    return result.astype(float)


def _frames(df: DataFrame, keys: list[str], frames: dict[str, tuple[FeatureSpec, dict]], on_infinite: str) -> DataFrame:
    """Add the pandas columns; the functions see one group's bars at a time, as their contract says, or a stretch of them with those before it."""
    columns = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp", ignore_index=True)
        bars, own = pdf[list(COLUMNS)], ~pdf[HALO].astype(bool) if HALO in pdf else None
        for name, (spec, params) in frames.items():
            result = spec.function(bars.copy(), **params)
            if on_infinite == "null" and isinstance(result, pd.Series) and pd.api.types.is_numeric_dtype(result):
                result = result.replace([np.inf, -np.inf], np.nan)
            pdf[_inner(name)] = check_output(name, result, bars, own)
        return pdf if own is None else pdf[own]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    added = ", ".join(f"`{_inner(n)}` double" for n in frames)
    return df.select(*columns).groupBy(*keys).applyInPandas(run, f"{fields}, {added}")
