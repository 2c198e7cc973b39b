"""Validation of a parsed configuration; nothing is changed."""

from __future__ import annotations

import datetime as dt
import warnings
from typing import Any
from zoneinfo import ZoneInfo

from .features import FEATURES
from .quality import RULES
from .schema import IDS, SESSIONS
from .sources import IDENTIFIER

SOURCES = ("clickhouse", "csv")
FORMATS = ("csv", "parquet")


class ConfigValidationError(ValueError):
    """A configuration that cannot be run; the message names the place."""


def _need(condition: bool, message: str) -> None:
    if not condition:
        raise ConfigValidationError(message)


def _text(value: Any, where: str) -> None:
    _need(isinstance(value, str) and bool(value.strip()), f"{where} must be a non-empty string")


def validate_config(config: dict[str, Any]) -> None:
    _validate_run(config.get("run"))
    _validate_quality(config.get("data_quality", {}))
    _validate_features(config.get("features", {}))


def _validate_run(run: Any) -> None:
    _need(isinstance(run, dict), "run must be a table")
    missing = [k for k in ("output_dir", "output_formats", "source") if k not in run]
    _need(not missing, f"run is missing keys: {missing}")
    _need(run["source"] in SOURCES, f"run.source must be one of {list(SOURCES)}")
    formats = run["output_formats"]
    _need(isinstance(formats, list) and bool(formats), "run.output_formats must be a non-empty list")
    _need(all(isinstance(f, str) for f in formats), "run.output_formats must contain only strings")
    unknown = sorted(set(formats) - set(FORMATS))
    _need(not unknown, f"run.output_formats holds unsupported formats {unknown}; known: {list(FORMATS)}")
    _text(run["output_dir"], "run.output_dir")
    if "session" in run:
        _need(isinstance(run["session"], str) and run["session"] in SESSIONS, f"run.session must be one of {sorted(SESSIONS)}")
    if "exchange_timezone" in run:
        zone = run["exchange_timezone"]
        _text(zone, "run.exchange_timezone")
        try:
            ZoneInfo(zone)
        except Exception as e:
            raise ConfigValidationError(f"run.exchange_timezone is no IANA time zone: {zone}") from e
    start, end = (_date(run[k], f"run.{k}") if run.get(k) is not None else None for k in ("start_date", "end_date"))
    _need(start is None or end is None or start <= end, "run.start_date must not be after run.end_date")
    if run["source"] == "csv":
        _text(run.get("input_path"), "run.input_path")
        if run.get("symbols"):
            _symbols(run["symbols"])
        return
    for k in ("symbols", "start_date", "end_date", "table"):
        _need(k in run, f"run is missing keys: ['{k}']; run.{k} is required for clickhouse")
    _symbols(run["symbols"])
    _need(isinstance(run["table"], str) and bool(IDENTIFIER.fullmatch(run["table"])), f"run.table is no safe SQL identifier: {run['table']}")


def _date(value: Any, where: str) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    try:
        return dt.datetime.fromisoformat(value).date()
    except (TypeError, ValueError) as e:
        raise ConfigValidationError(f"{where} must be a valid date") from e


def _symbols(symbols: Any) -> None:
    _need(isinstance(symbols, list) and bool(symbols), "run.symbols must be a non-empty list")
    _need(all(isinstance(s, str) and s.strip() for s in symbols), "run.symbols must hold non-empty strings")


def _validate_quality(quality: Any) -> None:
    _need(isinstance(quality, dict), "data_quality must be a table")
    unknown = sorted(set(quality) - set(RULES))
    _need(not unknown, f"data_quality holds unknown option(s): {unknown}")
    for name, value in quality.items():
        _need(isinstance(value, bool), f"data_quality.{name} must be true or false")


def _validate_features(features: Any) -> None:
    _need(isinstance(features, dict), "features must be a table")
    known = {s.category for s in FEATURES.values()}
    chosen = {}
    for key in ("include_categories", "exclude_categories"):
        values = features.get(key, [])
        _need(isinstance(values, list), f"features.{key} must be a list")
        for i, value in enumerate(values):
            _need(isinstance(value, str), f"features.{key}[{i}] must be a string")
            _need(value in known, f"features.{key}[{i}] is unknown: {value}; known: {sorted(known)}")
        chosen[key] = set(values)
    twice = sorted(chosen["include_categories"] & chosen["exclude_categories"])
    _need(not twice, f"categories stand in both include_categories and exclude_categories: {twice}")
    _need(isinstance(features.get("reset_by_session", False), bool), "features.reset_by_session must be true or false")
    unknown = sorted(set(features) - {"include_categories", "exclude_categories", "reset_by_session", "parameters"})
    if unknown:
        warnings.warn(f"features holds keys that are not read: {unknown}", stacklevel=3)
    items = features.get("parameters", [])
    _need(isinstance(items, list), "features.parameters must be a list")
    names: list[str] = []
    for i, item in enumerate(items):
        _validate_item(item, f"features.parameters[{i}]")
        if item.get("enabled", True):
            _need(item["name"] not in names, f"features.parameters[{i}].name is a duplicate: {item['name']}")
            names.append(item["name"])


def _validate_item(item: Any, where: str) -> None:
    _need(isinstance(item, dict), f"{where} must be a table")
    for key in ("name", "function"):
        _text(item.get(key), f"{where}.{key}")
    _need(item["name"] not in IDS, f"{where}.name is a reserved identifier column: {item['name']}")
    _need(item["function"] in FEATURES, f"{where}.function is unknown: {item['function']}")
    _need(isinstance(item.get("enabled", True), bool), f"{where}.enabled must be true or false")
    spec = FEATURES[item["function"]]
    params = {k: v for k, v in item.items() if k not in ("name", "function", "enabled")}
    if spec.kind == "frame":
        return
    unknown = sorted(set(params) - set(spec.defaults))
    _need(not unknown, f"{where} has unsupported parameter(s) for {spec.name}: {unknown}")
    for name, value in params.items():
        least = spec.minimum.get(name, 1)
        _need(isinstance(value, int) and not isinstance(value, bool) and value >= least, f"{where}.{name} must be an integer >= {least}")
    values = spec.defaults | params
    if "fast" in values:
        _need(values["fast"] < values["slow"], f"{where}.fast must be less than slow")
