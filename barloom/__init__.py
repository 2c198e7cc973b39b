"""Features of market bars and their evaluation, on Spark."""

from .compute import compute_features
from .config import ConfigValidationError, validate_config
from .evaluate import (
    cross_sectional_ic, default_kernel_lags, evaluate_features, ic_summary, newey_west_regression, rolling_ic, target_by_feature_quantile,
    target_values_by_quantile, time_series_ic,
)
from .features import FEATURES, register, register_frame
from .quality import clean_ohlcv
from .sinks import load_features, save_features
from .sources import load_ohlcv

__all__ = [
    "FEATURES", "ConfigValidationError", "clean_ohlcv", "compute_features", "cross_sectional_ic", "default_kernel_lags", "evaluate_features", "ic_summary",
    "load_features", "load_ohlcv", "newey_west_regression", "register", "register_frame", "rolling_ic", "save_features", "target_by_feature_quantile",
    "target_values_by_quantile", "time_series_ic", "validate_config",
]
