"""Evaluation of features against forward targets."""

from .buckets import target_by_feature_quantile, target_values_by_quantile
from .figures import rolling_ic_figure, spread_rows_by_state, violin_by_quantile
from .ic import cross_sectional_ic, ic_summary, rolling_ic, time_series_ic
from .regression import RegressionResult, default_kernel_lags, newey_west_regression
from .states import spread_by_state, state_rows
from .summary import evaluate_features

__all__ = [
    "RegressionResult", "cross_sectional_ic", "default_kernel_lags", "evaluate_features", "ic_summary", "newey_west_regression", "rolling_ic",
    "rolling_ic_figure", "spread_by_state", "spread_rows_by_state", "state_rows", "target_by_feature_quantile", "target_values_by_quantile", "time_series_ic", "violin_by_quantile",
]
