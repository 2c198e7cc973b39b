"""Information coefficients: correlation of a feature with what comes after."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import STRETCH, has_long_groups, stretches
from .pairs import correlation, pair_table
from .places import TASK_ROWS, average_ranks
from .rolling import rolling_correlation, rolling_rank_correlation, window_ranks  # noqa: F401

METHODS = ("spearman", "pearson")
MIN_OBSERVATIONS, MIN_SYMBOLS = 24, 5


def check_method(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")


def ranked(pairs: DataFrame, keys: list[str], method: str) -> DataFrame:
    check_method(method)
    return pairs if method == "pearson" else average_ranks(pairs, keys, "x", "y")


def grouped_ic(pairs: DataFrame, keys: list[str], method: str) -> DataFrame:
    """(keys..., n, ic)"""
    return ranked(pairs, keys, method).groupBy(*keys).agg(F.count("*").alias("n"), correlation().alias("ic"))


def time_series_table(pairs: DataFrame, method: str = "spearman", least: int = MIN_OBSERVATIONS) -> DataFrame:
    """(feature, symbol, ic): null where a symbol has too few pairs."""
    return grouped_ic(pairs, ["feature", "symbol"], method).select("feature", "symbol", F.when(F.col("n") >= least, F.col("ic")).alias("ic"))


def time_series_ic(df: DataFrame, feature: str, target: str, method: str = "spearman", min_observations: int = MIN_OBSERVATIONS) -> DataFrame:
    """(symbol, ic) over time; symbols without any pair are absent."""
    check_method(method)
    return time_series_table(pair_table(df, [feature], target), method, min_observations).select("symbol", "ic")


def cross_sectional_ic(df: DataFrame, feature: str, target: str, method: str = "spearman", min_symbols: int = MIN_SYMBOLS) -> DataFrame:
    """(timestamp, ic) over the symbols of each time that has enough of them."""
    check_method(method)
    found = grouped_ic(pair_table(df, [feature], target), ["timestamp"], method)
    return found.filter(F.col("n") >= min_symbols).select("timestamp", "ic")


def rolling_ic(df: DataFrame, feature: str, target: str, window: int, method: str = "spearman") -> DataFrame:
    """(symbol, timestamp, ic) over each symbol's last ``window`` pairs; windows where one side is constant are left out."""
    check_method(method)
    if not isinstance(window, int) or isinstance(window, bool) or window < 2:
        raise ValueError("window must be an integer >= 2")
    pairs = pair_table(df, [feature], target)
    rows = pairs.select("symbol", "timestamp", "x", "y")
    if has_long_groups(rows, ["symbol"], TASK_ROWS):
        cut = stretches(rows, ["symbol"], "timestamp", TASK_ROWS, window - 1, 0, "pairs")
        keys, rows = ["symbol", STRETCH], cut.select("symbol", STRETCH, "timestamp", "x", "y")
    else:
        keys = ["symbol"]
    kinds = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes if n not in ("x", "y"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "timestamp")
    rolled = dealt.mapInArrow(lambda batches: _roll(batches, window, keys, method), f"{kinds}, ic double")
    return rolled.select("symbol", "timestamp", "ic").filter("ic is not null")


def _roll(batches: Iterator[pa.RecordBatch], window: int, keys: Sequence[str] = ("symbol",), method: str = "spearman") -> Iterator[pa.RecordBatch]:
    """(keys..., timestamp, ic) of pairs that come sorted; the last ``window`` - 1 of a group are kept from batch to batch."""
    correlate = rolling_rank_correlation if method == "spearman" else rolling_correlation
    held, names = None, [*keys, "timestamp"]
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            code = table[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new |= code[1:] != code[:-1]
        marks = [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]
        x, y = (table[c].to_numpy() for c in "xy")
        places, found = [], []
        for a, b in zip(marks, marks[1:]):
            if b - a >= window:
                places.append(np.arange(a + window - 1, b))
                found.append(correlate(x[a:b], y[a:b], window))
        at, ic = np.concatenate([np.array([], np.int64), *places]), np.concatenate([np.array([]), *found])
        out = table.select(names).take(pa.array(at)).append_column("ic", pa.array(ic, mask=np.isnan(ic)))
        yield from out.combine_chunks().to_batches()
        held = table.slice(max(marks[-2], table.num_rows - window + 1)).combine_chunks()
        held = held.to_batches()[0] if held.num_rows else None


def ic_summary(ics: DataFrame, column: str = "ic") -> DataFrame:
    """(mean, standard_deviation, information_ratio, share_positive, count) of the coefficients that are not null."""
    v = F.col(column)
    known = ics.filter(v.isNotNull() & ~F.isnan(v))
    out = known.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("standard_deviation"), F.avg((v > 0).cast("double")).alias("share_positive"), F.count("*").alias("count"))
    ratio = F.when(F.col("standard_deviation") > 0, F.try_divide("mean", "standard_deviation"))
    return out.select("mean", "standard_deviation", ratio.alias("information_ratio"), "share_positive", "count")
