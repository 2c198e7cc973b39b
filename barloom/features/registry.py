"""What a feature is, and the catalogue of all of them.

Column features build a Spark column from a ``Group``, recursive ones from columns that it smooths. Frame
features are pandas functions of one group's bars, for what neither can express.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import HALO, STRETCH, stretches
from .smoothing import smooth_columns

Lookback = int | Callable[[dict[str, Any]], int]


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    function: Callable
    category: str
    lookback: Lookback
    description: str
    calculation: str
    kind: str = "column"
    defaults: dict[str, int] = field(default_factory=dict)
    minimum: dict[str, int] = field(default_factory=dict)
    #: A frame feature that only sees its lookback: its groups may be cut.
    bounded: bool = False

    def resolve_lookback(self, params: dict[str, Any] | None = None) -> int:
        values = self.defaults | (params or {})
        return self.lookback(values) if callable(self.lookback) else self.lookback

    def check(self, params: dict[str, Any]) -> dict[str, Any]:
        """All parameters with defaults filled in; a ValueError for unknown or too small ones."""
        unknown = sorted(set(params) - set(self.defaults))
        if unknown and self.kind != "frame":
            raise ValueError(f"{self.name} got unsupported parameter(s): {unknown}")
        values = self.defaults | params
        for name, value in values.items():
            least = self.minimum.get(name, 1)
            if self.kind == "frame":
                continue
            if not isinstance(value, int) or isinstance(value, bool) or value < least:
                raise ValueError(f"{self.name} requires {name} >= {least}, an integer")
        if "fast" in values and "slow" in values and values["fast"] >= values["slow"]:
            raise ValueError(f"{self.name} requires fast < slow: fast must be less than slow")
        return values


FEATURES: dict[str, FeatureSpec] = {}


class Group:
    """Windows over one isolation group and the columns that several features share.

    ``shared`` registers a column under a key; columns of layer 1 use the bars, those of layer 2 the bars and layer
    1. Each layer is one select, so a value that several features need is computed once. Smoothed columns come after the layers, those of
    stage 2 after those of stage 1. With ``length`` a group is cut into stretches of so many bars, each with as many bars of its
    neighbours as the windows reach, so that a group of any size lies over many tasks.
    """

    def __init__(self, keys: list[str], length: int | None = None):
        self.keys = keys if length is None else [*keys, STRETCH]
        self.window = Window.partitionBy(*self.keys).orderBy("timestamp")
        self.layers: dict[int, dict[str, Column]] = {1: {}, 2: {}}
        self.smoothers: dict[int, dict[str, tuple[Column, float, int]]] = {1: {}, 2: {}}
        self.sums: dict[str, Column] = {}
        self.length, self._layer, self._reach = length, 1, {1: [0, 0], 2: [0, 0]}

    def _reaches(self, first: int, last: int) -> None:
        reach = self._reach[self._layer]
        reach[:] = max(reach[0], -first), max(reach[1], last)

    def lag(self, value: str, bars: int) -> Column:
        self._reaches(-bars, 0)
        return F.lag(value, bars).over(self.window)

    def lead(self, value: str, bars: int) -> Column:
        self._reaches(0, bars)
        return F.lead(value, bars).over(self.window)

    def shared(self, layer: int, key: str, build: Callable[[], Column]) -> Column:
        name = f"__{key}"
        if name not in self.layers[layer]:
            self._layer = layer
            self.layers[layer][name] = build()
        return F.col(name)

    def full(self, value: Column, statistic: Column, first: int, last: int) -> Column:
        """A statistic over a row frame, null until every row of the frame has a value."""
        self._reaches(first, last)
        frame = self.window.rowsBetween(first, last)
        return F.when(F.count(value).over(frame) == last - first + 1, statistic.over(frame))

    def running(self, key: str, value: Column) -> Column:
        """The sum of all values so far, null before the first one."""
        upto = self.window.rowsBetween(Window.unboundedPreceding, 0)
        if self.length is None:
            return F.sum(value).over(upto)
        name = f"__before_{key}"
        self.sums[name] = value
        own, before = F.sum(F.when(~F.col(HALO), value)).over(upto), F.col(name)
        return F.when(own.isNull(), before).otherwise(own + F.coalesce(before, F.lit(0.0)))

    def smoothed(self, stage: int, key: str, value: Column, alpha: float, least: int) -> Column:
        """The exponential mean of a row expression; of stage 2 if it uses smoothed columns."""
        self.smoothers[stage].setdefault(f"__smooth_{key}", (value, alpha, least))
        return F.col(f"__smooth_{key}")

    def apply(self, df: DataFrame) -> DataFrame:
        if self.length is not None:
            df = self._cut(df)
        smooth = self.smoothers[1] or self.smoothers[2]
        if smooth:
            # numbered by a window, which is what sorts the bars
            self.layers[1]["__order"] = F.row_number().over(self.window)
        for layer in (1, 2):
            if self.layers[layer]:
                df = df.select("*", *(c.alias(n) for n, c in self.layers[layer].items()))
        if self.length is not None:
            df = df.filter(~F.col(HALO))
        if smooth:
            df = df.withColumn("__start", F.col("__order") == 1 if self.length is None else F.col("_place") % F.col("__length") == 0)
        for stage in (1, 2):
            if self.smoothers[stage]:
                df = smooth_columns(df, self.keys, self.smoothers[stage], self.length is not None)
        return df

    def _cut(self, df: DataFrame) -> DataFrame:
        """Bars by stretch: a stretch's own, and as halo those of its neighbours that its windows reach."""
        back, ahead = (self._reach[1][i] + self._reach[2][i] for i in (0, 1))
        bars = stretches(df, self.keys[:-1], "timestamp", self.length, back, ahead, "bars")
        if not self.sums:
            return bars
        totals = bars.filter(~F.col(HALO)).groupBy(*self.keys).agg(*(F.sum(v).alias(n) for n, v in self.sums.items()))
        upto = Window.partitionBy(*self.keys[:-1]).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)
        sums = totals.select(*(F.col(k).alias(f"_c{k}") for k in self.keys), *(F.sum(n).over(upto).alias(n) for n in self.sums))
        same = F.lit(True)
        for k in self.keys:
            same &= F.col(k).eqNullSafe(F.col(f"_c{k}"))
        # a halo at the end of a stretch may be the only bars of it that are left
        return bars.join(sums, same, "left").drop(*(f"_c{k}" for k in self.keys))


def register(category: str, lookback: Lookback, description: str, calculation: str, kind: str = "column",
             defaults: dict[str, int] | None = None, minimum: dict[str, int] | None = None, bounded: bool = False):
    """Add a feature under its function's name."""

    def add(function: Callable) -> Callable:
        FEATURES[function.__name__] = FeatureSpec(
            function.__name__, function, category, lookback, description, calculation, kind, defaults or {}, minimum or {}, bounded
        )
        return function

    return add


def register_frame(category: str, lookback: Lookback, description: str, calculation: str, bounded: bool = False):
    """Add a pandas feature: a function of one group's bars that returns a Series along the same index.

    A ``bounded`` one promises that a row's value follows from the row and the ``lookback`` bars before it: it may be given a stretch of a long
    group with as many bars before it, so that no task holds the group.
    """
    return register(category, lookback, description, calculation, kind="frame", bounded=bounded)
