"""Exponential smoothing of sorted bars, in bounded memory and over many tasks.

Within a batch the recursion y[t] = a[t] y[t-1] + b[t] is solved by doubling for all groups of the batch at once; a few numbers pass from
batch to batch. Where a group is cut into stretches of time, each stretch is summed up as an affine map of what comes before it,
the maps of a group are composed in order, which gives the state at the start of each stretch, and a second pass applies it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = (math.nan, 0.0, 0.0)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y[t] = a[t] y[t-1] + b[t] with y[-1] = 0, for finite numbers; a[t] = 0 begins anew."""
    a, y, step = a.copy(), b.copy(), 1
    while step < len(y) and a.any():
        y[step:] += a[step:] * y[:-step]
        a[step:] *= a[:-step]
        a[:step] = 0
        step *= 2
    return y


def _parts(gaps: np.ndarray, alpha: float) -> np.ndarray:
    """The share of a new value ``gaps`` rows after the one before: what was before fades with every row."""
    return np.where(gaps == 1, alpha, alpha / ((1 - alpha) ** gaps + alpha))


class Smoother:
    """The mean moves to each value by ``alpha``, missing values fade the weight of what was before; null until ``least`` values have come.

    After an infinite value the mean of its group is infinite, and missing once both signs have come; other groups know nothing of it.
    """

    def __init__(self, alpha: float, least: int):
        self.alpha, self.least = alpha, least
        #: Of the last row: the mean, rows since its last value, values so far.
        self.state = BLANK

    def run(self, x: np.ndarray, starts: np.ndarray, states: np.ndarray | None = None) -> np.ndarray:
        """The means of a batch; ``starts`` marks the first row of each group, rows before one go on from the batch before.

        ``states`` has a state for each row that is marked, which its group goes on from.
        """
        if not len(x):
            return x
        first = np.flatnonzero(starts)
        begun = np.tile(BLANK, (len(first), 1)) if states is None else np.array(states, float).reshape(-1, 3)
        if not starts[0]:
            first, begun = np.concatenate([[0], first]), np.concatenate([[self.state], begun])
        mean, gap, before = begun.T
        group = np.searchsorted(first, np.arange(len(x)), side="right") - 1
        there = ~np.isnan(x)
        at = np.flatnonzero(there)
        own, v = group[at], x[at]
        lead = np.concatenate([[True], own[1:] != own[:-1]])[: len(at)]
        gaps = np.diff(at, prepend=0).astype(float)
        gaps[lead] = at[lead] - first[own[lead]] + 1 + gap[own[lead]]
        part = np.where(~lead | (before[own] > 0), _parts(gaps, self.alpha), 1.0)
        b = part * np.where(np.isinf(v), 0, v)
        b[lead] += (1 - part[lead]) * np.where(np.isfinite(mean), mean, 0)[own[lead]]
        y = solve(np.where(lead, 0, 1 - part), b)
        lost = ~np.isfinite(mean) & (before > 0)
        if np.isinf(v).any() or lost.any():
            up, down = (_so_far(v == s, lead) | (lost & ~(mean == -s))[own] for s in (math.inf, -math.inf))
            y = np.where(up & down, math.nan, np.where(up, math.inf, np.where(down, -math.inf, y)))
        count = np.cumsum(there)
        of_group = count - (count[first] - there[first])[group]
        out = np.where(of_group > 0, np.concatenate([[math.nan], y])[count], mean[group])
        seen = of_group + before[group]
        since = len(x) - 1 - at[-1] if of_group[-1] else gap[-1] + len(x) - first[-1]
        self.state = (float(out[-1]), float(since), float(seen[-1]))
        return np.where(seen >= self.least, out, math.nan)


def _so_far(flag: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Whether the flag has been set since the last lead."""
    count = np.cumsum(flag)
    start = np.maximum.accumulate(np.where(lead, np.arange(len(flag)), 0))
    return count - count[start] + flag[start] > 0


class Stretch:
    """A stretch of a group as a map of the state before it: the mean after it is ``keep`` times the one after its first value, plus ``add``."""

    def __init__(self, alpha: float):
        self.alpha = alpha
        self.rows = self.values = self.wait = self.first = self.add = self.tail = self.up = self.down = 0.0
        self.keep = 1.0

    def absorb(self, x: np.ndarray) -> None:
        """More rows at its end."""
        at = np.flatnonzero(~np.isnan(x))
        v = x[at]
        self.up, self.down = max(self.up, float((v == math.inf).any())), max(self.down, float((v == -math.inf).any()))
        v = np.where(np.isinf(v), 0, v)
        gaps = np.diff(at, prepend=-1 - self.tail).astype(float)
        if len(at) and not self.values:
            self.wait, self.first = self.rows + at[0], v[0]
            gaps, v = gaps[1:], v[1:]
        self.values += len(at)
        if len(v):
            part = _parts(gaps, self.alpha)
            self.keep, self.add = self.keep * float(np.prod(1 - part)), float(solve(1 - part, part * v + (np.arange(len(v)) == 0) * (1 - part) * self.add)[-1])
        self.tail = len(x) - 1 - at[-1] if len(at) else self.tail + len(x)
        self.rows += len(x)

    def numbers(self) -> list[float]:
        return [self.rows, self.values, self.wait, self.first, self.keep, self.add, self.tail, self.up, self.down]


def after(state: tuple[float, float, float], stretch: list[float], alpha: float) -> tuple[float, float, float]:
    """The state after a stretch, given the one before it."""
    (mean, gap, seen), (rows, values, wait, first, keep, add, tail, up, down) = state, stretch
    if not values:
        return mean, gap + rows, seen
    lost = seen > 0 and not math.isfinite(mean)
    up, down = up or lost and mean != -math.inf, down or lost and mean != math.inf
    if up or down:
        return math.nan if up and down else math.inf if up else -math.inf, tail, seen + values
    if seen:
        part = float(_parts(np.array([gap + wait + 1]), alpha)[0])
        first = part * first + (1 - part) * mean
    return keep * first + add, tail, seen + values


def smooth_columns(df: DataFrame, keys: list[str], smoothers: dict[str, tuple[Column, float, int]], cut: bool = False) -> DataFrame:
    """Add a column for each (value, alpha, least) to rows that come sorted by ``keys`` and time within their partitions.

    ``__order`` numbers them; ``__start`` marks the first row of each group or, with ``cut``, of each stretch of one (the last of ``keys`` numbers the stretches).
    """
    names, alphas, leasts = list(smoothers), [s[1] for s in smoothers.values()], [s[2] for s in smoothers.values()]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    df = df.select("*", *(value.cast("double").alias(f"{n}_in") for n, (value, _, _) in smoothers.items()))
    width = len(names)
    if cut:
        df = _with_states(df, keys, names, alphas)

    def run(batches):
        each, held = [Smoother(a, n) for a, n in zip(alphas, leasts)], -1
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = batch.column("__start").to_numpy(zero_copy_only=False)
            held = in_order(batch, starts, held)
            states = None
            if cut:
                given = batch.column("_states").to_pylist()
                states = np.array([given[i] or BLANK * width for i in np.flatnonzero(starts)], float).reshape(-1, width, 3)
            out = []
            for i, (n, s) in enumerate(zip(names, each)):
                x = batch.column(f"{n}_in").to_numpy(zero_copy_only=False).astype(float)
                y = s.run(x, starts, None if states is None else states[:, i])
                out.append(pa.array(y, mask=np.isnan(y)))
            kept = [c for c in batch.schema.names if c != "_states" and not (c.endswith("_in") and c[:-3] in names)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *out], [*kept, *names])

    return df.mapInArrow(run, kinds + "".join(f", `{n}` double" for n in names))


def in_order(batch: pa.RecordBatch, starts: np.ndarray, held: int) -> int:
    """The last number of the batch; an error if bars of a group do not follow each other, as a recursion would silently be wrong then."""
    order = batch.column("__order").to_numpy(zero_copy_only=False)
    if ((np.diff(order, prepend=held) != 1) & ~starts).any():
        raise RuntimeError("bars of a group came out of order")
    return int(order[-1])


def _with_states(df: DataFrame, keys: list[str], names: list[str], alphas: list[float]) -> DataFrame:
    """The rows with ``_states`` at the start of each stretch but a group's first: the means there, composed of the stretches before."""
    groups, number = keys[:-1], keys[-1]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    long = df.filter(F.col("_count") > F.col("__length"))  # groups of one stretch need no state

    def sum_up(batches) -> Iterator[pa.RecordBatch]:
        own, label, held = None, None, -1

        def done():
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(label, types)), pa.array([[x for s in own for x in s.numbers()]])], [*keys, "_map"])

        for batch in batches:
            starts = batch.column("__start").to_numpy(zero_copy_only=False)
            if not batch.num_rows:
                continue
            held, types = in_order(batch, starts, held), [batch.schema.field(k).type for k in keys]
            marks = sorted({0, *np.flatnonzero(starts).tolist(), batch.num_rows})
            for a, b in zip(marks, marks[1:]):
                if starts[a]:
                    if own is not None:
                        yield done()
                    own, label = [Stretch(x) for x in alphas], [batch.column(k)[a].as_py() for k in keys]
                for n, s in zip(names, own):
                    s.absorb(batch.column(f"{n}_in").slice(a, b - a).to_numpy(zero_copy_only=False).astype(float))
        if own is not None:
            yield done()

    def carry(maps: pd.DataFrame) -> pd.DataFrame:
        maps = maps.sort_values(number, ignore_index=True)
        states, out = [BLANK] * len(alphas), []
        for row in maps["_map"]:
            out.append([x for s in states for x in s])
            states = [after(s, list(row[i * 9 : i * 9 + 9]), a) for i, (s, a) in enumerate(zip(states, alphas))]
        return maps.assign(_states=out)[[*keys, "_states"]]

    maps = long.mapInArrow(sum_up, f"{kinds}, _map array<double>")
    carries = maps.groupBy(*groups).applyInPandas(carry, f"{kinds}, _states array<double>").withColumnsRenamed({k: f"_c_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    return df.join(carries, same, "left").drop(*(f"_c_{k}" for k in keys))
