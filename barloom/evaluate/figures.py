"""The three figures of an evaluation as SVG text, drawn from small tables that Spark computes.

Colours tell states and kinds of targets apart also for colour-blind readers, and every mark has a label beside it. A figure takes from
Spark what its marks need and no more: percentiles, a binned density, or the extremes of each pixel column of a line.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks import write_text
from .buckets import bucketed, check_quantiles
from .ic import rolling_ic
from .pairs import pair_table
from .states import STATES, overall_mean, panel_share, spread_by_state, violin_marks

#: Fixed colours: low, neutral and high states, volatility targets, rules.
LOW, NEUTRAL, HIGH, VOLATILITY, RULE = "#D55E00", "#8C8C8C", "#0072B2", "#009E73", "#444444"
STATE_COLOURS = {"low": LOW, "neutral": NEUTRAL, "high": HIGH, "off": NEUTRAL, "on": LOW}
#: Bins of a density, points of its outline, and pixel columns of a line.
BINS, POINTS, COLUMNS = 512, 100, 1500


def target_colour(target: str) -> str:
    """Green for volatility targets, blue for all others."""
    return VOLATILITY if "vol" in target.lower() else HIGH


def percent(value: float) -> str:
    return f"{value * 100:.1f}%"


def ticks(low: float, high: float, most: int = 6) -> list[float]:
    """Round numbers within a span."""
    if not high > low:
        return [low]
    step = 10 ** math.floor(math.log10((high - low) / most))
    step *= next(m for m in (1, 2, 5, 10) if (high - low) / (step * m) <= most)
    return [round(i * step, 12) for i in range(math.ceil(low / step - 1e-9), math.floor(high / step + 1e-9) + 1)]


class Panel:
    """A plot with its own scales in a part of a figure. Only the left and the lower spine are drawn."""

    def __init__(self, box: tuple[float, float, float, float], xs: tuple[float, float], ys: tuple[float, float]):
        self.left, self.top, self.width, self.height = box
        self.xs, self.ys = ((a, b) if b > a else (a - 0.5, a + 0.5) for a, b in (xs, ys))
        self.marks: list[str] = []
        bottom = self.top + self.height
        self._add(f'<path class="spine" d="M{self.left:.1f} {self.top:.1f}V{bottom:.1f}H{self.left + self.width:.1f}" fill="none" stroke="#000"/>')

    def _add(self, mark: str) -> None:
        self.marks.append(mark)

    def x(self, v: float) -> float:
        return self.left + (v - self.xs[0]) / (self.xs[1] - self.xs[0]) * self.width

    def y(self, v: float) -> float:
        return self.top + self.height - (v - self.ys[0]) / (self.ys[1] - self.ys[0]) * self.height

    def line(self, points: Sequence[tuple[float, float]], colour: str, width: float = 1.5, kind: str = "line", opacity: float = 1.0, dashed: bool = False) -> None:
        at = " ".join(f"{self.x(a):.1f},{self.y(b):.1f}" for a, b in points)
        dash = ' stroke-dasharray="6 4"' if dashed else ""
        self._add(f'<polyline class="{kind}" points="{at}" fill="none" stroke="{colour}" stroke-width="{width}" stroke-opacity="{opacity}"{dash}/>')

    def area(self, points: Sequence[tuple[float, float]], colour: str, opacity: float, kind: str) -> None:
        at = " ".join(f"{self.x(a):.1f},{self.y(b):.1f}" for a, b in points)
        self._add(f'<polygon class="{kind}" points="{at}" fill="{colour}" fill-opacity="{opacity}"/>')

    def dot(self, x: float, y: float, colour: str, size: float = 4) -> None:
        self._add(f'<circle class="mean" cx="{self.x(x):.1f}" cy="{self.y(y):.1f}" r="{size}" fill="{colour}"/>')

    def text(self, x: float, y: float, text: str, anchor: str = "middle", size: float = 11, bold: bool = False) -> None:
        """Text at pixels of the figure."""
        weight = ' font-weight="bold"' if bold else ""
        self._add(f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}" font-size="{size}"{weight}>{escape(text)}</text>')

    def y_axis(self, as_percent: bool, label: str = "") -> None:
        for v in ticks(*self.ys):
            self.line([(self.xs[0], v), (self.xs[1], v)], RULE, 0.5, "grid", 0.25)
            self.text(self.left - 6, self.y(v) + 4, percent(v) if as_percent else f"{v:g}", "end")
        if label:
            self.text(self.left, self.top - 8, label, "start")

    def x_axis(self, as_percent: bool, label: str) -> None:
        for v in ticks(*self.xs):
            self.line([(v, self.ys[0]), (v, self.ys[1])], RULE, 0.5, "grid", 0.25)
            self.text(self.x(v), self.top + self.height + 16, percent(v) if as_percent else f"{v:g}")
        self.text(self.left + self.width / 2, self.top + self.height + 34, label)


def drawing(title: str, width: float, height: float, panels: Sequence[Panel]) -> str:
    head = f'<text x="{width / 2:.1f}" y="22" text-anchor="middle" font-size="15">{escape(title)}</text>'
    body = "\n".join(m for p in panels for m in p.marks)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}" font-family="sans-serif">\n<rect width="100%" height="100%" fill="#fff"/>\n{head}\n{body}\n</svg>\n'


def _saved(df: DataFrame, svg: str, save_path: str | None) -> str:
    if save_path is not None:
        write_text(df.sparkSession, str(save_path), svg)
    return svg


def violin_outline(df: DataFrame, feature: str, target: str, quantiles: int = 5, by_symbol: bool = True) -> DataFrame:
    """(quantile, value, density): the smoothed density of the target in each bucket, at ``POINTS`` values from its least to its greatest.

    Values are counted in ``BINS`` bins a bucket, which bounds what a bucket holds, and smoothed by normal kernels whose width is the bucket's
    deviation times the fifth root of one over its rows. A bucket with one value only has no outline.
    """
    rows = bucketed(pair_table(df, [feature], target), quantiles, by_symbol).filter("quantile is not null").select("quantile", "y")
    ends = rows.groupBy("quantile").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count("*").alias("n"), F.stddev_samp("y").alias("sd")).filter("high > low")
    step = (F.col("high") - F.col("low")) / BINS
    placed = rows.join(F.broadcast(ends), "quantile").withColumn("bin", F.least(F.floor((F.col("y") - F.col("low")) / step), F.lit(BINS - 1)))
    counted = placed.groupBy("quantile", "bin").agg(F.count("*").alias("c"))
    held = counted.groupBy("quantile").agg(F.sort_array(F.collect_list(F.struct("bin", "c"))).alias("bins")).join(ends, "quantile")
    width = F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))

    def at(i: Column) -> Column:
        return F.col("low") + (F.col("high") - F.col("low")) * i / F.lit(float(POINTS - 1))

    def density(i: Column) -> Column:
        def kernel(total: Column, b: Column) -> Column:
            z = (at(i) - F.col("low") - (b["bin"] + 0.5) * step) / width
            return total + b["c"] * F.exp(-z * z / 2)

        return F.aggregate("bins", F.lit(0.0), kernel) / (F.col("n") * width * math.sqrt(2 * math.pi))

    points = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.struct(at(i).alias("value"), density(i).alias("density")))
    return held.select("quantile", F.inline(points))


def _legend(panel: Panel, mean: float, more: Sequence[str] = ()) -> None:
    words = ["dot: mean", "bar: middle half", *more, f"dashed: all rows {mean * 100:.2f}%"]
    panel.text(panel.left + panel.width, panel.top - 8, "   ".join(words), "end", 10)


def violin_by_quantile(df: DataFrame, feature: str, target: str, *, quantiles: int = 5, as_percent: bool = True, save_path: str | None = None) -> str:
    """The target's distribution in each bucket of the feature: outline, middle half, median, mean and rows, beside the mean of all rows.

    A ValueError if no bucket can be formed.
    """
    check_quantiles(quantiles)
    marks = {r["quantile"]: r for r in violin_marks(df, feature, target, quantiles).collect()}
    if not marks:
        raise ValueError(f"No rows have both {feature!r} and {target!r}")
    outline: dict[int, list[tuple[float, float]]] = {}
    for r in violin_outline(df, feature, target, quantiles).orderBy("quantile", "value").collect():
        outline.setdefault(r["quantile"], []).append((r["value"], r["density"]))
    order, colour = sorted(marks), target_colour(target)
    everywhere = [v for points in outline.values() for v, _ in points] + [m[k] for m in marks.values() for k in ("percentile_10", "percentile_90")]
    panel = Panel((90, 60, 180 * len(order), 420), (-0.5, len(order) - 0.5), (min(everywhere), max(everywhere)))
    panel.y_axis(as_percent, target)
    mean = marks[order[0]]["overall_mean"]
    panel.line([(-0.5, mean), (len(order) - 0.5, mean)], RULE, 1.4, "overall", dashed=True)
    for i, q in enumerate(order):
        m, points = marks[q], outline.get(q, [])
        widest = max((d for _, d in points), default=1.0)
        sides = [(i - 0.4 * d / widest, v) for v, d in points] + [(i + 0.4 * d / widest, v) for v, d in reversed(points)]
        if sides:
            panel.area(sides, colour, 0.35, "violin")
        panel.line([(i, m["percentile_25"]), (i, m["percentile_75"])], colour, 6, "half", 0.8)
        panel.line([(i - 0.05, m["median"]), (i + 0.05, m["median"])], "#fff", 2.2, "median")
        panel.dot(i, m["mean"], RULE)
        panel.text(panel.x(i), panel.top + panel.height + 18, f"Q{q}")
        panel.text(panel.x(i), panel.top + panel.height + 32, f"n={m['observations']}")
    panel.text(panel.left + panel.width / 2, panel.top + panel.height + 54, f"{feature} quantile (Q1 = lowest values)")
    _legend(panel, mean)
    return _saved(df, drawing(f"{target} by {feature} quantile", panel.width + 130, 560, [panel]), save_path)


def spread_rows_by_state(df: DataFrame, features: Sequence[str], target: str, *, as_percent: bool = True, limits: tuple[float, float] | None = None,
                         save_path: str | None = None) -> str:
    """The target in the states of each feature, by symbol, on one axis: mean, middle half and 10th to 90th percentile, beside the mean of all rows."""
    if not features:
        raise ValueError("spread_rows_by_state needs at least one feature")
    rows = spread_by_state(df, list(features), target, by_symbol=True).collect()
    mean = overall_mean(df, target).first()["overall_mean"]
    found = {(r["feature"], r["state"]): r for r in rows}
    plan: list[tuple[str, str | None]] = []
    for f in features:
        plan += [(f, None), *((f, s) for s in STATES if (f, s) in found)]
    xs = limits or (min(r["percentile_10"] for r in rows), max(r["percentile_90"] for r in rows))
    panel = Panel((110, 60, 900, 32 * len(plan)), xs, (-len(plan), 0))
    panel.x_axis(as_percent, target)
    panel.line([(mean, -len(plan)), (mean, 0)], RULE, 1.4, "overall", dashed=True)
    for i, (f, state) in enumerate(plan):
        y = -i - 0.5
        if state is None:
            panel.text(panel.left + 4, panel.y(y) + 4, f, "start", 12, True)
            continue
        r, colour = found[f, state], STATE_COLOURS[state]
        panel.line([(r["percentile_10"], y), (r["percentile_90"], y)], colour, 1.5, "range", 0.6)
        panel.line([(r["percentile_25"], y), (r["percentile_75"], y)], colour, 7, "half", 0.55)
        panel.dot(r["mean"], y, colour)
        panel.text(panel.left - 6, panel.y(y) + 4, state, "end")
    _legend(panel, mean, ["line: 10th to 90th percentile"])
    return _saved(df, drawing(f"{target} by feature state", 1040, 120 + panel.height, [panel]), save_path)


def line_columns(rolled: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """(symbol, at, ic): a line's points for drawing, in order: the first, least, greatest and last of each of ``columns`` spans of time."""
    at = F.unix_micros(F.col("timestamp").cast("timestamp")).cast("double") / 1e6
    timed = rolled.select("symbol", at.alias("at"), "ic")
    ends = timed.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    span = ((ends["last"] or 0) - (ends["first"] or 0)) / columns or 1.0
    column = F.least(F.floor((F.col("at") - F.lit(ends["first"] or 0.0)) / F.lit(span)), F.lit(columns - 1))
    point = F.struct("at", "ic")
    four = timed.groupBy("symbol", column.alias("_column")).agg(
        F.array_sort(F.array_distinct(F.array(F.min(point), F.min_by(point, "ic"), F.max_by(point, "ic"), F.max(point)))).alias("p")
    )
    return four.select("symbol", F.inline("p")).orderBy("symbol", "at")


def rolling_ic_figure(df: DataFrame, features: Sequence[str], target: str, *, window: int, save_path: str | None = None) -> str:
    """Each feature's rolling rank coefficient through time in a panel of its own, a line a symbol; the side of zero opposite the whole sample's is shaded."""
    if not features:
        raise ValueError("rolling_ic_figure needs at least one feature")
    colour, drawn, panels = target_colour(target), [], []
    for f in features:
        lines: dict[str, list[tuple[float, float]]] = {}
        for r in line_columns(rolling_ic(df, f, target, window)).collect():
            lines.setdefault(r["symbol"], []).append((r["at"], r["ic"]))
        drawn.append((f, lines, panel_share(df, f, target, window).first()))
    times = [t for _, lines, _ in drawn for points in lines.values() for t, _ in points] or [0.0]
    xs = (min(times), max(times))
    for i, (f, lines, share) in enumerate(drawn):
        panel = Panel((70, 70 + 250 * i, 1300, 170), xs, (-1.05, 1.05))
        whole = share["full_ic"]
        if whole is not None:
            low, high = (0, 1.05) if whole < 0 else (-1.05, 0)
            panel.area([(panel.xs[0], low), (panel.xs[1], low), (panel.xs[1], high), (panel.xs[0], high)], LOW, 0.1, "reversed")
        panel.y_axis(False)
        panel.line([(panel.xs[0], 0), (panel.xs[1], 0)], RULE, 1.2, "zero")
        if whole is not None:
            panel.line([(panel.xs[0], whole), (panel.xs[1], whole)], RULE, 1.2, "overall", dashed=True)
        for symbol in sorted(lines, key=str):
            panel.line(lines[symbol], colour, 1.5, "ic", 0.9)
            last = lines[symbol][-1]
            panel.text(panel.x(last[0]) + 4, panel.y(last[1]) + 4, str(symbol), "start", 9)
        same = "" if share["share_same_sign"] is None else f", same sign in {share['share_same_sign']:.0%} of {share['windows']:,} windows"
        title = f"{f} against {target}   |   full sample {'none' if whole is None else format(whole, '+.3f')}{same}"
        panel.text(panel.left, panel.top - 8, title, "start", 11)
        panels.append(panel)
    panels[-1].text(720, panels[-1].top + 200, f"end of the trailing {window}-bar window")
    return _saved(df, drawing("Trailing rank IC of each feature; shaded where the sign is not that of the whole sample", 1440, 80 + 250 * len(panels), panels), save_path)
