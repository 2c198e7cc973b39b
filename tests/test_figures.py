"""Marks of the figures against the tables they are drawn from."""

import datetime as dt
import re
from xml.dom.minidom import parseString

import numpy as np
import pandas as pd
import pytest

from barloom.evaluate import figures, rolling_ic_figure, spread_rows_by_state, violin_by_quantile

from .test_evaluate import df, panel


def marks(svg, kind):
    parseString(svg)  # well-formed
    return re.findall(rf'class="{kind}"', svg)


def texts(svg):
    return re.findall(r"<text[^>]*>([^<]*)</text>", svg)


def test_violins(spark, tmp_path):
    d = df(spark, panel(n=100))
    path = str(tmp_path / "violin.svg")
    svg = violin_by_quantile(d, "signal", "fwd_target", save_path=path)
    assert open(path).read() == svg
    assert [len(marks(svg, k)) for k in ("violin", "half", "median", "mean", "overall", "spine")] == [5, 5, 5, 5, 1, 1]
    found = texts(svg)
    assert {"Q1", "Q5", "n=40", "fwd_target by signal quantile"} <= set(found) and any(re.fullmatch(r"-?\d+\.\d%", t) for t in found)
    assert figures.HIGH in svg and figures.VOLATILITY not in svg
    green = violin_by_quantile(d.withColumnRenamed("fwd_target", "next_volatility"), "signal", "next_volatility", quantiles=2, as_percent=False)
    assert figures.VOLATILITY in green and len(marks(green, "violin")) == 2 and not any(re.fullmatch(r"-?\d+\.\d%", t) for t in texts(green))
    with pytest.raises(ValueError, match="No rows have both"):
        violin_by_quantile(df(spark, panel(n=5).assign(signal=np.nan)), "signal", "fwd_target")


def test_outline_is_the_density_of_the_values(spark):
    pdf = panel(("A",), n=400)
    got = figures.violin_outline(df(spark, pdf), "signal", "fwd_target", 2).toPandas()
    k = pd.qcut(pdf.signal, 2, labels=False) + 1
    for q, g in got.groupby("quantile"):
        v = pdf.fwd_target[k == q].to_numpy()
        width = v.std(ddof=1) * len(v) ** -0.2
        g = g.sort_values("value")
        assert len(g) == figures.POINTS and (g.value.iloc[0], g.value.iloc[-1]) == (pytest.approx(v.min()), pytest.approx(v.max()))
        want = np.exp(-(((g.value.to_numpy()[:, None] - v[None, :]) / width) ** 2) / 2).sum(1) / (len(v) * width * np.sqrt(2 * np.pi))
        np.testing.assert_allclose(g.density, want, atol=0.01 * want.max())


def test_states_and_flags(spark):
    pdf = panel(n=60).assign(flag=lambda p: (p.signal > 0).astype(float), tied=lambda p: np.where(p.index % 10 < 8, 1.0, p.signal))
    svg = spread_rows_by_state(df(spark, pdf), ["signal", "flag", "tied"], "fwd_target", limits=(-2, 2))
    found = [t for t in texts(svg) if t in figures.STATE_COLOURS]
    assert found[:5] == ["low", "neutral", "high", "off", "on"] and len(found) >= 6
    assert len(marks(svg, "half")) == len(marks(svg, "range")) == len(marks(svg, "mean")) == len(found)
    assert {"signal", "flag", "tied"} <= set(texts(svg)) and len(marks(svg, "overall")) == 1
    with pytest.raises(ValueError, match="at least one feature"):
        spread_rows_by_state(df(spark, pdf), [], "fwd_target")


def test_states_of_each_symbol(spark):
    from barloom.evaluate import state_rows

    a, b = panel(("A",), n=30), panel(("B",), n=30).assign(signal=lambda p: p.signal + 100)
    got = sorted(r.state for r in state_rows(df(spark, pd.concat([a, b])), "signal", "fwd_target", True).collect())
    assert got == ["high"] * 20 + ["low"] * 20 + ["neutral"] * 20


def test_rolling_lines(spark, tmp_path):
    pdf = panel(("A", "B"), n=80)
    path = str(tmp_path / "rolling.svg")
    svg = rolling_ic_figure(df(spark, pdf), ["signal", "noise"], "fwd_target", window=20, save_path=path)
    assert open(path).read() == svg
    assert [len(marks(svg, k)) for k in ("ic", "zero", "overall", "reversed", "spine")] == [4, 2, 2, 2, 2]
    points = [len(p.split()) for p in re.findall(r'class="ic" points="([^"]*)"', svg)]
    assert points == [61] * 4
    assert any(re.search(r"signal against fwd_target .* full sample \+0\.\d+, same sign in \d+% of 122 windows", t) for t in texts(svg))
    few = figures.line_columns(spark.createDataFrame([("A", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float(i % 7)) for i in range(700)], "symbol string, timestamp timestamp_ntz, ic double"), 10)
    rows = few.collect()
    assert 20 <= len(rows) <= 40 and {r.ic for r in rows} >= {0.0, 6.0} and rows[0].at < rows[-1].at
    with pytest.raises(ValueError, match="at least one feature"):
        rolling_ic_figure(df(spark, pdf), [], "fwd_target", window=5)


def test_ticks():
    assert figures.ticks(0, 1) == [0, 0.2, 0.4, 0.6, 0.8, 1.0] and figures.ticks(-0.031, 0.02) == [-0.03, -0.02, -0.01, 0, 0.01, 0.02] and figures.ticks(3, 3) == [3]
