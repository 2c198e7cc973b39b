import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import (
    cross_sectional_ic, default_kernel_lags, evaluate_features, ic_summary, newey_west_regression, rolling_ic, target_by_feature_quantile,
    target_values_by_quantile, time_series_ic,
)
from barloom.evaluate import spread_by_state, state_rows

START = dt.datetime(2024, 1, 1)


def panel(symbols=("A", "B"), n=200, seed=7, slope=0.5):
    rng = np.random.default_rng(seed)
    parts = []
    for s in symbols:
        x = rng.normal(size=n)
        parts.append(pd.DataFrame({"symbol": s, "timestamp": [START + dt.timedelta(days=i) for i in range(n)], "signal": x, "noise": rng.normal(size=n),
                                   "fwd_target": slope * x + rng.normal(size=n)}))
    return pd.concat(parts, ignore_index=True)


def df(spark, pdf):
    out = spark.createDataFrame(pdf)
    return out.withColumn("timestamp", out["timestamp"].cast("timestamp_ntz"))


def driscoll_kraay(x, y, t, lags):
    X = np.column_stack([np.ones_like(x), x])
    bread = np.linalg.inv(X.T @ X)
    b = bread @ X.T @ y
    h = pd.DataFrame(X * (y - X @ b)[:, None]).groupby(t).sum().sort_index().to_numpy()
    s = h.T @ h
    for k in range(1, lags + 1):
        g = h[k:].T @ h[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    return b, np.sqrt(np.diag(bread @ s @ bread))


def test_regression_equals_numpy(spark):
    pdf = panel(("A", "B", "C"))
    got = newey_west_regression(df(spark, pdf), "signal", "fwd_target", kernel_lags=5)
    z = pdf.groupby("symbol").signal.transform(lambda v: (v - v.mean()) / v.std())
    b, se = driscoll_kraay(z.to_numpy(), pdf.fwd_target.to_numpy(), pdf.timestamp.to_numpy(), 5)
    assert got.beta == pytest.approx(b[1]) and got.alpha == pytest.approx(b[0]) and got.beta_standard_error == pytest.approx(se[1])
    assert got.p_value == pytest.approx(math.erfc(abs(b[1] / se[1]) / math.sqrt(2))) and got.observations == 600 and got.kernel_lags == 5


def test_a_copied_symbol_adds_no_evidence(spark):
    pdf = panel(("A",))
    one = newey_west_regression(df(spark, pdf), "signal", "fwd_target", kernel_lags=3)
    two = newey_west_regression(df(spark, pd.concat([pdf, pdf.assign(symbol="B")])), "signal", "fwd_target", kernel_lags=3)
    assert two.beta == pytest.approx(one.beta) and two.beta_standard_error == pytest.approx(one.beta_standard_error, rel=0.01)


def test_arguments(spark):
    d = df(spark, panel(n=30))
    for kw, message in (({"kernel_lags": -1}, "kernel_lags must be an integer >= 0"), ({"target_horizon_bars": True}, "target_horizon_bars must be an integer >= 1")):
        with pytest.raises(ValueError, match=message):
            newey_west_regression(d, "signal", "fwd_target", **kw)
    with pytest.raises(ValueError, match="quantiles must be an integer >= 2"):
        target_by_feature_quantile(d, "signal", "fwd_target", quantiles=1)
    with pytest.raises(ValueError, match="method"):
        time_series_ic(d, "signal", "fwd_target", method="kendall")
    assert [default_kernel_lags(100), default_kernel_lags(10), default_kernel_lags(100, target_horizon_bars=20)] == [4, 2, 19]


def test_coefficients_equal_pandas(spark):
    pdf = panel(tuple("ABCDEF"), n=40).round(1)
    pdf.loc[3, "signal"] = np.inf
    d, ok = df(spark, pdf), pdf.replace(np.inf, np.nan).dropna()
    for method in ("spearman", "pearson"):
        ts = {r.symbol: r.ic for r in time_series_ic(d, "signal", "fwd_target", method).collect()}

        def corr(g, method=method):
            a, b = (g.signal.rank(), g.fwd_target.rank()) if method == "spearman" else (g.signal, g.fwd_target)
            return a.corr(b)

        for s, g in ok.groupby("symbol"):
            assert ts[s] == pytest.approx(corr(g))
        xs = {r.timestamp: r.ic for r in cross_sectional_ic(d, "signal", "fwd_target", method, min_symbols=6).collect()}
        assert len(xs) == 39
        rolled = {(r.symbol, r.timestamp): r.ic for r in rolling_ic(d, "signal", "fwd_target", 10, method).collect()}
        assert len(rolled) == sum(len(g) - 9 for _, g in ok.groupby("symbol"))
        for s, g in ok.groupby("symbol"):
            for i in range(9, len(g)):
                assert rolled[s, g.timestamp.iloc[i].to_pydatetime()] == pytest.approx(corr(g.iloc[i - 9 : i + 1]))
    assert [r.ic for r in time_series_ic(df(spark, panel(n=20)), "signal", "fwd_target").collect()] == [None, None]
    row = ic_summary(spark.createDataFrame([(0.2,), (0.4,), (-0.3,), (None,)], "ic double")).first()
    assert (row["count"], row.share_positive) == (3, pytest.approx(2 / 3)) and row.information_ratio == pytest.approx(0.1 / np.std([0.2, 0.4, -0.3], ddof=1))
    assert ic_summary(spark.createDataFrame([], "ic double")).first()["count"] == 0


def test_buckets_equal_qcut_and_leave_out_tied_symbols(spark):
    pdf = panel(n=60)
    tied = panel(("TIED",), n=50)
    tied.loc[:39, "signal"] = 1.0
    with pytest.warns(UserWarning, match="TIED"):
        got = target_by_feature_quantile(df(spark, pd.concat([pdf, tied])), "signal", "fwd_target").toPandas()
    k = pdf.groupby("symbol").signal.transform(lambda v: pd.qcut(v, 5, labels=False) + 1)
    want = pdf.fwd_target.groupby(k).agg(["count", "mean", "median", "std"])
    np.testing.assert_allclose(got[["observations", "mean", "median", "standard_deviation"]].astype(float), want)
    values = target_values_by_quantile(df(spark, pdf), "signal", "fwd_target").toPandas()
    assert values.groupby("quantile").size().tolist() == [24] * 5
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="No rows have both"):
        target_by_feature_quantile(df(spark, tied), "signal", "fwd_target")


@pytest.mark.parametrize(
    ("values", "states"),
    [
        ([0, 1, 0, 1], ["off", "off", "on", "on"]), ([3, 3, 3], ["on"] * 3), ([1, 2, 3, 4, 5, 6], ["high", "high", "low", "low", "neutral", "neutral"]),
        ([0, 1, 5, 5, 5, 9, 10, 11], ["high"] * 3 + ["low"] * 5),
    ],
)
def test_states(spark, values, states):
    pdf = pd.DataFrame({"symbol": "A", "timestamp": [START + dt.timedelta(days=i) for i in range(len(values))], "f": np.array(values, float), "t": 1.0})
    assert sorted(r.state for r in state_rows(df(spark, pdf), "f", "t").collect()) == states


def test_no_pairs(spark):
    pdf = panel(n=5).assign(signal=np.nan)
    with pytest.raises(ValueError, match="No rows have both"):
        spread_by_state(df(spark, pdf), ["signal"], "fwd_target")
    with pytest.raises(ValueError, match="at least 3"):
        newey_west_regression(df(spark, pdf), "signal", "fwd_target")


def test_table_ranks_the_signal_first(spark):
    pdf = panel().assign(flat=1.0, empty=np.nan)
    got = evaluate_features(df(spark, pdf), "fwd_target", ["noise", "flat", "empty", "signal"]).toPandas()
    assert got.feature.tolist()[:2] == ["signal", "noise"] and got.observations.tolist() == [400, 400, 0, 0]
    assert got.p_value[0] < 1e-6 and got.quantile_spread[0] > 0 and np.isnan(got.beta[2])


def test_percentiles_of_large_and_small_groups(spark, monkeypatch):
    import numpy as np

    from barloom.evaluate import buckets

    rng = np.random.default_rng(41)
    groups = {"many": rng.normal(size=4000).round(2), "one": np.array([3.5]), "ties": np.array([1.0] * 900 + [2.0] * 100), "few": rng.normal(size=7)}
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, y double").repartition(5)
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    for most in (10_000, 50):  # sorted by one task, and over ranges of values
        monkeypatch.setattr(buckets, "WINDOW_ROWS", most)
        got = {r.g: (r.p, r.n) for r in buckets.percentile_table(rows, ["g"], "y", shares, n=F.count("*")).collect()}
        assert set(got) == set(groups)
        for g, x in groups.items():
            assert got[g][0] == pytest.approx([float(np.quantile(x, q)) for q in shares]) and got[g][1] == len(x)


def test_rolling_ranks_across_batches(spark):
    import numpy as np
    import pyarrow as pa

    from barloom.evaluate import ic

    rng = np.random.default_rng(42)
    rows = [(s, i, float(rng.integers(6)), float(rng.normal())) for s in "abc" for i in range({"a": 50, "b": 4, "c": 23}[s])]
    table = pa.table({"symbol": [r[0] for r in rows], "timestamp": [r[1] for r in rows], "x": [r[2] for r in rows], "y": [r[3] for r in rows]})
    found = [[(r["symbol"], r["timestamp"], r["ic"]) for b in ic._roll(table.to_batches(max_chunksize=size), 6) for r in b.to_pylist()] for size in (1, 7, 1000)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 45 + 18
    ranks = ic.window_ranks(np.array([[3.0, 1.0, 3.0, 2.0]]))
    assert ranks.tolist() == [[2.5, 0.0, 2.5, 1.0]]


@pytest.mark.parametrize("rows", [10**6, 20])
def test_long_symbols_over_many_tasks(spark, monkeypatch, rows):
    from barloom.evaluate import buckets, ic, places

    for module, name in ((ic, "TASK_ROWS"), (places, "TASK_ROWS"), (buckets, "WINDOW_ROWS")):
        monkeypatch.setattr(module, name, rows)
    pdf = panel(("A", "B", "C"), n=90).round(1)
    pdf = pd.concat([pdf, panel(("D",), n=7)], ignore_index=True)
    pdf.loc[pdf.symbol == "C", "signal"] = [1.0, 2.0, 3.0] * 30
    d = df(spark, pdf)
    for method in ("spearman", "pearson"):
        for window in (5, 30):
            got = {(r.symbol, r.timestamp.toordinal()): r.ic for r in rolling_ic(d, "signal", "fwd_target", window, method).collect()}
            want = {}
            for s, g in pdf.groupby("symbol"):
                for i in range(window - 1, len(g)):
                    part = g.iloc[i - window + 1 : i + 1]
                    a, b = (part.signal.rank(), part.fwd_target.rank()) if method == "spearman" else (part.signal, part.fwd_target)
                    if a.std() > 0 and b.std() > 0:
                        want[s, part.timestamp.iloc[-1].toordinal()] = a.corr(b)
            assert got == pytest.approx(want)
    ts = {r.symbol: r.ic for r in time_series_ic(d, "signal", "fwd_target", min_observations=2).collect()}
    assert ts == pytest.approx({s: g.signal.rank().corr(g.fwd_target.rank()) for s, g in pdf.groupby("symbol")})
    with pytest.warns(UserWarning, match="C"):
        found = target_by_feature_quantile(d, "signal", "fwd_target").toPandas()
    ok = pdf[pdf.symbol != "C"]
    k = ok.groupby("symbol").signal.transform(lambda v: pd.qcut(v, 5, labels=False) + 1)
    want = ok.fwd_target.groupby(k).agg(["count", "mean", "median", "std"])
    np.testing.assert_allclose(found[["observations", "mean", "median", "standard_deviation"]].astype(float), want)


def test_rolling_kernels_equal_plain_ones(monkeypatch):
    from barloom.evaluate import rolling

    rng = np.random.default_rng(12)
    monkeypatch.setattr(rolling, "SMALL", 1)
    for n, window, kinds in ((300, 70, 10**6), (200, 100, 4), (130, 129, 9), (129, 129, 9), (100, 2, 3), (50, 65, 3), (90, 30, 2)):
        x, y = (rng.integers(0, kinds, n).astype(float) for _ in "xy")
        x[n // 2 :] = 1.0
        pairs = [(x[i : i + window], y[i : i + window]) for i in range(n - window + 1)]

        def corr(a, b):
            return np.corrcoef(a, b)[0, 1] if a.std() > 0 and b.std() > 0 else math.nan

        np.testing.assert_allclose(rolling.rolling_rank_correlation(x, y, window), [corr(pd.Series(a).rank(), pd.Series(b).rank()) for a, b in pairs], atol=1e-12)
        np.testing.assert_allclose(rolling.rolling_correlation(x, y, window), [corr(a, b) for a, b in pairs], atol=1e-12)


def test_rolling_correlation_of_windows_that_hardly_vary():
    from barloom.evaluate import rolling

    rng = np.random.default_rng(13)
    small = rng.integers(-9, 9, 300) * 2.0**-30
    x, y = np.concatenate([rng.normal(size=50) * 1e6, 2.0**20 + small]), rng.normal(size=350)
    got = rolling.rolling_correlation(x, y, 20)
    np.testing.assert_allclose(got[50:], [np.corrcoef(small[i : i + 20], y[50 + i : 70 + i])[0, 1] for i in range(281)], rtol=1e-9)


@pytest.mark.parametrize("standardize", [True, False])
@pytest.mark.parametrize("lags", [0, 1, 7, 500])
def test_kernel_sums_for_any_number_of_lags(spark, lags, standardize):
    pdf = pd.concat([panel(("A", "B"), n=60), panel(("C",), n=25), panel(("FLAT",), n=10).assign(signal=3.0)], ignore_index=True)
    got = newey_west_regression(df(spark, pdf), "signal", "fwd_target", kernel_lags=lags, standardize=standardize)
    used = pdf[pdf.symbol != "FLAT"] if standardize else pdf
    x = used.groupby("symbol").signal.transform(lambda v: (v - v.mean()) / v.std()) if standardize else used.signal
    b, se = driscoll_kraay(x.to_numpy(), used.fwd_target.to_numpy(), used.timestamp.to_numpy(), min(lags, 59))
    assert got.beta == pytest.approx(b[1]) and got.alpha == pytest.approx(b[0]) and got.beta_standard_error == pytest.approx(se[1])
    assert got.effective_lags == min(lags, 59) and got.observations == len(used)
    assert got.r_squared == pytest.approx(np.corrcoef(x, used.fwd_target)[0, 1] ** 2)


def test_streams_in_small_batches_give_the_same(spark):
    d = df(spark, panel(("A", "B"), n=80))
    whole = newey_west_regression(d, "signal", "fwd_target", kernel_lags=9), rolling_ic(d, "signal", "fwd_target", 12).orderBy("symbol", "timestamp").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        cut = newey_west_regression(d, "signal", "fwd_target", kernel_lags=9), rolling_ic(d, "signal", "fwd_target", 12).orderBy("symbol", "timestamp").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cut[0].beta_standard_error == pytest.approx(whole[0].beta_standard_error) and cut[1] == whole[1]
