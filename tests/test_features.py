import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barloom import FEATURES, compute_features, register_frame
from barloom.schema import BAR_SCHEMA


def walk(sizes, seed=3, step=dt.timedelta(hours=7)):
    rng = np.random.default_rng(seed)
    rows = []
    for symbol, n in sizes.items():
        close = 100 + np.cumsum(rng.normal(size=n))
        for i, c in enumerate(close):
            rows.append((symbol, dt.datetime(2024, 1, 1) + step * i, *map(float, (c + 0.1, c + 1.5, c - 1.2, c, rng.integers(1, 50)))))
    return rows


def frame(spark, rows, config):
    out = compute_features(spark.createDataFrame(rows, BAR_SCHEMA), {"features": config}).toPandas()
    return out.sort_values(["symbol", "timestamp"], ignore_index=True)


def items(*names, **params):
    return {"parameters": [{"name": n, "function": n, **params} for n in names]}


SIZES = {"A": 1, "B": 2, "C": 13, "D": 14, "E": 15, "F": 120}


@pytest.fixture(scope="module")
def rows():
    return walk(SIZES)


def expected(rows, f):
    pdf = pd.DataFrame(rows, columns=BAR_SCHEMA.names)
    return pd.concat([f(g) for _, g in pdf.groupby("symbol")], ignore_index=True).to_numpy(float)


def wilder(x, w):
    return x.ewm(alpha=1 / w, adjust=False, min_periods=w).mean()


def rsi(g):
    d = g.close.diff()
    up, down = wilder(d.clip(lower=0), 14), wilder((-d).clip(lower=0), 14)
    return 100 - 100 / (1 + up / down)


def atr(g):
    before = g.close.shift()
    return wilder(pd.concat([g.high - g.low, (g.high - before).abs(), (g.low - before).abs()], axis=1).max(axis=1), 14)


def macd(g):
    return g.close.ewm(span=12, adjust=False, min_periods=12).mean() - g.close.ewm(span=26, adjust=False, min_periods=26).mean()


def signal(g):
    return macd(g).dropna().ewm(span=9, adjust=False, min_periods=9).mean().reindex(g.index)


@pytest.mark.parametrize(
    ("name", "pandas"),
    [
        ("relative_strength_index", rsi), ("average_true_range", atr), ("macd_line", macd), ("macd_signal", signal),
        ("macd_histogram", lambda g: macd(g) - signal(g)), ("log_return", lambda g: np.log(g.close / g.close.shift())),
        ("rolling_standard_deviation", lambda g: np.log(g.close / g.close.shift()).rolling(19).std()),
        ("vwap", lambda g: ((g.high + g.low + g.close) / 3 * g.volume).cumsum() / g.volume.cumsum()),
        ("next_n_bar_realized_volatility", lambda g: np.log(g.close / g.close.shift()).rolling(20).std().shift(-20)),
    ],
)
def test_against_pandas(spark, rows, name, pandas):
    got = frame(spark, rows, items(name))[name].to_numpy(float)
    np.testing.assert_allclose(got, expected(rows, pandas), rtol=1e-9, atol=1e-12)


def test_flat_and_rising_closes(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("FLAT", start + dt.timedelta(days=i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(20)]
    rows += [("RISE", start + dt.timedelta(days=i), 5.0, 5.0, 5.0, 5.0 + i, 1.0) for i in range(20)]
    out = frame(spark, rows, items("relative_strength_index"))
    assert out[out.symbol == "FLAT"].relative_strength_index.isna().all()
    assert (out[out.symbol == "RISE"].relative_strength_index.dropna() == 100).all()


def test_session_reset_keeps_days_apart(spark):
    day = [dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 11), dt.datetime(2024, 1, 2, 10), dt.datetime(2024, 1, 2, 11)]
    rows = [("X", t, c, c, c, c, 1.0) for t, c in zip(day, (100.0, 102.0, 200.0, 204.0))]
    plain = frame(spark, rows, items("simple_return"))["simple_return"].tolist()
    reset = frame(spark, rows, items("simple_return") | {"reset_by_session": True})["simple_return"].tolist()
    assert plain[2] == pytest.approx(200 / 102 - 1)
    assert np.isnan(reset[2]) and reset[3] == pytest.approx(0.02)


def test_empty_bar_then_volume_is_infinite(spark):
    rows = [("X", dt.datetime(2024, 1, d), 1.0, 1.0, 1.0, 1.0, v) for d, v in ((1, 0.0), (2, 5.0), (3, 0.0), (4, 0.0))]
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    with pytest.raises(Exception, match="volume_change: feature produced infinite"):
        compute_features(bars, {"features": items("volume_change")}).collect()
    out = compute_features(bars, {"features": items("volume_change")}, on_infinite="null").orderBy("timestamp").toPandas()
    assert out.volume_change.isna().tolist() == [True, True, False, True]
    vw = frame(spark, rows, items("vwap"))["vwap"]
    assert np.isnan(vw[0]) and vw[1] == 1


def test_categories_and_names(spark, rows):
    bars = spark.createDataFrame(rows, BAR_SCHEMA)
    all_ = items("log_return", "next_n_bar_return", "moving_average")
    assert compute_features(bars, {"features": all_ | {"exclude_categories": ["target"]}}).columns == ["symbol", "timestamp", "log_return", "moving_average"]
    assert compute_features(bars, {"features": all_ | {"include_categories": ["trend"]}}).columns[2:] == ["moving_average"]
    with pytest.raises(ValueError, match="reserved identifier column"):
        compute_features(bars, {"features": {"parameters": [{"name": "symbol", "function": "log_return"}]}})
    with pytest.raises(ValueError, match="Duplicate feature column name"):
        compute_features(bars, {"features": {"parameters": [{"name": "a", "function": "log_return"}] * 2}})
    with pytest.raises(ValueError, match="window >= 3"):
        compute_features(bars, {"features": items("rolling_standard_deviation", window=2)})


def test_no_look_ahead_and_any_partitioning(spark, rows):
    names = [n for n, s in FEATURES.items() if s.category != "target"]
    whole = frame(spark, rows, items(*names))
    cut = frame(spark, [r for r in rows if r[1] < dt.datetime(2024, 1, 20)], items(*names))
    both = whole.merge(cut, on=["symbol", "timestamp"], suffixes=("", "_cut"))
    for n in names:
        np.testing.assert_allclose(both[n], both[f"{n}_cut"], rtol=1e-12)
    bars = spark.createDataFrame(rows, BAR_SCHEMA).repartition(17)
    other = compute_features(bars, {"features": items(*names)}).toPandas().sort_values(["symbol", "timestamp"], ignore_index=True)
    pd.testing.assert_frame_equal(whole, other)


def test_plan_has_one_exchange(spark, rows):
    names = [n for n, s in FEATURES.items() if s.kind == "column"]
    plan = compute_features(spark.createDataFrame(rows, BAR_SCHEMA), {"features": items(*names)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(
    ("result", "message"),
    [
        (lambda g: g.close.iloc[1:], "same length"), (lambda g: g.close.set_axis(g.index + 1), "same index"),
        (lambda g: g.close * np.inf, "infinite"), (lambda g: g.close.to_numpy(), "pandas Series"), (lambda g: g.symbol, "numeric"),
    ],
)
def test_frame_feature_contract(spark, rows, result, message):
    @register_frame("returns", 0, "a frame feature", "-")
    def own_feature(bars, factor=1):
        return result(bars)

    try:
        with pytest.raises(Exception, match=message):
            frame(spark, rows[:5], items("own_feature"))
    finally:
        del FEATURES["own_feature"]


def test_frame_feature_runs_beside_the_others(spark, rows):
    @register_frame("returns", 0, "a frame feature", "-")
    def doubled(bars, factor=1):
        return bars["close"] * factor

    try:
        out = frame(spark, rows, {"parameters": [{"name": "d", "function": "doubled", "factor": 2}, {"name": "m", "function": "macd_line"}]})
    finally:
        del FEATURES["doubled"]
    np.testing.assert_allclose(out.d, [2 * r[5] for r in sorted(rows, key=lambda r: r[:2])])


def test_recursions_in_batches_equal_one_bar_at_a_time():
    import math
    import random

    import numpy as np

    from barloom.features import smoothing

    rng = random.Random(43)
    groups = [[rng.uniform(1, 9) if rng.random() > 0.2 else math.nan for _ in range(rng.choice([1, 2, 3, 40, 200]))] for _ in range(30)]

    def plain(x, alpha, least):
        out, mean, weight, seen = [], math.nan, 1.0, 0
        for v in x:
            weight *= 1 - alpha
            if v == v:
                mean = v if not seen else (weight * mean + alpha * v) / (weight + alpha)
                weight, seen = 1.0, seen + 1
            out.append(mean if seen >= least else math.nan)
        return out

    x = np.array([v for g in groups for v in g])
    starts = np.zeros(len(x), bool)
    starts[np.cumsum([0, *(len(g) for g in groups[:-1])])] = True
    for alpha, least in ((2 / 13, 12), (1 / 14, 14), (1.0, 1), (2 / 3, 2)):
        want = [v for g in groups for v in plain(g, alpha, least)]
        for size in (1, 3, 64, len(x)):
            kernel = smoothing.Smoother(alpha, least)
            got = np.concatenate([kernel.run(x[a : a + size], starts[a : a + size]) for a in range(0, len(x), size)])
            assert np.allclose(got, want, rtol=1e-9, equal_nan=True)


def test_states_between_stretches_equal_one_pass():
    import math

    from barloom.features import smoothing

    rng = np.random.default_rng(8)
    for trial in range(40):
        x = np.where(rng.random(60) < rng.choice([0.05, 0.4, 0.9]), np.nan, rng.normal(size=60))
        if trial % 4 == 3:
            x[rng.integers(60, size=3)] = [math.inf, -math.inf, math.inf][trial % 3]
        starts = np.arange(60) == 0
        alpha = float(rng.choice([1.0, 0.5, 1 / 14]))
        want = smoothing.Smoother(alpha, 3).run(x, starts)
        cuts = [0, *sorted(rng.choice(np.arange(1, 60), 4, replace=False)), 60]
        state, got = smoothing.BLANK, []
        for a, b in zip(cuts, cuts[1:]):
            kernel = smoothing.Smoother(alpha, 3)
            got.append(kernel.run(x[a:b], np.arange(b - a) == 0, np.array([state])))
            one = smoothing.Stretch(alpha)
            for part in np.array_split(x[a:b], 3):
                one.absorb(part)
            state = smoothing.after(state, one.numbers(), alpha)
            assert np.allclose(state, kernel.state, rtol=1e-9, equal_nan=True)
        assert np.allclose(np.concatenate(got), want, rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("length", [7, 40, 10**6])
def test_one_long_symbol_over_many_tasks(spark, length):
    rows = walk({"LONG": 500, "SHORT": 3, "MID": 41})
    rows = [(*r[:5], None if i % 97 == 5 else r[5], None if i % 131 == 7 else r[6]) for i, r in enumerate(rows)]
    bars = spark.createDataFrame(rows, BAR_SCHEMA).repartition(3)
    config = {"features": items(*FEATURES)}
    whole, cut = (
        compute_features(bars, config, on_infinite="null", rows_per_task=n).toPandas().sort_values(["symbol", "timestamp"], ignore_index=True) for n in (10**6, length)
    )
    pd.testing.assert_frame_equal(whole, cut, rtol=1e-9)
    assert whole.notna().sum().min() > 250


@pytest.mark.parametrize("length", [10, 10**6])
@pytest.mark.parametrize("parts", ["1", "8"])
def test_infinite_prices_stay_in_their_group(spark, parts, length):
    rows = walk({"A": 40, "B": 40})
    rows[3] = (*rows[3][:3], float("inf"), *rows[3][4:])
    rows[20] = (*rows[20][:5], float("inf"), rows[20][6])
    names = [n for n, s in FEATURES.items() if s.kind == "recursive"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        bars = spark.createDataFrame(rows, BAR_SCHEMA)
        both = compute_features(bars, {"features": items(*names)}, "null", length).toPandas()
        alone = compute_features(bars.filter("symbol = 'B'"), {"features": items(*names)}, "null", length).toPandas()
        with pytest.raises(Exception, match="average_true_range: feature produced infinite"):
            compute_features(bars, {"features": items("average_true_range")}, rows_per_task=length).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    order = ["symbol", "timestamp"]
    b = both[both.symbol == "B"].sort_values(order, ignore_index=True)
    pd.testing.assert_frame_equal(b, alone.sort_values(order, ignore_index=True), rtol=1e-12)
    assert b.average_true_range.notna().sum() == 27 and both[both.symbol == "A"].average_true_range.notna().sum() == 0


def test_bounded_frame_features_over_stretches(spark):
    @register_frame("trend", lambda p: p.get("window", 5), "a frame feature", "-", bounded=True)
    def own_midrange(bars, window=5, most=10**6):
        if len(bars) > most:
            raise MemoryError("more bars than a stretch has")
        return (bars["high"].rolling(window).max() + bars["low"].rolling(window).min()) / 2

    @register_frame("trend", 0, "a frame feature of all bars", "-")
    def own_rank(bars):
        return bars["close"].rank()

    bars = spark.createDataFrame(walk({"LONG": 300, "SHORT": 3}), BAR_SCHEMA)
    config = {"features": {"parameters": [{"name": "timestamp_", "function": "own_rank"}, {"name": "m", "function": "own_midrange", "window": 9}, {"name": "r", "function": "macd_line"}]}}
    try:
        whole, cut = (compute_features(bars, config, rows_per_task=n).toPandas().sort_values(["symbol", "timestamp"], ignore_index=True) for n in (10**6, 50))
        alone = {"features": {"parameters": [{"name": "m", "function": "own_midrange", "window": 9, "most": 59}]}}
        assert compute_features(bars, alone, rows_per_task=50).filter("m is not null").count() == 292
        with pytest.raises(Exception, match="more bars than a stretch has"):
            compute_features(bars, alone).collect()
    finally:
        del FEATURES["own_midrange"], FEATURES["own_rank"]
    pd.testing.assert_frame_equal(whole, cut, rtol=1e-12)
    assert whole.m.notna().sum() == 292
