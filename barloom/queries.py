"""Registered queries of the bar engine and the SQL that checks them.

Bars come from the events table (a symbol per event type), dirty bars from lineitem. Doubles are rounded to 6
places on both sides where sums are taken in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cli import run_pipeline
from .compute import apply_features, compute_features
from .evaluate import buckets, cross_sectional_ic, evaluate_features, ic_summary, rolling_ic, target_by_feature_quantile, time_series_ic
from .evaluate.figures import violin_outline
from .evaluate.pairs import pair_table
from .evaluate.regression import regression_table, zscored
from .evaluate.states import overall_mean, panel_share, rolling_ic_panels, spread_by_state, state_rows, violin_marks
from .features import FeatureSpec
from .quality import clean_rows, rule_counts
from .schema import bars_from_events, in_session
from .shared import shared_dir
from .sinks import feature_health, load_features, rows_per_symbol, save_features
from .sources import duplicate_bars, filter_bars, finalize_bars, normalize_timestamp, to_number

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    return bars_from_events(_table(spark, sf_dir, "events"), unit)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _query(name: str, sql: str, exact: bool = False):
    def add(f: Query) -> Query:
        QUERIES[name] = f if exact else lambda spark, sf_dir: _rounded(f(spark, sf_dir))
        ORACLE_SQL[name] = sql
        return f

    return add


def _bars_cte(unit: str = "hour") -> str:
    return f"""bars AS (SELECT event_type AS symbol, date_trunc('{unit}', ts) AS "timestamp", arg_min(value, ts) AS open, max(value) AS high,
      min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""


BAR_COLUMNS = 'symbol, "timestamp", open, high, low, close, volume'

# Sources and filters


def _bar_query(name: str, where: str, build: Callable[[DataFrame], DataFrame], unit: str = "hour") -> None:
    _query(name, f"WITH {_bars_cte(unit)} SELECT {BAR_COLUMNS} FROM bars WHERE {where}", exact=True)(lambda s, d: build(_bars(s, d, unit)))


MINUTES = 'hour("timestamp") * 60 + minute("timestamp")'
_bar_query("bars_hourly", "true", lambda b: b)
_bar_query("bars_daily", "true", lambda b: b, "day")
_bar_query("filter_symbol", "symbol IN ('click', 'purchase')", lambda b: filter_bars(b, {"symbols": ["click", "purchase"]}))
_bar_query(
    "filter_date_range", """"timestamp" >= DATE '2024-01-05' AND "timestamp" < DATE '2024-01-21'""",
    lambda b: filter_bars(b, {"start_date": "2024-01-05", "end_date": "2024-01-20"}),
)
_bar_query("session_regular", f"{MINUTES} BETWEEN 570 AND 959", lambda b: in_session(b, "regular"))
_bar_query("session_extended", f"{MINUTES} BETWEEN 240 AND 1199", lambda b: in_session(b, "extended"))
_bar_query("session_full", "true", lambda b: in_session(b, "full"))

# Loading from text


def _text_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars as a CSV file would hold them: padded symbols, instants in UTC, numbers as text, every 24th close blank."""
    bars, at = _bars(spark, sf_dir), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    return bars.select(
        F.concat(F.lit("  "), "symbol", F.lit("\t")).alias("symbol"), F.when(F.hour("timestamp") < 12, F.concat(at, F.lit("Z"))).otherwise(F.concat(at, F.lit("+00:00"))).alias("timestamp"),
        *(F.col(c).cast("string").alias(c) for c in ("open", "high", "low")), F.when(F.hour("timestamp") == 3, " ").otherwise(F.col("close").cast("string")).alias("close"),
        F.concat(F.lit(" "), F.col("volume").cast("long").cast("string")).alias("volume"), F.lit("x").alias("extra"),
    )


# the events lie in January: New York is five hours behind
_query("load_text_bars", f"""WITH {_bars_cte()} SELECT symbol, "timestamp" - INTERVAL 5 HOUR AS "timestamp", open, high, low,
CASE WHEN hour("timestamp") <> 3 THEN close END AS close, volume FROM bars""", exact=True)(lambda s, d: finalize_bars(_text_bars(s, d), "America/New_York"))
_query("normalize_timestamps", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) - INTERVAL 5 HOUR WHEN 1 THEN date_trunc('second', ts) - INTERVAL 7 HOUR
WHEN 2 THEN date_trunc('second', ts) END AS "timestamp" FROM events""", exact=True)(
    lambda s, d: _table(s, d, "events").select("event_id", normalize_timestamp(_text_time(), "string", "America/New_York").alias("timestamp"))
)


def _text_time():
    """An instant in UTC, one two hours east, a local time, and no time at all."""
    k, at = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return F.when(k == 0, F.concat(at, F.lit("Z"))).when(k == 1, F.concat(F.lit(" "), at, F.lit("+02:00"))).when(k == 2, at).otherwise(F.concat(F.lit("no "), at))


def _text_number():
    k, n = F.col("l_orderkey") % 8, F.col("l_quantity").cast("int").cast("string")
    forms = [n, F.concat(F.lit(" "), n, F.lit(".50 ")), F.concat(F.lit("-"), n, F.lit("e2")), F.concat(n, F.lit("d")), F.concat(F.lit("1,"), n), F.lit(""), F.lit("inf"), F.lit("NaN")]
    text = F.when(k == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        text = text.when(k == i, form)
    return text


_query("coerce_numbers", """SELECT l_orderkey, l_linenumber, CASE l_orderkey % 8 WHEN 0 THEN q WHEN 1 THEN q + 0.5 WHEN 2 THEN -100 * q END AS number
FROM (SELECT *, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS q FROM lineitem)""", exact=True)(
    lambda s, d: _table(s, d, "lineitem").select("l_orderkey", "l_linenumber", to_number(_text_number(), "string").alias("number"))
)

# Cleaning


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem")
    k, p = F.col("l_orderkey") % 20, F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")
    return line.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp"),
        F.when(k.isin(1, 6), -p).otherwise(p).alias("open"), F.when(k == 3, p * 0.98).otherwise(p * 1.02).alias("high"),
        F.when(k == 3, p * 1.02).otherwise(p * 0.98).alias("low"), F.when(k == 4, p * 2).when(k != 0, p * 1.01).alias("close"),
        F.when(k.isin(2, 6), -F.col("l_quantity").cast("double")).otherwise(F.col("l_quantity").cast("double")).alias("volume"),
    )


DIRTY = """dirty AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS TIMESTAMP) AS "timestamp",
  CASE WHEN k IN (1, 6) THEN -p ELSE p END AS open, CASE WHEN k = 3 THEN p * 0.98::DOUBLE ELSE p * 1.02::DOUBLE END AS high,
  CASE WHEN k = 3 THEN p * 1.02::DOUBLE ELSE p * 0.98::DOUBLE END AS low,
  CASE WHEN k = 4 THEN p * 2 WHEN k <> 0 THEN p * 1.01::DOUBLE END AS close, CASE WHEN k IN (2, 6) THEN -q ELSE q END AS volume
  FROM (SELECT *, l_orderkey % 20 AS k, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS p FROM lineitem))"""
RULE_SQL = [
    ("drop_missing_numeric_values", "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL"),
    ("drop_zero_prices", "open <= 0 OR high <= 0 OR low <= 0 OR close <= 0"),
    ("drop_negative_volume", "volume < 0"),
    ("drop_high_lt_low", "high < low"),
    ("drop_ohlc_violations", "open < low OR open > high OR close < low OR close > high"),
]


def _rule_case(*off: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in RULE_SQL if n not in off) + " END"


_query("clean_rows", f"WITH {DIRTY} SELECT {BAR_COLUMNS} FROM dirty WHERE ({_rule_case()}) IS NULL", exact=True)(lambda s, d: clean_rows(_dirty(s, d)))
_query("clean_report", f"WITH {DIRTY} SELECT {_rule_case()} AS rule, count(*) AS bars FROM dirty GROUP BY 1")(lambda s, d: rule_counts(_dirty(s, d)))
_query("clean_rule_disabled", f"WITH {DIRTY} SELECT {_rule_case('drop_zero_prices')} AS rule, count(*) AS bars FROM dirty GROUP BY 1")(
    lambda s, d: rule_counts(_dirty(s, d), {"drop_zero_prices": False})
)
_query("duplicate_bars", f'WITH {DIRTY} SELECT symbol, "timestamp", count(*) AS bars FROM dirty GROUP BY 1, 2 HAVING count(*) > 1')(lambda s, d: duplicate_bars(_dirty(s, d)))

# Features

BY_SYMBOL = 'PARTITION BY symbol ORDER BY "timestamp"'
BY_DAY = 'PARTITION BY symbol, CAST("timestamp" AS DATE) ORDER BY "timestamp"'


def _full(statistic: str, value: str, first: int, last: int, by: str = BY_SYMBOL) -> str:
    def bound(n: int) -> str:
        return "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"

    over = f"OVER ({by} ROWS BETWEEN {bound(first)} AND {bound(last)})"
    return f"CASE WHEN count({value}) {over} = {last - first + 1} THEN {statistic}({value}) {over} END"


def _feature_sql(by: str = BY_SYMBOL) -> dict[str, tuple[str, dict[str, int], str]]:
    lag, lead = (lambda c, n: f"lag({c}, {n}) OVER ({by})"), (lambda c, n: f"lead({c}, {n}) OVER ({by})")
    vwap = f"sum((high + low + close) / 3 * volume) OVER ({by} ROWS UNBOUNDED PRECEDING) / nullif(sum(volume) OVER ({by} ROWS UNBOUNDED PRECEDING), 0)"
    mean = _full("avg", "close", -19, 0, by)
    return {
        "log_return": ("log_return", {}, "r"),
        "simple_return": ("simple_return", {}, f"close / nullif({lag('close', 1)}, 0) - 1"),
        "next_n_bar_return": ("next_n_bar_return", {"bars": 1}, f"{lead('close', 1)} / nullif(close, 0) - 1"),
        "next_n_bar_realized_volatility": ("next_n_bar_realized_volatility", {"bars": 20}, _full("stddev_samp", "r", 1, 20, by)),
        "moving_average": ("moving_average", {"window": 20}, mean),
        "price_vs_moving_average": ("price_vs_moving_average", {"window": 20}, f"close / nullif({mean}, 0) - 1"),
        "rate_of_change": ("rate_of_change", {"periods": 20}, f"close / nullif({lag('close', 20)}, 0) - 1"),
        "rolling_standard_deviation": ("rolling_standard_deviation", {"window": 20}, _full("stddev_samp", "r", -18, 0, by)),
        "bar_range_percent": ("bar_range_percent", {}, "(high - low) / nullif(close, 0)"),
        "volume_ratio": ("volume_ratio", {"window": 20}, f"volume / nullif({_full('avg', 'volume', -19, 0, by)}, 0)"),
        "dollar_volume": ("dollar_volume", {}, "close * volume"),
        "volume_change": ("volume_change", {}, f"volume / nullif({lag('volume', 1)}, 0) - 1"),
        "vwap": ("vwap", {}, vwap),
        "price_vs_vwap": ("price_vs_vwap", {}, f"close / nullif({vwap}, 0) - 1"),
    }


def _features(spark: SparkSession, sf_dir: str, items: list[dict[str, Any]], **more: Any) -> DataFrame:
    return compute_features(_bars(spark, sf_dir), {"features": {"parameters": items, **more}})


def _returns_cte(by: str = BY_SYMBOL) -> str:
    ratio = f"close / nullif(lag(close) OVER ({by}), 0)"
    return f"{_bars_cte()}, b AS (SELECT *, CASE WHEN {ratio} > 0 THEN ln({ratio}) END AS r FROM bars)"


def _select_features(columns: dict[str, str], by: str = BY_SYMBOL) -> str:
    cells = ", ".join(f"round({sql}, 6) AS {name}" for name, sql in columns.items())
    return f'WITH {_returns_cte(by)} SELECT symbol, "timestamp", {cells} FROM b'


PLAIN = _feature_sql()
for _name, (_function, _params, _sql) in PLAIN.items():
    _item = {"name": _name, "function": _function, **_params}
    _query(_name, _select_features({_name: _sql}))(lambda s, d, item=_item: _features(s, d, [item]))

DAILY = _feature_sql(BY_DAY)
for _name in ("moving_average", "vwap", "log_return"):
    _short = 5 if _name == "moving_average" else None
    _item = {"name": _name, "function": _name, **({"window": 5} if _short else {})}
    _sql = _full("avg", "close", -4, 0, BY_DAY) if _short else DAILY[_name][2]
    _query(f"{_name}_session_reset", _select_features({_name: _sql}, BY_DAY))(lambda s, d, item=_item: _features(s, d, [item], reset_by_session=True))

# Recursive features, by recursive SQL

NUMBERED = f"{_bars_cte()}, b AS (SELECT *, row_number() OVER w AS rn, close - lag(close) OVER w AS change, lag(close) OVER w AS before FROM bars WINDOW w AS ({BY_SYMBOL}))"


def _recursion(cte: str, seed: str, start: str, values: list[tuple[str, str, float]]) -> str:
    """A recursive CTE: each (name, source, alpha) moves to its source by alpha."""
    first = ", ".join(f"CAST({source} AS DOUBLE) AS {name}" for name, source, _ in values)
    later = ", ".join(f"e.{name} + CAST({alpha!r} AS DOUBLE) * ({source} - e.{name})" for name, source, alpha in values)
    return f"{cte} AS (SELECT symbol, rn, {first} FROM {seed} x WHERE rn = {start} UNION ALL SELECT x.symbol, x.rn, {later} FROM {cte} e JOIN {seed} x ON x.symbol = e.symbol AND x.rn = e.rn + 1)"


RSI_SQL = f"""WITH RECURSIVE {NUMBERED}, {_recursion('s', 'b', '2', [('up', 'greatest(x.change, 0)', 1 / 14), ('down', 'greatest(-x.change, 0)', 1 / 14)])}
SELECT b.symbol, b."timestamp", round(CASE WHEN b.rn < 15 OR (s.up = 0 AND s.down = 0) THEN NULL WHEN s.down = 0 THEN 100 ELSE 100 - 100 / (1 + s.up / s.down) END, 6) AS rsi
FROM b LEFT JOIN s USING (symbol, rn)"""
ATR_SQL = f"""WITH RECURSIVE {NUMBERED}, {_recursion('s', 'b', '1', [('atr', 'greatest(x.high - x.low, coalesce(abs(x.high - x.before), 0), coalesce(abs(x.low - x.before), 0))', 1 / 14)])}
SELECT b.symbol, b."timestamp", round(CASE WHEN b.rn >= 14 THEN s.atr END, 6) AS atr FROM b LEFT JOIN s USING (symbol, rn)"""
MACD_CTES = f"""{NUMBERED}, {_recursion('s', 'b', '1', [('fast', 'x.close', 2 / 13), ('slow', 'x.close', 2 / 27)])},
l AS (SELECT symbol, rn, fast - slow AS line FROM s WHERE rn >= 26), {_recursion('g', 'l', '26', [('signal', 'x.line', 2 / 10)])}"""


def _macd_sql(name: str, value: str) -> str:
    return f"""WITH RECURSIVE {MACD_CTES} SELECT b.symbol, b."timestamp", round({value}, 6) AS {name}
FROM b LEFT JOIN l USING (symbol, rn) LEFT JOIN g USING (symbol, rn)"""


_SIGNAL = "CASE WHEN b.rn >= 34 THEN g.signal END"
RECURSIVE = {
    "rsi": ("relative_strength_index", RSI_SQL),
    "atr": ("average_true_range", ATR_SQL),
    "macd_line": ("macd_line", _macd_sql("macd_line", "l.line")),
    "macd_signal": ("macd_signal", _macd_sql("macd_signal", _SIGNAL)),
    "macd_histogram": ("macd_histogram", _macd_sql("macd_histogram", f"l.line - ({_SIGNAL})")),
}
for _name, (_function, _sql) in RECURSIVE.items():
    _query(_name, _sql)(lambda s, d, item={"name": _name, "function": _function}: _features(s, d, [item]))

# Selection by category

ITEMS = [{"name": n, "function": f, **p} for n, (f, p, _) in PLAIN.items()]
TARGETS = ("next_n_bar_return", "next_n_bar_realized_volatility")
TREND = ("moving_average", "price_vs_moving_average", "rate_of_change")
EVERY = [*ITEMS, *({"name": n, "function": f} for n, (f, _) in RECURSIVE.items())]
_query("features_window", _select_features({n: q for n, (_, _, q) in PLAIN.items()}))(lambda s, d: _features(s, d, ITEMS))
_query("features_all", f"""SELECT * FROM ({_select_features({n: q for n, (_, _, q) in PLAIN.items()})}) """ + " ".join(
    f'JOIN ({q}) USING (symbol, "timestamp")' for _, q in RECURSIVE.values()
))(lambda s, d: _features(s, d, EVERY))


def _midrange(frame, window: int = 5):
    """A pandas feature as a user would add it: the middle of the highest high and the lowest low."""
    return (frame["high"].rolling(window).max() + frame["low"].rolling(window).min()) / 2


MIDRANGE = FeatureSpec("midrange", _midrange, "trend", lambda p: p["window"], "Middle of the range.", "(max high + min low) / 2", "frame", {}, {})
_query("feature_user_frame", _select_features({"midrange": f"({_full('max', 'high', -4, 0)} + {_full('min', 'low', -4, 0)}) / 2"}))(
    lambda s, d: apply_features(_bars(s, d), [("midrange", MIDRANGE, {"window": 5})])
)
_query("features_no_targets", _select_features({n: q for n, (_, _, q) in PLAIN.items() if n not in TARGETS}))(
    lambda s, d: _features(s, d, ITEMS, exclude_categories=["target"])
)
_query("features_trend_only", _select_features({n: PLAIN[n][2] for n in TREND}))(lambda s, d: _features(s, d, ITEMS, include_categories=["trend"]))

# Health of a feature table


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three features and the next bar's return."""
    names = ("log_return", "price_vs_moving_average", "volume_ratio", "next_n_bar_return")
    return _features(spark, sf_dir, [i for i in ITEMS if i["name"] in names]).withColumnRenamed("next_n_bar_return", "fwd")


FRAME_COLUMNS = ("log_return", "price_vs_moving_average", "volume_ratio")
FRAME = (
    f'{_returns_cte()}, frame AS (SELECT symbol, "timestamp", '
    + ", ".join(f"{PLAIN[n][2]} AS {n}" for n in FRAME_COLUMNS)
    + f", {PLAIN['next_n_bar_return'][2]} AS fwd FROM b)"
)
_query("rows_per_symbol", f"WITH {FRAME} SELECT symbol, count(*) AS rows FROM frame GROUP BY 1")(lambda s, d: rows_per_symbol(_frame(s, d)))
_query("feature_health", f"WITH {FRAME} " + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, count(*) - count({n}) AS null_count, round((count(*) - count({n})) / count(*), 4) AS null_pct, round(min({n}), 6) AS min, "
    f"round(avg({n}), 6) AS mean, round(max({n}), 6) AS max FROM frame" for n in (*FRAME_COLUMNS, "fwd")
))(lambda s, d: feature_health(_frame(s, d)))

# Runs: stored and read back

RUN_ITEMS = [i for i in ITEMS if i["name"] in FRAME_COLUMNS]
_CELLS = ", ".join(f"round({n}, 6) AS {n}" for n in FRAME_COLUMNS)


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/barloom/runs-{uuid.uuid4().hex}"


def _saved(spark: SparkSession, sf_dir: str, kind: str = "parquet") -> dict[str, str]:
    config = {"run": {"output_dir": _run_dir(spark), "output_formats": [kind]}, "features": {"parameters": RUN_ITEMS}}
    return save_features(compute_features(_bars(spark, sf_dir), config), config)


def _read_back(spark: SparkSession, paths: dict[str, str], kind: str = "parquet") -> DataFrame:
    return load_features(spark, paths["summary_json"].rpartition("/")[0], file_format=kind)


def _summary(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(paths["summary_json"])


def _whole_run(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Hourly bars as CSV files, through a whole run: landed, cleaned, computed and stored.

    Values of events are no prices: one of zero is as good as another, so the run keeps bars with zeros, as its SQL does. Its zone is five hours
    behind all year, as the SQL's is: where summer time ends, New York has two bars of one hour, which a run refuses.
    """
    folder = _run_dir(spark)
    _text_bars(spark, sf_dir).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/bars")
    run = {"source": "csv", "input_path": f"{folder}/bars", "output_dir": f"{folder}/out", "output_formats": ["parquet"], "exchange_timezone": "Etc/GMT+5"}
    items = [i for i in ITEMS if i["name"] in ("log_return", "moving_average")]
    return run_pipeline({"run": run, "data_quality": {"drop_zero_prices": False}, "features": {"parameters": items}}, spark)


_query("save_and_read", f'WITH {FRAME} SELECT symbol, "timestamp", {_CELLS} FROM frame')(lambda s, d: _read_back(s, _saved(s, d)))
_query("save_and_read_csv", f'WITH {FRAME} SELECT symbol, "timestamp", {_CELLS} FROM frame')(lambda s, d: _read_back(s, _saved(s, d, "csv"), "csv"))
_query("run_counts", f"WITH {FRAME} SELECT symbol, count(*) AS rows FROM frame GROUP BY 1")(
    lambda s, d: _summary(s, _saved(s, d), "rows_per_symbol map<string, long>").select(F.explode("rows_per_symbol").alias("symbol", "rows"))
)
_HEALTH = "null_count long, null_pct double, min double, mean double, max double"
_query("run_health", f"WITH {FRAME} " + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, count(*) - count({n}) AS null_count, round((count(*) - count({n})) / count(*), 4) AS null_pct, round(min({n}), 6) AS min, "
    f"round(avg({n}), 6) AS mean, round(max({n}), 6) AS max FROM frame" for n in FRAME_COLUMNS
))(lambda s, d: _summary(s, _saved(s, d), f"feature_health map<string, struct<{_HEALTH}>>").select(F.explode("feature_health").alias("feature", "h")).select("feature", "h.*"))
# the run's time zone moves all bars by as much, so their order and what they give stay; bars without a close are dropped
_query("run_features", f"""WITH {_bars_cte()}, kept AS (SELECT symbol, "timestamp" - INTERVAL 5 HOUR AS "timestamp", close FROM bars WHERE hour("timestamp") <> 3),
b AS (SELECT *, ln(close / nullif(lag(close) OVER ({BY_SYMBOL}), 0)) AS r FROM kept)
SELECT symbol, "timestamp", round(r, 6) AS log_return, round({_full('avg', 'close', -19, 0)}, 6) AS moving_average FROM b""")(lambda s, d: _read_back(s, _whole_run(s, d)))
_query("run_report", f"""WITH {_bars_cte()} SELECT count(*) AS initial_rows, count_if(hour("timestamp") = 3) AS drop_missing_numeric_values, count_if(hour("timestamp") = 3) AS total_dropped,
count_if(hour("timestamp") <> 3) AS final_rows FROM bars""")(
    lambda s, d: _summary(s, _whole_run(s, d), "cleaning struct<initial_rows long, rules map<string, struct<dropped long>>, final_rows long, total_dropped long>").select(
        "cleaning.initial_rows", F.col("cleaning.rules")["drop_missing_numeric_values"]["dropped"].alias("drop_missing_numeric_values"), "cleaning.total_dropped", "cleaning.final_rows"
    )
)
# every symbol cut into stretches that tasks compute each by itself
_query("features_by_stretch", ORACLE_SQL["features_all"])(
    lambda s, d: compute_features(_bars(s, d), {"features": {"parameters": EVERY}}, rows_per_task=100)
)

# Information coefficients

X, Y = "log_return", "fwd"
PAIRS = f'{FRAME}, pairs AS (SELECT symbol, "timestamp", {X} AS x, {Y} AS y FROM frame WHERE {X} IS NOT NULL AND {Y} IS NOT NULL)'
CORR = "covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0)"


def _ranks(source: str, keys: str, more: str = "") -> str:
    def rank(c: str) -> str:
        return f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0::DOUBLE"

    return f"(SELECT {keys}{more}, {rank('x')} AS x, {rank('y')} AS y FROM {source})"


_query("ts_ic_spearman", f"WITH {PAIRS} SELECT symbol, round(CASE WHEN count(*) >= 24 THEN {CORR} END, 6) AS ic FROM {_ranks('pairs', 'symbol')} GROUP BY 1")(
    lambda s, d: time_series_ic(_frame(s, d), X, Y)
)
_query("ts_ic_pearson", f"WITH {PAIRS} SELECT symbol, round(CASE WHEN count(*) >= 24 THEN {CORR} END, 6) AS ic FROM pairs GROUP BY 1")(
    lambda s, d: time_series_ic(_frame(s, d), X, Y, "pearson")
)
_T = '"timestamp"'
_query("xs_ic_spearman", f"WITH {PAIRS} SELECT {_T}, round({CORR}, 6) AS ic FROM {_ranks('pairs', _T)} GROUP BY 1 HAVING count(*) >= 5")(
    lambda s, d: cross_sectional_ic(_frame(s, d), X, Y)
)
_query("xs_ic_pearson", f"WITH {PAIRS} SELECT {_T}, round({CORR}, 6) AS ic FROM pairs GROUP BY 1 HAVING count(*) >= 5")(
    lambda s, d: cross_sectional_ic(_frame(s, d), X, Y, "pearson")
)
NUMBERED_PAIRS = f"{PAIRS}, num AS (SELECT *, row_number() OVER ({BY_SYMBOL}) AS rn FROM pairs), win AS (SELECT a.symbol, a.rn AS e, a.{_T} AS t, b.x, b.y FROM num a JOIN num b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 19 AND a.rn WHERE a.rn >= 20)"
_query("rolling_ic_pearson", f"WITH {NUMBERED_PAIRS} SELECT symbol, t AS {_T}, round({CORR}, 6) AS ic FROM win GROUP BY symbol, t HAVING {CORR} IS NOT NULL")(
    lambda s, d: rolling_ic(_frame(s, d), X, Y, 20, "pearson")
)
ROLLING = f"SELECT symbol, t AS {_T}, round({CORR}, 12) AS ic FROM {_ranks('win', 'symbol, t')} GROUP BY symbol, t HAVING {CORR} IS NOT NULL"
_query("rolling_ic_spearman", f"WITH {NUMBERED_PAIRS} SELECT symbol, {_T}, round(ic, 6) AS ic FROM ({ROLLING})")(lambda s, d: rolling_ic(_frame(s, d), X, Y, 20))
_query("rolling_ic_share", f"""WITH {NUMBERED_PAIRS}, roll AS ({ROLLING}), whole AS (SELECT symbol, round({CORR}, 12) AS full_ic FROM {_ranks('pairs', 'symbol')} GROUP BY 1)
SELECT symbol, round(max(full_ic), 6) AS full_ic, count(*) AS windows, round(avg(CASE WHEN sign(ic) = sign(full_ic) THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_same_sign
FROM roll JOIN whole USING (symbol) GROUP BY 1""")(lambda s, d: rolling_ic_panels(_frame(s, d), X, Y, 20)[1])
_query("ic_summary", f"""WITH {PAIRS}, ics AS (SELECT round({CORR}, 12) AS ic FROM {_ranks('pairs', _T)} GROUP BY {_T} HAVING count(*) >= 5)
SELECT round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS standard_deviation, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS information_ratio,
round(avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_positive, count(*) AS count FROM ics WHERE ic IS NOT NULL""")(
    lambda s, d: ic_summary(cross_sectional_ic(_frame(s, d), X, Y).withColumn("ic", F.round("ic", 12)))
)

# Buckets and states


def _bucket_ctes(q: int, keys: str | None = "symbol") -> str:
    by, on = (keys, f"USING ({keys})") if keys else ("1", "ON true")
    edges = ", ".join(f"quantile_cont(x, {i / q!r}) AS e{i}" for i in range(1, q))
    bucket = " + ".join(f"CASE WHEN x > e{i} THEN 1 ELSE 0 END" for i in range(1, q))
    group = f"SELECT {keys}, {edges} FROM pairs GROUP BY {keys}" if keys else f"SELECT {edges} FROM pairs"
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""edges AS ({group}), placed AS (SELECT pairs.*, 1 + {bucket} AS k FROM pairs JOIN edges {on}),
marked AS (SELECT *, CASE WHEN (SELECT count(DISTINCT k) FROM placed p2 {f'WHERE p2.{keys} = placed.{keys}' if keys else ''}) = {q} THEN k END AS quantile FROM placed)"""


BUCKET_STATS = """CAST(quantile AS INTEGER) AS quantile, count(*) AS observations, round(avg(y), 6) AS mean, round(median(y), 6) AS median, round(stddev_samp(y), 6) AS standard_deviation,
round(quantile_cont(y, 0.1), 6) AS percentile_10, round(quantile_cont(y, 0.9), 6) AS percentile_90, round(min(x), 6) AS feature_min, round(max(x), 6) AS feature_max"""


def _pairs(spark: SparkSession, sf_dir: str, feature: str = X) -> DataFrame:
    return pair_table(_frame(spark, sf_dir), [feature], Y)


_query("quantile_buckets", f'WITH {PAIRS}, {_bucket_ctes(5)} SELECT symbol, "timestamp", round(x, 6) AS x, CAST(quantile AS INTEGER) AS quantile FROM marked')(
    lambda s, d: buckets.bucketed(_pairs(s, d), 5).select("symbol", "timestamp", "x", "quantile")
)
_query("quantile_summary", f"WITH {PAIRS}, {_bucket_ctes(5)} SELECT {BUCKET_STATS} FROM marked WHERE quantile IS NOT NULL GROUP BY quantile")(
    lambda s, d: buckets.bucket_summary(buckets.bucketed(_pairs(s, d), 5))
)
_query("quantile_summary_pooled", f"WITH {PAIRS}, {_bucket_ctes(5, None)} SELECT {BUCKET_STATS} FROM marked WHERE quantile IS NOT NULL GROUP BY quantile")(
    lambda s, d: buckets.bucket_summary(buckets.bucketed(_pairs(s, d), 5, False))
)
_query("quantile_values", f"WITH {PAIRS}, {_bucket_ctes(5)} SELECT CAST(quantile AS INTEGER) AS quantile, round(y, 6) AS value FROM marked WHERE quantile IS NOT NULL")(
    lambda s, d: buckets.bucketed(_pairs(s, d), 5).filter("quantile is not null").select("quantile", F.col("y").alias("value"))
)
SPREAD = "SELECT max_by(m, quantile) - min_by(m, quantile) AS quantile_spread FROM (SELECT quantile, avg(y) AS m FROM marked WHERE quantile IS NOT NULL GROUP BY 1)"
_query("quantile_spread", f"WITH {PAIRS}, {_bucket_ctes(5)} SELECT '{X}' AS feature, round(quantile_spread, 6) AS quantile_spread FROM ({SPREAD})")(
    lambda s, d: buckets.quantile_spread(buckets.bucketed(_pairs(s, d), 5), ["feature"])
)
STATES = f"{PAIRS}, {_bucket_ctes(3, None)}, states AS (SELECT CASE k WHEN 1 THEN 'low' WHEN 2 THEN 'neutral' ELSE 'high' END AS state, x, y FROM placed)"
_query("tercile_states", f"WITH {STATES} SELECT state, round(x, 6) AS x, round(y, 6) AS y FROM states")(lambda s, d: state_rows(_frame(s, d), X, Y))
MARKS = "count(*) AS observations, round(avg(y), 6) AS mean, " + ", ".join(f"round(quantile_cont(y, {p / 100!r}), 6) AS percentile_{p}" for p in (10, 25, 75, 90))
_query("state_spread", f"WITH {STATES} SELECT '{X}' AS feature, state, {MARKS} FROM states GROUP BY 2")(lambda s, d: spread_by_state(_frame(s, d), [X], Y))
_query("violin_marks", f"""WITH {PAIRS}, {_bucket_ctes(5)} SELECT CAST(quantile AS INTEGER) AS quantile, {MARKS}, round(median(y), 6) AS median,
round((SELECT avg(y) FROM pairs), 6) AS overall_mean FROM marked WHERE quantile IS NOT NULL GROUP BY 1""")(lambda s, d: violin_marks(_frame(s, d), X, Y))
# states of each symbol by its own values, as the figure of states has them
STATES_BY_SYMBOL = f"{PAIRS}, {_bucket_ctes(3)}, states AS (SELECT CASE k WHEN 1 THEN 'low' WHEN 2 THEN 'neutral' ELSE 'high' END AS state, x, y FROM placed)"
_query("tercile_states_by_symbol", f"WITH {STATES_BY_SYMBOL} SELECT state, round(x, 6) AS x, round(y, 6) AS y FROM states")(lambda s, d: state_rows(_frame(s, d), X, Y, True))
_query("state_spread_by_symbol", f"WITH {STATES_BY_SYMBOL} SELECT '{X}' AS feature, state, {MARKS} FROM states GROUP BY 2")(lambda s, d: spread_by_state(_frame(s, d), [X], Y, True))
_query("violin_outline", f"""WITH {PAIRS}, {_bucket_ctes(5)}, v AS (SELECT quantile, y FROM marked WHERE quantile IS NOT NULL),
ends AS (SELECT quantile, min(y) AS low, max(y) AS high, count(*) AS n, stddev_samp(y) * pow(count(*), -0.2) AS width FROM v GROUP BY 1),
bins AS (SELECT quantile, least(floor((y - low) / ((high - low) / 512)), 511) AS bin, count(*) AS c FROM v JOIN ends USING (quantile) GROUP BY 1, 2),
grid AS (SELECT ends.*, low + (high - low) * i / 99.0::DOUBLE AS value FROM ends, range(100) r(i))
SELECT CAST(quantile AS INTEGER) AS quantile, round(value, 6) AS value, round(sum(c * exp(-pow((value - low - (bin + 0.5::DOUBLE) * (high - low) / 512) / width, 2) / 2)) / (any_value(n) * any_value(width) * sqrt(2 * pi())), 6) AS density
FROM grid JOIN bins USING (quantile) GROUP BY quantile, value""")(lambda s, d: violin_outline(_frame(s, d), X, Y))
_query("rolling_panel_share", f"""WITH {NUMBERED_PAIRS}, roll AS ({ROLLING}), whole AS (SELECT round(avg(ic), 12) AS full_ic FROM (SELECT CASE WHEN count(*) >= 24 THEN {CORR} END AS ic FROM {_ranks('pairs', 'symbol')} GROUP BY symbol))
SELECT round(any_value(full_ic), 6) AS full_ic, count(*) AS windows, round(avg(CASE WHEN sign(ic) = sign(full_ic) THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_same_sign FROM roll, whole""")(
    lambda s, d: panel_share(_frame(s, d), X, Y, 20)
)
_query("target_overall_mean", f"WITH {FRAME} SELECT round(avg({Y}), 6) AS overall_mean FROM frame")(lambda s, d: overall_mean(_frame(s, d), Y))

# Regression


def _regression_ctes(pairs: str) -> str:
    return f"""z AS (SELECT * FROM (SELECT feature, symbol, {_T}, (x - avg(x) OVER p) / nullif(stddev_samp(x) OVER p, 0) AS x, y FROM {pairs} WINDOW p AS (PARTITION BY feature, symbol)) WHERE x IS NOT NULL),
m AS (SELECT feature, count(*) AS n, count(DISTINCT {_T}) AS t, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) / var_pop(x) AS beta FROM z GROUP BY 1),
a AS (SELECT *, my - beta * mx AS alpha, greatest(1, CAST(floor(4 * pow(t / 100, 2 / 9)) AS INTEGER)) AS lags FROM m),
s AS (SELECT feature, {_T}, sum(y - alpha - beta * x) AS h0, sum(x * (y - alpha - beta * x)) AS h1, sum((y - alpha - beta * x) ** 2) AS sse, row_number() OVER (PARTITION BY feature ORDER BY {_T}) AS rn FROM z JOIN a USING (feature) GROUP BY 1, 2),
k AS (SELECT u.feature, sum(w * u.h0 * v.h0) AS s00, sum(w * u.h1 * v.h1) AS s11, sum(w / 2 * (u.h0 * v.h1 + u.h1 * v.h0)) AS s01
  FROM (SELECT s.*, g, CASE WHEN g > 0 THEN 2 ELSE 1 END * (1 - g / (least(lags, t - 1) + 1)) AS w FROM s JOIN a USING (feature), range(0, 200) r(g) WHERE g <= least(lags, t - 1)) u
  JOIN s v ON v.feature = u.feature AND v.rn = u.rn - u.g GROUP BY 1),
dk AS (SELECT a.*, (pow(n * mx, 2) * s00 - 2 * n * mx * n * s01 + n * n * s11) / pow(n * n * vx, 2) AS variance, 1 - (SELECT sum(sse) FROM s WHERE s.feature = a.feature) / (n * vy) AS r_squared FROM a JOIN k USING (feature))"""


LONG = f"{FRAME}, long AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, symbol, {_T}, {n} AS x, fwd AS y FROM frame WHERE {n} IS NOT NULL AND fwd IS NOT NULL" for n in FRAME_COLUMNS) + ")"
ONE = f"{PAIRS}, long AS (SELECT '{X}' AS feature, * FROM pairs)"
_query("zscore", f"WITH {ONE}, {_regression_ctes('long')} SELECT symbol, {_T}, round(x, 6) AS x FROM z")(lambda s, d: zscored(_pairs(s, d)).select("symbol", "timestamp", "x"))
_query("ols_moments", f"WITH {ONE}, {_regression_ctes('long')} SELECT feature, n, t, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(r_squared, 6) AS r_squared FROM dk")(
    lambda s, d: regression_table(_pairs(s, d)).select("feature", "n", "t", "alpha", "beta", "r_squared")
)
_query("dk_regression", f"WITH {ONE}, {_regression_ctes('long')} SELECT feature, n, round(beta, 6) AS beta, round(sqrt(variance), 6) AS standard_error, round(beta / sqrt(variance), 6) AS t_statistic, CAST(lags AS INTEGER) AS lags FROM dk")(
    lambda s, d: regression_table(_pairs(s, d)).select(
        "feature", "n", "beta", F.sqrt("variance").alias("standard_error"), (F.col("beta") / F.sqrt("variance")).alias("t_statistic"), F.col("lags").cast("int").alias("lags")
    )
)


def _per_feature(sql: Callable[[str], str]) -> str:
    return " UNION ALL ".join(sql(n) for n in FRAME_COLUMNS)


EVALUATE_SQL = f"""WITH {LONG}, {_regression_ctes('long')},
ic AS (SELECT feature, avg(ic) AS mean_time_series_ic FROM (SELECT feature, CASE WHEN count(*) >= 24 THEN {CORR} END AS ic FROM {_ranks('long', 'feature, symbol')} GROUP BY feature, symbol) GROUP BY 1),
q AS (SELECT feature, symbol, {', '.join(f'quantile_cont(x, {i / 5!r}) AS e{i}' for i in range(1, 5))} FROM long GROUP BY 1, 2),
p AS (SELECT long.*, {' + '.join(f'CASE WHEN x > e{i} THEN 1 ELSE 0 END' for i in range(1, 5))} AS bucket FROM long JOIN q USING (feature, symbol)),
good AS (SELECT feature, symbol FROM p GROUP BY 1, 2 HAVING count(DISTINCT bucket) = 5),
sp AS (SELECT feature, max_by(v, bucket) - min_by(v, bucket) AS quantile_spread FROM (SELECT feature, bucket, avg(y) AS v FROM p JOIN good USING (feature, symbol) GROUP BY 1, 2) GROUP BY 1)
SELECT feature, round(mean_time_series_ic, 6) AS mean_time_series_ic, round(beta, 6) AS beta, round(beta / sqrt(variance), 6) AS t_statistic, round(r_squared, 6) AS r_squared,
n AS observations, round(quantile_spread, 6) AS quantile_spread FROM dk JOIN ic USING (feature) JOIN sp USING (feature)"""
#: The complementary error function by a rational approximation with an error below 1.2e-7, so p-values are compared to four places.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
_HORNER = " + u * (".join(f"CAST({c!r} AS DOUBLE)" for c in ERFC) + ")" * (len(ERFC) - 1)
_query("p_values", f"""WITH {LONG}, {_regression_ctes('long')}, t AS (SELECT feature, abs(beta / sqrt(variance)) / sqrt(2.0::DOUBLE) AS z FROM dk)
SELECT feature, round(u * exp(-z * z + {_HORNER}), 4) AS p_value FROM (SELECT feature, z, 1 / (1 + z / 2) AS u FROM t)""", exact=True)(
    lambda s, d: evaluate_features(_frame(s, d), Y, list(FRAME_COLUMNS)).select("feature", F.round("p_value", 4).alias("p_value"))
)
_query("evaluate_order", f"""SELECT feature, row_number() OVER (ORDER BY abs(t_statistic) DESC NULLS LAST) AS position FROM ({EVALUATE_SQL})""")(
    lambda s, d: _positions(evaluate_features(_frame(s, d), Y, list(FRAME_COLUMNS)), "feature")
)
_query("quantile_order", f"WITH {PAIRS}, {_bucket_ctes(5)} SELECT CAST(quantile AS INTEGER) AS quantile, row_number() OVER (ORDER BY quantile) AS position FROM marked WHERE quantile IS NOT NULL GROUP BY quantile")(
    lambda s, d: _positions(target_by_feature_quantile(_frame(s, d), X, Y), "quantile")
)


def _positions(df: DataFrame, column: str) -> DataFrame:
    """A column of an ordered table, a few rows, with the places at which they come."""
    numbered = df.select(column, F.monotonically_increasing_id().alias("_at"))
    return numbered.select(column, F.row_number().over(Window.orderBy("_at")).cast("long").alias("position"))


# p-values are compared by themselves, to fewer places
_query("evaluate_features", EVALUATE_SQL)(lambda s, d: evaluate_features(_frame(s, d), Y, list(FRAME_COLUMNS)).drop("p_value"))
