import datetime as dt
import json
import os
import re

import pytest

from barloom import ConfigValidationError, clean_ohlcv, load_features, load_ohlcv, validate_config
from barloom.cli import main, run_pipeline
from barloom.schema import BAR_SCHEMA
from barloom.sources import clickhouse_options, clickhouse_parts, clickhouse_query, env_file

HEADER = "symbol,timestamp,open,high,low,close,volume\n"


def csv(tmp_path, *rows):
    path = tmp_path / "bars.csv"
    path.write_text(HEADER + "\n".join(rows) + "\n")
    return str(path)


def load(spark, path, **run):
    return load_ohlcv(spark, {"run": {"source": "csv", "input_path": path, **run}}).orderBy("symbol", "timestamp").collect()


def test_text_becomes_bars(spark, tmp_path):
    path = csv(tmp_path, " AAA ,2024-07-01T13:30:00Z,1,2,0.5,1.5,10", "AAA,2024-07-01 09:31:00,1.0d,inf,x,,1e3", "NA,2024-07-01 16:30:00-04:00,1,2,1,1,0")
    rows = load(spark, path)
    assert [(r.symbol, r.timestamp) for r in rows] == [
        ("AAA", dt.datetime(2024, 7, 1, 9, 30)), ("AAA", dt.datetime(2024, 7, 1, 9, 31)), ("NA", dt.datetime(2024, 7, 1, 16, 30))]
    assert (rows[1].open, rows[1].high, rows[1].low, rows[1].close, rows[1].volume) == (None, None, None, None, 1000.0)
    assert len(load(spark, path, session="regular")) == 2
    assert [r.symbol for r in load(spark, path, symbols=["NA"])] == ["NA"]
    assert load(spark, path, start_date="2024-07-02") == [] and len(load(spark, path, end_date="2024-07-01")) == 3


def test_naive_time_in_the_spring_gap_stays(spark, tmp_path):
    assert load(spark, csv(tmp_path, "A,2024-03-10 02:30:00,1,1,1,1,1"))[0].timestamp == dt.datetime(2024, 3, 10, 2, 30)


@pytest.mark.parametrize(
    ("rows", "message"),
    [
        (["  ,2024-01-01,1,1,1,1,1"], "symbol values must be present and non-empty"),
        (["A,soon,1,1,1,1,1"], "timestamps must be present and valid"),
        (["A,2024-01-02 10:00:00,1,1,1,1,1", "A,2024-01-02T15:00:00Z,2,2,2,2,2"], "Duplicate OHLCV bars found for symbol/timestamp pairs"),
        (["A,2024-11-03T05:30:00Z,1,1,1,1,1", "A,2024-11-03T06:30:00Z,2,2,2,2,2"], "Duplicate OHLCV bars"),
    ],
)
def test_faults_are_refused(spark, tmp_path, rows, message):
    with pytest.raises(ValueError, match=message):
        load(spark, csv(tmp_path, *rows), start_date="2030-01-01")


def test_missing_column(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("symbol,timestamp,open\nA,2024-01-01,1\n")
    with pytest.raises(KeyError, match="close"):
        load(spark, str(path))


def test_clickhouse_text():
    run = {"table": "stocks", "symbols": [" A", "B'x"], "start_date": "2024-01-01", "end_date": "2024-02-01"}
    sql = clickhouse_query(run)
    assert "symbol IN ('A', 'B\\'x')" in sql and "toHour(ts) * 60 + toMinute(ts) BETWEEN 570 AND 959" in sql
    assert "ts AS timestamp" in sql and "toDate(ts) >= toDate('2024-01-01')" in sql and "ORDER BY" not in sql
    assert "BETWEEN" not in clickhouse_query(run | {"session": "full"})
    with pytest.raises(ValueError, match="Invalid ClickHouse table identifier"):
        clickhouse_query(run | {"table": "a; drop"})
    assert clickhouse_options({"CLICKHOUSE_HOST": "h", "CLICKHOUSE_SECURE": "true"})["url"].startswith("jdbc:clickhouse://h:8443/default?ssl=true")


def test_clickhouse_parts_cover_symbols_and_months():
    run = {"symbols": ["A", "B'x"], "start_date": "2023-11-20", "end_date": "2024-02-01"}
    parts = clickhouse_parts(run)
    assert len(parts) == 8 and parts[0] == "symbol = 'A' AND toYYYYMM(timestamp) = 202311" and parts[-1] == "symbol = 'B\\'x' AND toYYYYMM(timestamp) = 202402"
    assert clickhouse_parts(run | {"symbols": list("ABCDE")}, most=2) == ["symbol IN ('A', 'C', 'E')", "symbol IN ('B', 'D')"]


def test_env_file(tmp_path, monkeypatch):
    path = tmp_path / ".env"
    path.write_text("# comment\nCLICKHOUSE_HOST=from-file # here\nexport CLICKHOUSE_PASSWORD='a # b'\n\nbroken line\nCLICKHOUSE_USER = \"me\"\n")
    assert env_file(str(path)) == {"CLICKHOUSE_HOST": "from-file", "CLICKHOUSE_PASSWORD": "a # b", "CLICKHOUSE_USER": "me"}
    assert env_file(str(tmp_path / "none")) == {}
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("CLICKHOUSE_USER", "environment")
    options = clickhouse_options()
    assert options["user"] == "environment" and options["password"] == "a # b" and "//from-file:" in options["url"]


def test_each_bar_is_charged_once(spark):
    t = dt.datetime(2024, 1, 1)
    bad = [(1, 2, 0.5, None, 1), (-1, 2, 0.5, 1, -1), (1, 2, 0.5, 1, -1), (1, 1, 2, 1, 1), (3, 2, 1, 1.5, 1), (1, 2, float("nan"), 1, 1), (1, 2, 1, 1.5, 0)]
    bars = spark.createDataFrame([("A", t + dt.timedelta(days=i), *(None if x is None else float(x) for x in r)) for i, r in enumerate(bad)], BAR_SCHEMA)
    clean, report = clean_ohlcv(bars)
    assert [r["dropped"] for r in report["rules"].values()] == [2, 1, 1, 1, 1]
    assert (report["initial_rows"], report["final_rows"], report["total_dropped"], clean.count()) == (7, 1, 6, 1)
    _, report = clean_ohlcv(bars, {"drop_zero_prices": False})
    assert report["rules"]["drop_zero_prices"] == {"enabled": False, "dropped": 0, "reason": "price at or below zero"}
    assert report["rules"]["drop_negative_volume"]["dropped"] == 2


def config(tmp_path, **run):
    return {
        "run": {"source": "csv", "input_path": str(tmp_path / "bars.csv"), "output_dir": str(tmp_path / "out"), "output_formats": ["csv", "parquet"], "version": "1", **run},
        "features": {"parameters": [{"name": "r", "function": "log_return"}, {"name": "m", "function": "moving_average", "window": 2}]},
    }


def test_whole_run(spark, tmp_path):
    csv(tmp_path, *(f"A,2024-01-{d:02},1,3,1,{1 + d / 10},5" for d in range(1, 6)), "B,2024-01-01,1,0,1,1,5")
    paths = run_pipeline(config(tmp_path), spark)
    assert set(paths) == {"csv", "parquet", "catalog_csv", "summary_json"}
    summary = json.loads(open(paths["summary_json"]).read())
    assert re.search(r"/run_summary_v[^/]*_\d{8}_\d{6}_\d{6}\.json$", paths["summary_json"])
    assert summary["rows_per_symbol"] == {"A": 5} and summary["feature_health"]["r"]["null_pct"] == 0.2 and summary["cleaning"]["total_dropped"] == 1
    assert "moving_average,trend,2" in open(paths["catalog_csv"]).read()
    later = run_pipeline(config(tmp_path, version="9"), spark)
    newest = load_features(spark, str(tmp_path / "out"), file_format="csv")
    assert later["csv"].split("/")[-1].startswith("features_v9") and newest.count() == 5 and newest.dtypes[1] == ("timestamp", "timestamp_ntz")
    assert load_features(spark, str(tmp_path / "out"), paths["parquet"].split("/")[-1].removesuffix(".parquet")).columns == ["symbol", "timestamp", "r", "m"]
    with pytest.raises(ValueError, match="no bars"):
        run_pipeline(config(tmp_path, symbols=["ZZZ"]), spark)
    assert main(["--config", str(tmp_path / "absent.toml")]) == 1


def test_a_run_without_its_record_is_passed_over(spark, tmp_path):
    csv(tmp_path, *(f"A,2024-01-{d:02},1,3,1,{1 + d / 10},5" for d in range(1, 6)))
    first = run_pipeline(config(tmp_path), spark)
    second = run_pipeline(config(tmp_path, version="2", symbols=["A"], end_date="2024-01-03"), spark)
    assert load_features(spark, str(tmp_path / "out")).count() == 3
    os.remove(second["summary_json"])  # as if the run had died before it
    assert load_features(spark, str(tmp_path / "out")).count() == 5
    assert load_features(spark, str(tmp_path / "out"), second["parquet"].split("/")[-1].removesuffix(".parquet")).count() == 3
    os.remove(first["summary_json"])
    with pytest.raises(FileNotFoundError, match="no stored parquet features"):
        load_features(spark, str(tmp_path / "out"))
    assert not [n for n in os.listdir(tmp_path / "out") if n.endswith(".part")]


def test_a_run_scans_its_source_once_and_counts_as_the_parts_do(spark, tmp_path):
    days = [f"A,2024-01-{d:02} 10:00:00,1,3,1,{1 + d / 10},5" for d in range(1, 20)]
    bad = ["A,2024-02-01 10:00:00,1,x,1,1,5", "A,2024-02-02 10:00:00,1,1,2,1,5", "B,2024-02-03 10:00:00,-1,3,1,1,5", "B,2024-02-03 20:00:00,1,3,1,1,-5", "B,2024-01-03 10:00:00,1,3,1,2,5"]
    csv(tmp_path, *days, *bad)
    run = config(tmp_path, session="regular", start_date="2024-01-02")
    paths = run_pipeline(run, spark)
    summary = json.loads(open(paths["summary_json"]).read())
    bars = load_ohlcv(spark, run)
    clean, report = clean_ohlcv(bars)
    assert summary["cleaning"] == report and report["total_dropped"] == 3 and report["initial_rows"] == 22
    stored = load_features(spark, str(tmp_path / "out"))
    from barloom.sinks import feature_health

    health = {r["feature"]: {k: r[k] for k in ("null_count", "null_pct", "min", "mean", "max")} for r in feature_health(stored).collect()}
    assert {n: {k: pytest.approx(v) for k, v in h.items()} for n, h in health.items()} == summary["feature_health"]
    assert summary["rows"] == stored.count() == 19 and summary["rows_per_symbol"] == {"A": 18, "B": 1}
    with pytest.raises(ValueError, match="Duplicate OHLCV"):
        csv(tmp_path, *days, "A,2024-01-01 10:00:00,1,3,1,1,5")
        run_pipeline(run, spark)


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda c: c["run"].update(source="excel"), "run.source"),
        (lambda c: c["run"].update(output_formats=[]), "run.output_formats"),
        (lambda c: c["run"].update(session="night"), "run.session"),
        (lambda c: c["run"].update(exchange_timezone="Mars/Base"), "exchange_timezone"),
        (lambda c: c["run"].update(start_date="2024-02-01", end_date="2024-01-01"), "start_date"),
        (lambda c: c["run"].update(source="clickhouse", table="t", start_date="2024-01-01", end_date="2024-01-02"), "run.symbols"),
        (lambda c: c.update(data_quality={"drop_all": True}), "unknown option"),
        (lambda c: c["features"].update(include_categories=["moods"]), "features.include_categories"),
        (lambda c: c["features"].update(include_categories=["trend"], exclude_categories=["trend"]), "both include_categories"),
        (lambda c: c["features"]["parameters"][0].update(function="nope"), r"features.parameters\[0\].function"),
        (lambda c: c["features"]["parameters"][1].update(window=0), r"features.parameters\[1\].window must be an integer >= 1"),
        (lambda c: c["features"]["parameters"][1].update(window=True), "integer >= 1"),
        (lambda c: c["features"]["parameters"][1].update(depth=2), "unsupported parameter"),
        (lambda c: c["features"]["parameters"][1].update(name="r"), "duplicate"),
        (lambda c: c["features"]["parameters"].append({"name": "x", "function": "macd_line", "fast": 30}), "fast must be less than slow"),
    ],
)
def test_bad_configs(tmp_path, change, message):
    good = config(tmp_path)
    validate_config(good)
    change(good)
    with pytest.raises(ConfigValidationError, match=message):
        validate_config(good)
