"""Loading bars: CSV files and a ClickHouse table over JDBC, brought to one schema."""

from __future__ import annotations

import datetime as dt
import os
import re
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .quality import RULES, cleaning_report, first_broken
from .schema import COLUMNS, DEFAULT_SESSION, NUMBERS, SESSIONS, session_condition
from .shared import stored

#: Tasks that a database table is read by, at most.
MOST_PARTS = 1000
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Ends of a text that make it an instant: Z or an offset after a time of day.
AWARE = r":.*(?:[Zz]|[+-]\d{2}(?::?\d{2})?)\s*$"
#: A number as CSV writes it; Spark's cast alone would also take a type suffix as in 1.0d.
NUMERIC = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def load_ohlcv(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """Validated bars of the source that ``config["run"]`` names."""
    run = config["run"]
    if run["source"] == "csv":
        return load_csv(spark, run)
    if run["source"] == "clickhouse":
        return load_clickhouse(spark, run)
    raise ValueError(f"unsupported source {run['source']!r}; known: csv, clickhouse")


def load_csv(spark: SparkSession, run: dict[str, Any]) -> DataFrame:
    """Read all columns as text, validate the whole file, then filter by symbol, date and session."""
    return filter_bars(finalize_bars(read_csv(spark, run), zone_of(run)), run)


def read_csv(spark: SparkSession, run: dict[str, Any]) -> DataFrame:
    return spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False).csv(run["input_path"])


def zone_of(run: dict[str, Any]) -> str:
    return run.get("exchange_timezone") or "America/New_York"


def land_bars(spark: SparkSession, config: dict[str, Any]) -> tuple[DataFrame, dict]:
    """(bars, cleaning report) of a run from one scan of its source: what ``load_ohlcv`` gives, with the report of ``clean_ohlcv`` on it.

    The bars are normalised and written to the shared folder once, so all that follows sees the same rows; faults, and the bars charged to each
    rule among those that the run's filters keep, are counted by the tasks that write. Only the search for duplicates reads two columns of what
    was written.
    """
    run, enabled = config["run"], config.get("data_quality") or {}
    if run["source"] not in ("csv", "clickhouse"):
        raise ValueError(f"unsupported source {run['source']!r}; known: csv, clickhouse")
    from_csv = run["source"] == "csv"
    bars = normalized_bars(read_csv(spark, run) if from_csv else read_clickhouse(spark, run), zone_of(run))
    kept, broken = filter_condition(run) if from_csv else F.lit(True), first_broken(enabled)
    seen, faults = Observation(), fault_counts()
    charged = [F.count_if(kept & broken.eqNullSafe(F.lit(name))).alias(f"rule_{i}") for i, name in enumerate(RULES)]
    stored_bars = stored(bars.observe(seen, *faults, F.count_if(kept).alias("bars"), *charged), "landed")
    found = seen.get
    check_faults(found["symbols"], found["times"], bool(duplicate_bars(stored_bars).limit(1).count()))
    counts = {name: found[f"rule_{i}"] for i, name in enumerate(RULES)} | {None: found["bars"] - sum(found[f"rule_{i}"] for i in range(len(RULES)))}
    return stored_bars.filter(kept), cleaning_report(counts, enabled)


def filter_bars(df: DataFrame, run: dict[str, Any]) -> DataFrame:
    """Symbols (if any are listed), inclusive local dates (each bound optional) and trading session."""
    return df.filter(filter_condition(run))


def filter_condition(run: dict[str, Any]) -> Column:
    """Whether a run's filters keep a bar; null, which does not, where its time is unknown."""
    out = session_condition(run.get("session") or DEFAULT_SESSION["csv"])
    if run.get("symbols"):
        out &= F.col("symbol").isin(list(run["symbols"]))
    if run.get("start_date"):
        out &= F.col("timestamp") >= F.to_date(F.lit(str(run["start_date"]))).cast("timestamp_ntz")
    if run.get("end_date"):
        out &= F.col("timestamp") < F.date_add(F.to_date(F.lit(str(run["end_date"]))), 1).cast("timestamp_ntz")
    return out


def normalize_timestamp(column: Column, kind: str, zone: str) -> Column:
    """Exchange-local wall clock: instants are converted, naive values taken as they are, per value.

    Null where a text is no timestamp. Assumes the session time zone UTC, which ``finalize_bars`` checks.
    """
    if kind == "timestamp_ntz":
        return column
    if kind == "timestamp":
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), column.cast("timestamp_ntz"))
    text = F.trim(column.cast("string"))
    instant = F.convert_timezone(F.lit("UTC"), F.lit(zone), text.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(text.rlike(AWARE), instant).otherwise(text.try_cast("timestamp_ntz"))


def to_number(column: Column, kind: str) -> Column:
    """A double, null where it is no number."""
    if kind == "string":
        return F.when(column.rlike(NUMERIC), F.trim(column).try_cast("double"))
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def normalized_bars(df: DataFrame, zone: str) -> DataFrame:
    """The bar columns, normalised; a KeyError if one is missing. Extra columns are dropped."""
    missing = [c for c in COLUMNS if c not in df.columns]
    if missing:
        raise KeyError(f"missing required columns: {missing}")
    if df.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise ValueError("set spark.sql.session.timeZone to UTC: bars carry wall-clock times")
    kinds = dict(df.dtypes)
    symbol = F.regexp_replace(F.regexp_replace(F.col("symbol").cast("string"), r"^\s+", ""), r"\s+$", "")
    return df.select(
        symbol.alias("symbol"),
        normalize_timestamp(F.col("timestamp"), kinds["timestamp"], zone).alias("timestamp"),
        *(to_number(F.col(c), kinds[c]).alias(c) for c in NUMBERS),
    )


def fault_counts(bars: Column | None = None) -> list[Column]:
    """Bars without a symbol and without a time; ``bars`` has how many a row stands for."""
    one = F.lit(1) if bars is None else bars
    blank = F.col("symbol").isNull() | (F.col("symbol") == "")
    return [F.coalesce(F.sum(F.when(c, one)), F.lit(0)).alias(n) for c, n in ((blank, "symbols"), (F.col("timestamp").isNull(), "times"))]


def check_faults(symbols: int, times: int, duplicates: bool) -> None:
    if symbols:
        raise ValueError("symbol values must be present and non-empty")
    if times:
        raise ValueError("timestamps must be present and valid")
    if duplicates:
        raise ValueError("Duplicate OHLCV bars found for symbol/timestamp pairs")


def finalize_bars(df: DataFrame, zone: str) -> DataFrame:
    """Project to the bar columns, normalise, and refuse blank symbols, bad timestamps and duplicate bars.

    One job counts all faults over all rows before any filter. Extra columns are dropped.
    """
    out = normalized_bars(df, zone)
    bars, known = F.col("bars"), F.col("symbol").isNotNull() & F.col("timestamp").isNotNull()
    counted = out.groupBy("symbol", "timestamp").agg(F.count("*").alias("bars"))
    faults = counted.agg(*fault_counts(bars), F.max(F.when(known, bars)).alias("most")).first()
    check_faults(faults["symbols"], faults["times"], (faults["most"] or 0) > 1)
    return out


def duplicate_bars(df: DataFrame) -> DataFrame:
    """(symbol, timestamp, bars): keys that stand more than once."""
    return df.groupBy("symbol", "timestamp").agg(F.count("*").alias("bars")).filter("bars > 1")


#: The time column of the database table; everywhere else it is called timestamp.
TIME_COLUMN = "ts"


def session_sql(session: str, column: str = TIME_COLUMN) -> str:
    """The session filter as ClickHouse text, empty for all bars."""
    span = SESSIONS[session]
    return "" if span is None else f"toHour({column}) * 60 + toMinute({column}) BETWEEN {span[0]} AND {span[1]}"


def symbol_list(symbols: Any) -> list[str]:
    names = [str(s).strip() for s in symbols or []]
    if not names or not all(names):
        raise ValueError("run.symbols must hold non-empty symbols")
    return names


def table_name(table: Any) -> str:
    if not isinstance(table, str) or not IDENTIFIER.fullmatch(table):
        raise ValueError(f"Invalid ClickHouse table identifier: {table!r}")
    return table


def clickhouse_query(run: dict[str, Any]) -> str:
    """The SELECT that a run sends: symbols, dates and session are filtered in the database."""
    table = table_name(run["table"])
    where = [
        f"symbol IN ({', '.join(map(_quoted, symbol_list(run['symbols'])))})",
        f"toDate({TIME_COLUMN}) >= toDate({_quoted(run['start_date'])})",
        f"toDate({TIME_COLUMN}) <= toDate({_quoted(run['end_date'])})",
    ]
    session = session_sql(run.get("session") or DEFAULT_SESSION["clickhouse"])
    where += [session] if session else []
    columns = ", ".join(f"{TIME_COLUMN} AS timestamp" if c == "timestamp" else c for c in COLUMNS)
    return f"SELECT {columns} FROM {table} WHERE {' AND '.join(where)}"


def clickhouse_parts(run: dict[str, Any], most: int = MOST_PARTS) -> list[str]:
    """Conditions that part a run's bars: a symbol's months, or, where these are over ``most``, whole symbols, or groups of them."""
    symbols = symbol_list(run["symbols"])
    start, end = (dt.date.fromisoformat(str(run[k])[:10]) for k in ("start_date", "end_date"))
    first, last = start.year * 12 + start.month - 1, end.year * 12 + end.month - 1
    months = [n // 12 * 100 + n % 12 + 1 for n in range(first, last + 1)]
    if len(symbols) * len(months) <= most:
        return [f"symbol = {_quoted(s)} AND toYYYYMM(timestamp) = {m}" for s in symbols for m in months]
    groups = [symbols[i::most] for i in range(min(most, len(symbols)))]
    return [f"symbol IN ({', '.join(map(_quoted, g))})" for g in groups]


def _quoted(value: Any) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def env_file(path: str = ".env") -> dict[str, str]:
    """NAME=value lines of a file, without quotes around values; empty if there is no file."""
    out: dict[str, str] = {}
    if not os.path.exists(path):
        return out
    with open(path, encoding="utf-8") as f:
        for line in f:
            m = re.fullmatch(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*", line)
            if m:
                value = re.fullmatch(r"(['\"])(.*)\1(?:\s+#.*)?", m[2])
                out[m[1]] = value[2] if value else re.sub(r"\s+#.*", "", m[2])
    return out


def clickhouse_options(env: dict[str, str] | None = None) -> dict[str, str]:
    """JDBC options from CLICKHOUSE_HOST, _PORT, _USER, _PASSWORD, _SECURE, _VERIFY and _DATABASE.

    Taken from the file .env of the working folder, and before it from the environment.
    """
    env = env_file() | dict(os.environ) if env is None else env

    def on(name: str, default: str) -> bool:
        return env.get(f"CLICKHOUSE_{name}", default).strip().lower() in ("1", "true", "yes", "on")

    secure = on("SECURE", "false")
    host, port = env.get("CLICKHOUSE_HOST", "127.0.0.1"), env.get("CLICKHOUSE_PORT", "8443" if secure else "8123")
    mode = f"?ssl={str(secure).lower()}" + ("&sslmode=strict" if secure and on("VERIFY", "false") else "&sslmode=none" if secure else "")
    return {
        "url": f"jdbc:clickhouse://{host}:{port}/{env.get('CLICKHOUSE_DATABASE', 'default')}{mode}",
        "user": env.get("CLICKHOUSE_USER", "default"),
        "password": env.get("CLICKHOUSE_PASSWORD", ""),
        "driver": "com.clickhouse.jdbc.ClickHouseDriver",
    }


def load_clickhouse(spark: SparkSession, run: dict[str, Any]) -> DataFrame:
    """Read over JDBC (the driver jar is the caller's), a symbol and month a task, and validate what comes back."""
    return finalize_bars(read_clickhouse(spark, run), zone_of(run))


def read_clickhouse(spark: SparkSession, run: dict[str, Any]) -> DataFrame:
    options = clickhouse_options()
    return spark.read.jdbc(options.pop("url"), f"({clickhouse_query(run)}) AS bars", predicates=clickhouse_parts(run), properties=options)
