"""The bar table: names, types, trading sessions and null handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
NUMBERS = (*PRICES, "volume")
IDS = ("symbol", "timestamp")
COLUMNS = (*IDS, *NUMBERS)

BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType(), False), T.StructField("timestamp", T.TimestampNTZType(), False)]
    + [T.StructField(c, T.DoubleType()) for c in NUMBERS]
)

#: Inclusive minutes of the day of each trading session; None keeps every bar.
SESSIONS: dict[str, tuple[int, int] | None] = {"regular": (570, 959), "extended": (240, 1199), "full": None}
DEFAULT_SESSION = {"csv": "full", "clickhouse": "regular"}


def number(column: Column) -> Column:
    """A double with NaN as null: null is the only missing marker inside the engine."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def finite(column: Column) -> Column:
    """The value where it is a finite number, else null."""
    value = number(column)
    return F.when(F.abs(value) != float("inf"), value)


def minute_of_day(timestamp: Column) -> Column:
    return F.hour(timestamp) * 60 + F.minute(timestamp)


def session_condition(session: str) -> Column:
    """Whether a bar lies in a trading session."""
    if session not in SESSIONS:
        raise ValueError(f"unknown session {session!r}; known: {', '.join(SESSIONS)}")
    span = SESSIONS[session]
    return F.lit(True) if span is None else minute_of_day(F.col("timestamp")).between(*span)


def in_session(df: DataFrame, session: str) -> DataFrame:
    return df.filter(session_condition(session))


def bars_from_events(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Bars of the events table: one symbol per event type, open and close by event time."""
    stamp = F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz")
    return events.groupBy(F.col("event_type").alias("symbol"), stamp.alias("timestamp")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"),
    )
