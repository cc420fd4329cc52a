"""Time helpers. Every operator takes its evaluation time as a value."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000


def as_ntz(moment: dt.datetime) -> Column:
    """Timestamp literal without zone."""
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def latest_ts(df: DataFrame, column: str = "ts") -> dt.datetime | None:
    """Largest event time of a table; the default evaluation time (one row read)."""
    return df.agg(F.max(column)).first()[0]


def within(df: DataFrame, start: dt.datetime | None, end: dt.datetime | None) -> DataFrame:
    """Keep rows in the closed interval [start, end].

    Bounds are literals, so they reach the Parquet scan. A table written with day
    partitions (column ``dt``) is also cut down to the days that can match.
    """
    if start is not None:
        df = df.filter(F.col("ts") >= as_ntz(start))
        if "dt" in df.columns:
            df = df.filter(F.col("dt") >= F.lit(start.date()))
    if end is not None:
        df = df.filter(F.col("ts") <= as_ntz(end))
        if "dt" in df.columns:
            df = df.filter(F.col("dt") <= F.lit(end.date()))
    return df


def age_micros(ts: Column, as_of: dt.datetime) -> Column:
    """Microseconds from a row's time to the evaluation time."""
    return F.timestamp_diff("MICROSECOND", ts, as_ntz(as_of))


def minutes_before(moment: dt.datetime, minutes: float) -> dt.datetime:
    """Plain datetime arithmetic for window starts."""
    return moment - dt.timedelta(minutes=minutes)


def iso_to_ntz(text: Column) -> Column:
    """ISO 8601 text (with or without zone) to a UTC timestamp without zone; null if bad."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def ntz_to_iso(ts: Column) -> Column:
    """UTC timestamp as ISO 8601 text with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
