"""Exact time arithmetic, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.operators.names import field


def require_seconds(ttl: float) -> None:
    if ttl <= 0:
        raise ValueError("the time-to-live must be greater than 0 seconds")


def require_timestamp(df: DataFrame, ts: str) -> None:
    if not isinstance(df.schema[ts].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"time field {ts!r} must be a timestamp, not {df.schema[ts].dataType.simpleString()}")


def with_times(df: DataFrame, ts: str) -> DataFrame:
    """``df``, which fails to compute when a row has no time: every way of an operator refuses it alike."""
    missing = F.raise_error(F.lit(f"every row needs a time in {ts!r}"))
    return df.withColumn(ts, F.when(field(ts).isNull(), missing).otherwise(field(ts)))


def plus_seconds(time: Column, kind: T.DataType, seconds: float) -> Column:
    """``time`` and exactly ``seconds`` more; an interval added to an instant would count calendar days."""
    if isinstance(kind, T.TimestampNTZType):
        return time + F.make_dt_interval(secs=F.lit(float(seconds)))
    return F.timestamp_micros(F.unix_micros(time) + round(seconds * 1_000_000))


def micros(df: DataFrame, ts: str) -> Column:
    """Time as whole microseconds; times without zone count on their own clock."""
    time = field(ts)
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        time = F.concat(time.cast("string"), F.lit("Z")).cast("timestamp")
    return F.unix_micros(time)
