"""Time expressions. Sessions run in UTC; a time without an offset is UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_ts(col: Column) -> Column:
    """ISO text as TIMESTAMP, null when it is not one."""
    return F.try_to_timestamp(col)


def micros(col: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ."""
    return F.unix_micros(col.cast("timestamp"))


def from_micros(col: Column) -> Column:
    return F.timestamp_micros(col)


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def stamp(df: DataFrame, name: str = "scored_at") -> DataFrame:
    """Add the processing time, kept apart from the time of the event."""
    return df.withColumn(name, F.current_timestamp())
