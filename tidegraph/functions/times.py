"""Time arithmetic on TIMESTAMP_NTZ that does not depend on the session time zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MICROS = 1_000_000


def instant(value: str | dt.datetime | int | Column) -> Column:
    """A TIMESTAMP_NTZ from text, a datetime, epoch seconds or a column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, int):
        return seconds_to_ts(F.lit(value))
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01, read as UTC."""
    whole = (
        F.unix_date(ts.cast("date")).cast("bigint") * 86_400
        + F.hour(ts).cast("bigint") * 3_600
        + F.minute(ts).cast("bigint") * 60
    )
    return whole * MICROS + (F.date_part(F.lit("SECOND"), ts) * MICROS).cast("bigint")


def floor_div(a: Column, b: int | Column) -> Column:
    """Exact integer division rounded down, for a positive divisor."""
    b = b if isinstance(b, Column) else F.lit(b)
    return ((a - F.pmod(a, b)) / b).cast("bigint")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01, rounded down."""
    return floor_div(epoch_micros(ts), MICROS)


def micros_to_ts(micros: Column) -> Column:
    """The TIMESTAMP_NTZ that many microseconds after 1970-01-01."""
    seconds = (micros.cast("decimal(20,0)") / MICROS).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def seconds_to_ts(seconds: Column) -> Column:
    """The TIMESTAMP_NTZ that many seconds after 1970-01-01."""
    return micros_to_ts(seconds.cast("bigint") * MICROS)


def even_timestamps(spark: SparkSession, amount: int, start, stop) -> DataFrame:
    """``amount`` instants spread evenly from ``start``; the step is cut to whole seconds.

    A single instant is ``start``.
    """
    first, last = epoch_seconds(instant(start)), epoch_seconds(instant(stop))
    step = floor_div(last - first, amount - 1) if amount > 1 else F.lit(0)
    return spark.range(amount).select(
        F.col("id").alias("position"), seconds_to_ts(first + F.col("id") * step).alias("ts")
    )
