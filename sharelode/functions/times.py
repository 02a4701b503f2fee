"""Time expressions. All count from the epoch, so none depends on the session zone."""

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, TimestampNTZType


def time_literal(value: datetime, kind: DataType) -> Column:
    """A moment to compare a time column of type `kind` with; in UTC unless it has a zone."""
    moment = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    if isinstance(kind, TimestampNTZType):
        clock = moment.astimezone(timezone.utc).replace(tzinfo=None)
        return F.lit(clock.isoformat(sep=" ")).cast(kind)
    return F.lit(moment)


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def to_epoch_ms(share_date: Column) -> Column:
    return F.unix_millis(share_date)


def bucket_start(time: Column, seconds: int) -> Column:
    """Start of the epoch-aligned interval of `seconds` that holds `time`."""
    if isinstance(seconds, bool) or not isinstance(seconds, int) or seconds <= 0:
        raise ValueError(f"interval must be a positive whole number of seconds: {seconds!r}")
    return F.window(time, f"{seconds} seconds").start


def month_key(share_date: Column) -> Column:
    """Month in UTC as an integer such as 202412."""
    day = F.date_from_unix_date(F.floor(F.unix_seconds(share_date) / 86400).cast("int"))
    return F.year(day) * 100 + F.month(day)


def to_whole_second(time: Column) -> Column:
    """Nearest second, as a timestamp(0) column stores it."""
    return F.date_trunc("second", time + F.expr("interval 500 milliseconds"))
