"""Date functions; every "now" is an argument, so that results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(as_of: str) -> Column:
    """A time without zone from its text."""
    return F.lit(as_of).cast("timestamp_ntz")


def epoch_day(ts: Column) -> Column:
    return F.unix_date(ts.cast("date"))


def cutoff(as_of: str, days: int) -> Column:
    """as_of less so many days."""
    return moment(as_of) - F.make_dt_interval(F.lit(days))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.timestamp_diff("MICROSECOND", moment("1970-01-01 00:00:00"), ts.cast("timestamp_ntz"))


def age_days(ts: Column, as_of: str) -> Column:
    """Days since ts with their fraction, not below zero."""
    seconds = F.timestamp_diff("MICROSECOND", ts.cast("timestamp_ntz"), moment(as_of)) / F.lit(1e6)
    return F.greatest(F.lit(0.0), seconds / F.lit(86400.0))


def minute_of(ts: Column) -> Column:
    return F.date_trunc("MINUTE", ts).cast("timestamp_ntz")


def day_of(ts: Column) -> Column:
    return F.date_trunc("DAY", ts).cast("timestamp_ntz")


def parsed_day(text: Column) -> Column:
    """yyyy-MM-dd as midnight; null if it is no date."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")


def minute_stamp(ts: Column) -> Column:
    """yyyyMMddHHmm, as a query API takes it."""
    return F.date_format(ts, "yyyyMMddHHmm")


def day_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def next_daily(as_of: Column, hour: int, minute: int = 0) -> Column:
    """The next time of day hour:minute after as_of: today if it is still to come, else tomorrow."""
    today = day_of(as_of) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))
    return F.when(today > as_of, today).otherwise(today + F.make_dt_interval(F.lit(1)))


def is_stale(taken: Column, as_of: str, minutes: int = 120) -> Column:
    """Whether a lease that was taken then may be taken over: its age is over some minutes, or nobody holds it."""
    return F.coalesce(taken < moment(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)), F.lit(True))
