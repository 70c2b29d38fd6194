"""Date helpers. A duration in days is floored, as a calendar difference of midnights is not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def coerce_date(text: Column, pattern: str | None = None) -> Column:
    """Timestamp of a text, null where it is not one."""
    return F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)


def utc_to_naive(text: Column) -> Column:
    """ISO text with an offset as a naive timestamp in UTC, whatever the session zone."""
    local = F.try_to_timestamp(text).cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)


def day(value: Column) -> Column:
    return F.to_date(value)


def floor_days(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end``, rounded towards minus infinity."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return ((micros - F.pmod(micros, F.lit(DAY_MICROS))) / DAY_MICROS).cast("long")


def age_at(date: Column, born: Column) -> Column:
    return floor_days(born, date) / 365.25


def decay_weight(date: Column, reference: Column, xi: float) -> Column:
    """exp(-xi * whole days before the reference); 1 where xi is 0."""
    return F.exp(-xi * floor_days(date, reference)) if xi > 0 else F.lit(1.0)


def snapshot_key(date: Column, grain: str = "month") -> Column:
    """Month start, or 1 July of the year."""
    if grain == "month":
        return F.trunc(date, "month")
    if grain == "year":
        return F.make_date(F.year(date), F.lit(7), F.lit(1))
    raise ValueError(f"grain must be 'month' or 'year', got {grain!r}")
