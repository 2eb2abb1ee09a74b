"""Times as column expressions. "Now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col


def parsed(c: str | Column, as_of: Column) -> Column:
    """A timestamp, or now where there is none."""
    return F.coalesce(F.try_to_timestamp(_col(c)), as_of)


def report_date(c: str | Column, as_of: Column) -> Column:
    """yyyymmdd at midnight, else as ``parsed``."""
    c = _col(c)
    return F.when(c.rlike("^[0-9]{8}$"), F.try_to_timestamp(c, F.lit("yyyyMMdd"))).otherwise(parsed(c, as_of))


def minutes_between(since: str | Column, as_of: Column) -> Column:
    """Whole and broken minutes."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(_col(since).cast("timestamp"))) / 60e6


def age_hours(since: str | Column, as_of: Column) -> Column:
    """Whole milliseconds that have passed, in hours: the difference is cut, not its ends."""
    us = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(_col(since).cast("timestamp"))
    return (us - us % 1000) / 1000 / 3.6e6


def rounded_minutes(since: str | Column, as_of: Column) -> Column:
    return F.floor(minutes_between(since, as_of) + 0.5)


def ago(since: str | Column, as_of: Column) -> Column:
    m = F.floor(minutes_between(since, as_of))
    h = F.floor(m / 60)
    s = lambda x, unit: F.concat(x.cast("string"), F.lit(unit))
    return F.when(m < 1, "just now").when(m < 60, s(m, "min ago")).when(h < 24, s(h, "h ago")).otherwise(s(F.floor(h / 24), "d ago"))


def absolute(at: str | Column) -> Column:
    return F.date_format(_col(at), "MMM d HH:mm")


def priority(score: str | Column) -> Column:
    s = F.coalesce(_col(score), F.lit(0.0))
    return F.when(s >= 8, "Urgent").when(s >= 6, "Important").when(s >= 4, "Watch").otherwise("Normal")


def section(score: str | Column) -> Column:
    s = F.coalesce(_col(score), F.lit(0.0))
    return F.when(s >= 8, "top").when(s >= 6, "middle").otherwise("rest")
