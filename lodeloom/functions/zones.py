"""Local days, hours and schedules in zones that change their clocks, whatever the session's zone.

Instants are epoch seconds. Local times are timestamps without a zone. A local time that clocks skip stands for the instant as
long after the change; one that they show twice stands for the first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def local_time(at_s: Column, zone: Column | str) -> Column:
    """What clocks show in a zone (a column, or a zone's name)."""
    utc = F.expr(_EPOCH) + F.make_dt_interval(secs=at_s.cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone) if isinstance(zone, str) else zone, utc)


def instant(local: Column, zone: Column | str) -> Column:
    """The epoch second at which clocks of a zone show a local time."""
    utc = F.convert_timezone(F.lit(zone) if isinstance(zone, str) else zone, F.lit("UTC"), local)
    return (utc - F.expr(_EPOCH)).cast("interval second").cast("decimal(18,6)").cast("long")


def local_day(at_s: Column, zone: Column | str) -> Column:
    return local_time(at_s, zone).cast("date")


def day_start(day: Column, zone: Column | str) -> Column:
    """The first second of a local day; where clocks skip midnight, that of the change."""
    return instant(day.cast("timestamp_ntz"), zone)


def quiet(at_s: Column, zone: Column | str, begin: int = 22, end: int = 8) -> Column:
    """Whether it is night by a zone's clocks."""
    hour = F.hour(local_time(at_s, zone))
    return (hour >= begin) | (hour < end)


def next_run(at_s: Column, hour: int, minute: int, zone: Column | str = "UTC", weekday: int | None = None) -> Column:
    """The first instant, at at_s or after it, at which a job runs that goes daily (or on a weekday, Monday 0) at a time of a zone."""
    today, step = local_day(at_s, zone), 1 if weekday is None else 7
    first = today if weekday is None else F.date_add(today, F.pmod(F.lit(weekday) - F.weekday(today), F.lit(7)))
    at = lambda day: instant(day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour), mins=F.lit(minute)), zone)
    return F.when(at(first) >= at_s, at(first)).otherwise(at(F.date_add(first, step)))
