"""What goes by a user's own clocks: local days, quiet hours, and when jobs run next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeloom.binding import Domain, query
from lodeloom.functions.zones import day_start, local_day, next_run, quiet

#: Jobs, with hour and minute of UTC and the weekday (Monday 0) of one that runs weekly.
JOBS = {"rollover": (0, 5, None), "re_engage": (10, 0, None), "lapsed": (10, 0, None), "sweep": (7, 0, 0)}

_ZONED = "SELECT i.*, u.tz, timezone(u.tz, to_timestamp(i.at_s)) AS local FROM instants i JOIN users u USING (uid)"


def zoned(d: Domain) -> DataFrame:
    return d.instants.join(d.users.select("uid", "tz"), "uid")


def _duck_instant(local: str, zone: str) -> str:
    """Of a local time that clocks show twice the first is meant."""
    late = f"CAST(epoch(timezone({zone}, {local})) AS BIGINT)"
    return f"CASE WHEN timezone({zone}, to_timestamp({late} - 3600)) = {local} THEN {late} - 3600 WHEN timezone({zone}, to_timestamp({late} - 1800)) = {local} THEN {late} - 1800 ELSE {late} END"


_START = _duck_instant("CAST(CAST(local AS DATE) AS TIMESTAMP)", "tz")
_AFTER = _duck_instant("CAST(CAST(local AS DATE) + 1 AS TIMESTAMP)", "tz")


@query("dat1_local_day", f"SELECT id, strftime(local, '%Y-%m-%d') AS day, {_START} AS starts_s, ({_AFTER}) - ({_START}) AS seconds FROM ({_ZONED})")
def dat1(d: Domain) -> DataFrame:
    """The user's day of an instant, when it begins, and how long it is, which isn't always 24 hours."""
    day = local_day(F.col("at_s"), F.col("tz"))
    starts = day_start(day, F.col("tz"))
    return zoned(d).select("id", F.date_format(day, "yyyy-MM-dd").alias("day"), starts.alias("starts_s"), (day_start(F.date_add(day, 1), F.col("tz")) - starts).alias("seconds"))


@query("flt6_quiet_local", f"SELECT id, hour(local) >= 22 OR hour(local) < 8 AS quiet FROM ({_ZONED})")
def flt6(d: Domain) -> DataFrame:
    return zoned(d).select("id", quiet(F.col("at_s"), F.col("tz")).alias("quiet"))


def _duck_next(hour: int, minute: int, weekday: int | None) -> str:
    at, step = hour * 3600 + minute * 60, 86_400 if weekday is None else 7 * 86_400
    # 1970-01-01 was a Thursday, 3
    first = f"at_s // 86400 * 86400 + {at}" if weekday is None else f"(at_s // 86400 + ({weekday} - (at_s // 86400 + 3) % 7 + 7) % 7) * 86400 + {at}"
    return f"CASE WHEN {first} >= at_s THEN {first} ELSE {first} + {step} END"


_EVENING = _duck_instant("CAST(CAST(local AS DATE) AS TIMESTAMP) + INTERVAL 150 MINUTE", "tz")
_NEXT_EVENING = _duck_instant("CAST(CAST(local AS DATE) + 1 AS TIMESTAMP) + INTERVAL 150 MINUTE", "tz")


@query(
    "stm13_job_schedule",
    f"SELECT id, {', '.join(f'{_duck_next(*at)} AS {name}' for name, at in JOBS.items())}, CASE WHEN {_EVENING} >= at_s THEN {_EVENING} ELSE {_NEXT_EVENING} END AS own_0230 FROM ({_ZONED})",
)
def stm13(d: Domain) -> DataFrame:
    """The next run of each job, which go by UTC, and of one at half past two by the user's clocks, when these change."""
    runs = {name: next_run(F.col("at_s"), hour, minute, "UTC", weekday) for name, (hour, minute, weekday) in JOBS.items()}
    return zoned(d).select("id", *(run.alias(name) for name, run in runs.items()), next_run(F.col("at_s"), 2, 30, F.col("tz")).alias("own_0230"))
