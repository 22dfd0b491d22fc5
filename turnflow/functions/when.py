"""Clock times, time zones and minutes as column expressions. The session's time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnflow.constants import DAY_STARTS_MIN


def plus_minutes(ts: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, ts)


def hhmm_split(hhmm: Column) -> Column:
    """struct(hour, minute, days): 2400 is midnight at the end of the day."""
    hour = F.floor(hhmm / 100)
    over = hour == 24
    return F.when(
        hhmm.isNotNull(),
        F.struct(F.when(over, F.lit(0)).otherwise(hour).cast("int").alias("hour"), (hhmm % 100).cast("int").alias("minute"), F.when(over, F.lit(1)).otherwise(F.lit(0)).alias("days")),
    )


def localize_to_utc(day: Column, hhmm: Column, tz: Column) -> Column:
    """The UTC time of a local date and HHMM. Null without HHMM or zone, and where the clock change makes the local
    time ambiguous or skips it: a UTC time an hour off then has the same local time, or none has."""
    local = plus_minutes(day.cast("timestamp"), (F.floor(hhmm / 100) * 60 + hhmm % 100).cast("int"))
    utc = F.to_utc_timestamp(local, tz)
    back = lambda hours: F.from_utc_timestamp(plus_minutes(utc, F.lit(60 * hours)), tz)
    return F.when((back(0) == local) & (back(1) != local) & (back(-1) != local), utc)


def local_hhmm(utc: Column, tz: Column) -> Column:
    local = F.from_utc_timestamp(utc, tz)
    return (F.hour(local) * 100 + F.minute(local)).cast("long")


def operating_day(dep_utc: Column, tz: Column, starts_min: int = DAY_STARTS_MIN) -> Column:
    """The local date of a day that starts at 04:30."""
    return F.to_date(plus_minutes(F.from_utc_timestamp(dep_utc, tz), F.lit(-starts_min)))


def minutes_between(a: Column, b: Column) -> Column:
    """Minute boundaries from a to b."""
    whole = lambda t: F.unix_timestamp(F.date_trunc("minute", t))
    return ((whole(b) - whole(a)) / 60).cast("long")
