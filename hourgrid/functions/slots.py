"""Hour slots: whole UTC hours since the epoch, with local fields derived from a time zone.

Instants are microseconds since the epoch (long), slots are hour numbers (long): integer arithmetic is exact and gives
the same rows in any engine. Elapsed time is absolute; wall-clock fields come from the zone, so that a repeated
local hour has two slots and a skipped one has none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
TZ = "America/Los_Angeles"


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp; one without a zone is read in the session's (UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def whole(a: Column, b: int) -> Column:
    """Floor of a / b for whole numbers."""
    return ((a - F.pmod(a, F.lit(b))) / b).cast("long")


def hour_of(us: Column) -> Column:
    return whole(us, HOUR_US)


def instant(hour: Column) -> Column:
    return F.timestamp_seconds(hour * 3600)


def slot_start(hour: Column) -> Column:
    """The slot's first instant, without a zone, for output."""
    return instant(hour).cast("timestamp_ntz")


def local_time(hour: Column, tz: str = TZ) -> Column:
    return F.from_utc_timestamp(instant(hour), tz)


def local_hour(hour: Column, tz: str = TZ) -> Column:
    return F.hour(local_time(hour, tz))


def local_date(hour: Column, tz: str = TZ) -> Column:
    return F.to_date(local_time(hour, tz))


def iso_weekday(hour: Column, tz: str = TZ) -> Column:
    """1 (Monday) to 7."""
    return F.weekday(local_time(hour, tz)) + 1


def first_hour_of(date: Column, tz: str = TZ) -> Column:
    """The slot at which a local day begins; the next day's is 23, 24 or 25 later."""
    return hour_of(F.unix_micros(F.to_utc_timestamp(date.cast("timestamp"), tz)))


def slot_of_local(date: Column, hour: Column, tz: str = TZ) -> Column:
    """The slot of a local date and hour; the first of two where the hour repeats."""
    local = F.timestamp_seconds(F.unix_seconds(date.cast("timestamp")) + hour * 3600)
    return hour_of(F.unix_micros(F.to_utc_timestamp(local, tz)))


def slots_of_local(date: Column, hour: Column, tz: str = TZ) -> Column:
    """All slots of a local date and hour as an array: two where the hour repeats, none where it is skipped."""
    about = slot_of_local(date, hour, tz)
    return F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: about + o), lambda h: (local_date(h, tz) == date) & (local_hour(h, tz) == hour))


def overlap_us(start: Column, end: Column, hour: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end, (hour + 1) * HOUR_US) - F.greatest(start, hour * HOUR_US))


def cyclical_with_minutes(us: Column, tz: str = TZ) -> list[Column]:
    """The hour's angle with its minutes, and the weekday's."""
    local = F.from_utc_timestamp(F.timestamp_micros(us), tz)
    return [*cyclical(F.hour(local) + F.minute(local) / 60.0, 24, "hour"), *cyclical(F.weekday(local), 7, "weekday")]


def cyclical(value: Column, period: int, name: str) -> list[Column]:
    angle = value * (2 * 3.141592653589793) / period
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def period_of_day(hour: Column) -> Column:
    return F.when(hour < 6, "overnight").when(hour < 12, "morning").when(hour < 17, "afternoon").when(hour < 22, "evening").otherwise("late_night")
