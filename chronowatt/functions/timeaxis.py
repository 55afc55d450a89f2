"""Time-axis expressions on zone-less timestamps.

Convention: the UTC instant is the key and the local time is a label, both held in
``TIMESTAMP_NTZ``. Nothing here reads the session time zone, so a table does not change when it is
rebuilt elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PARIS = "Europe/Paris"

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def midnight(day: Column | str) -> Column:
    """A date as a zone-less timestamp."""
    return _c(day).cast("date").cast("timestamp_ntz")


def instant_to_utc(ts: Column | str) -> Column:
    """A zoned instant as a zone-less UTC timestamp, whatever the session zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(ts)), F.expr(_EPOCH))


def plus_hours(ts: Column | str, hours: Column | int) -> Column:
    hours = F.lit(hours) if isinstance(hours, int) else hours
    return _c(ts) + F.make_dt_interval(F.lit(0), hours.cast("int"), F.lit(0), F.lit(0))


def plus_minutes(ts: Column | str, minutes: Column | int) -> Column:
    minutes = F.lit(minutes) if isinstance(minutes, int) else minutes
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0))


def hour_index(ts: Column | str) -> Column:
    """Whole hours since 1970, rounded down (also before 1970)."""
    ts = _c(ts)
    return F.unix_date(ts.cast("date")).cast("bigint") * 24 + F.hour(ts)


def minute_index(ts: Column | str) -> Column:
    return hour_index(ts) * 60 + F.minute(_c(ts))


def second_index(ts: Column | str) -> Column:
    return minute_index(ts) * 60 + F.second(_c(ts))


def from_hour_index(index: Column | str) -> Column:
    return F.timestamp_add("HOUR", _c(index), F.expr(_EPOCH))


def from_minute_index(index: Column | str) -> Column:
    return F.timestamp_add("MINUTE", _c(index), F.expr(_EPOCH))


def floor_hour(ts: Column | str) -> Column:
    """``date_trunc('hour')`` without the detour by the session zone."""
    ts = _c(ts)
    return midnight(ts) + F.make_dt_interval(F.lit(0), F.hour(ts), F.lit(0), F.lit(0))


def floor_minutes(ts: Column | str, step: int) -> Column:
    ts = _c(ts)
    minute = (F.floor(F.minute(ts) / step) * step).cast("int")
    return midnight(ts) + F.make_dt_interval(F.lit(0), F.hour(ts), minute, F.lit(0))


def utc_to_local(ts: Column | str, zone: str = PARIS) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(ts))


def local_to_utc(label: Column | str, zone: str = PARIS, fold: str = "later") -> Column:
    """Local label to UTC instant.

    A label that occurs twice in autumn is read as its second occurrence (``fold="later"``) or its
    first (``fold="earlier"``). A label skipped in spring moves forward; see :func:`is_phantom`.
    """
    label = _c(label)
    first = F.convert_timezone(F.lit(zone), F.lit("UTC"), label)
    if fold == "earlier":
        return first
    if fold != "later":
        raise ValueError(f"fold must be 'later' or 'earlier', not {fold!r}")
    second = plus_hours(first, 1)
    return F.when(utc_to_local(second, zone) == label, second).otherwise(first)


def is_phantom(label: Column | str, zone: str = PARIS) -> Column:
    """True for a label that never occurs: the round trip does not come back to it."""
    label = _c(label)
    return utc_to_local(local_to_utc(label, zone, "earlier"), zone) != label


def is_ambiguous(label: Column | str, zone: str = PARIS) -> Column:
    """True for a label that occurs twice."""
    return local_to_utc(label, zone, "later") != local_to_utc(label, zone, "earlier")


def utc_offset_hours(ts: Column | str, zone: str = PARIS) -> Column:
    """Legal offset, in hours, at a UTC instant."""
    ts = _c(ts)
    return (minute_index(utc_to_local(ts, zone)) - minute_index(ts)) / 60


def is_summer_time(ts: Column | str, zone: str = PARIS, summer_offset: int = 2) -> Column:
    return utc_offset_hours(ts, zone) == summer_offset


def hours_crossed(start: Column | str, end: Column | str) -> Column:
    """Number of hour boundaries between two instants (00:59 to 01:01 counts one)."""
    return hour_index(end) - hour_index(start)


def last_sunday(year: Column | str, month: int) -> Column:
    """Last Sunday of a month, the European clock-change day in March and October."""
    last = F.last_day(F.make_date(_c(year).cast("int"), F.lit(month), F.lit(1)))
    return F.date_sub(last, F.dayofweek(last) - 1)


def as_text(ts: Column | str) -> Column:
    """'yyyy-MM-dd HH:mm:ss', with the fraction down to the microsecond where there is one. A cast, because
    ``date_format`` would go through the session zone."""
    return _c(ts).cast("string")


def day_text(day: Column | str) -> Column:
    """'yyyy-MM-dd' of a date or of a zone-less timestamp."""
    return _c(day).cast("date").cast("string")


def iso_z(ts: Column | str) -> Column:
    """A UTC instant in the one ISO form every reader accepts."""
    return F.concat(F.translate(as_text(ts), " ", "T"), F.lit("Z"))


def winter_vintage(day_year: Column | str, month: Column | str) -> Column:
    """A winter is named after the year of its December."""
    year, month = _c(day_year), _c(month)
    return F.when(month == 12, year).otherwise(year - 1)


# Hours after which a feed is flagged, then held to be down.
FRESH_HOURS, STALE_HOURS = 12, 24


def as_of_age_hours(ts: Column | str, as_of: str) -> Column:
    """Age of an instant at a given moment (a parameter, so that a rerun says the same)."""
    moment = F.lit(as_of).cast("timestamp_ntz")
    return (_seconds(moment) - _seconds(_c(ts))) / 3600


def _seconds(ts: Column) -> Column:
    """Seconds since 1970 with their fraction. ``timestamp_diff`` would go through the session zone."""
    return minute_index(ts) * 60 + F.date_part(F.lit("SECOND"), ts).cast("double")


def freshness(age_hours: Column) -> Column:
    return F.when(age_hours > STALE_HOURS, "stale").when(age_hours > FRESH_HOURS, "warn").otherwise("fresh")
