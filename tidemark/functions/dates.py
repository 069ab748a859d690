"""Deadline dates: calendar days in a column zone, and what a written date means.

Publication dates need the opposite treatment of the future and live in
``pubdates``; nothing here clamps.
"""

from __future__ import annotations

import zoneinfo
from functools import cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import ZONE_NAMES
from tidemark.functions.common import col, let

FULL_DATE = r"^\d{4}-\d{2}-\d{2}$"
MONTH_DATE = r"^\d{4}-\d{2}$"
CLOCK = r"^([01]?\d|2[0-3]):[0-5]\d$"
ANCHOR = r"^\d{2}-\d{2}$"
MAX_YEARS_OUT = 8


@cache
def known_zones() -> tuple[str, ...]:
    """Time zones that this machine's tz files and the JVM both know: about 600 names, folded into the plan."""
    here = zoneinfo.available_timezones()
    context = SparkContext._active_spark_context
    if context is None:
        return tuple(sorted(here))
    return tuple(sorted(here & set(context._jvm.java.time.ZoneId.getAvailableZoneIds())))


def known_zone(zone: Column) -> Column:
    return zone.isin(*known_zones())


def usable_zone(zone: Column) -> Column:
    """The zone, or null if nobody knows it: a shift by an unknown zone would end the job."""
    return F.when(known_zone(zone), zone)


def wall_clock_to_utc(date: Column, hour: Column | int, minute: Column | int, zone: Column) -> Column:
    """The instant at which clocks in ``zone`` show this day and time."""
    hour = hour if isinstance(hour, Column) else F.lit(hour)
    minute = minute if isinstance(minute, Column) else F.lit(minute)
    return _minutes_to_utc(date, hour * 60 + minute, zone)


def _minutes_to_utc(date: Column, minutes: Column, zone: Column) -> Column:
    at = (F.unix_date(date).cast("long") * 1440 + minutes) * 60_000_000
    return F.to_utc_timestamp(F.timestamp_micros(at), zone)


def local_date(at: Column, zone: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def days_until(at: Column, zone: Column, now: Column) -> Column:
    """Whole calendar days in ``zone``, so one day always means tomorrow."""
    return F.datediff(local_date(at, zone), local_date(now, zone))


def hours_until(at: Column, now: Column) -> Column:
    return (F.unix_micros(at) - F.unix_micros(now)) / F.lit(3_600_000_000.0)


def parse_deadline(
    value: Column,
    zone: Column,
    now: Column,
    time_of_day: Column | None = None,
    precision_hint: Column | None = None,
) -> Column:
    """``struct(instant, precision, confident, warning)`` for a written deadline.

    A day without a time ends at 23:59 local; a month resolves to its first day;
    a date that does not exist or lies over eight years out is unknown.
    """
    none = F.lit(None).cast("string")
    tod = F.trim(time_of_day) if time_of_day is not None else none
    hint = precision_hint if precision_hint is not None else none
    return let(F.trim(value), lambda raw: let(_written_date(raw), lambda date: _resolve(raw, date, tod, hint, zone, now)))


def deadline_instant(value: Column, zone: Column, now: Column, time_of_day: Column | None = None) -> Column:
    """The ``instant`` of ``parse_deadline`` alone, for callers that show neither precision nor warning."""
    tod = F.trim(time_of_day) if time_of_day is not None else None
    at = _instant(_written_date(F.trim(value)), tod, zone)
    return let(at, lambda t: F.when(t <= latest(now), t))


def with_instant(df: DataFrame, value: Column, zone: Column, time_of_day: Column) -> DataFrame:
    """Add ``_raw``, ``_tod`` and ``_at``: a written deadline, its time of day, and their instant however far away.

    For tables of one deadline a row. Each step is a projection of its own, which generated code runs once,
    where ``let`` is interpreted; ``latest`` and ``precision_of`` make ``parse_deadline``'s answer of them.
    """
    df = df.withColumns({"_raw": F.trim(value), "_tod": F.trim(time_of_day)}).withColumn("_date", _written_date(F.col("_raw")))
    return df.withColumn("_at", _instant(F.col("_date"), F.col("_tod"), zone)).drop("_date")


def _written_date(raw: Column) -> Column:
    """A strict calendar date; the first day for a month."""
    month = F.concat(raw, F.lit("-01"))
    return F.when(raw.rlike(FULL_DATE), raw.try_cast("date")).when(raw.rlike(MONTH_DATE), month.try_cast("date"))


def _instant(date: Column, tod: Column | None, zone: Column) -> Column:
    """The time of day on a date in a zone, its last minute without one; null where the time is none."""
    at = lambda minutes: _minutes_to_utc(date, minutes, zone)
    last = at(F.lit(23 * 60 + 59))
    if tod is None:
        return last
    part = lambda i: F.split_part(tod, F.lit(":"), F.lit(i)).try_cast("int")
    return F.when(F.coalesce(tod == "", F.lit(True)), last).when(tod.rlike(CLOCK), at(part(1) * 60 + part(2)))


def latest(now: Column) -> Column:
    """The last instant that a written deadline may mean."""
    return now + F.make_dt_interval(F.lit(MAX_YEARS_OUT * 365))


def _resolve(raw: Column, date: Column, tod: Column, hint: Column, zone: Column, now: Column) -> Column:
    has_time = F.coalesce(tod != "", F.lit(False))
    time_ok = ~has_time | tod.rlike(CLOCK)
    limit = latest(now)
    return let(
        _instant(date, tod, zone), lambda at: _parsed(raw, date, F.when(at <= limit, at), at.isNotNull(), has_time, time_ok, hint)
    )


def precision_of(raw: Column, at: Column, has_time: Column, hint: Column) -> Column:
    return (
        F.when(at.isNull() | (hint == "unknown"), "unknown")
        .when((hint == "month") | raw.rlike(MONTH_DATE), "month")
        .when(has_time, "minute")
        .otherwise("day")
    )


def _parsed(
    raw: Column, date: Column, at: Column, exists: Column, has_time: Column, time_ok: Column, hint: Column
) -> Column:
    is_month = raw.rlike(MONTH_DATE)
    precision = precision_of(raw, at, has_time, hint)
    warning = (
        F.when(at.isNotNull() | raw.isNull() | (raw == ""), F.lit(None).cast("string"))
        .when(~(raw.rlike(FULL_DATE) | is_month), F.concat(F.lit("not a date layout: "), raw))
        .when(date.isNull(), F.concat(F.lit("no such day: "), raw))
        .when(~time_ok, F.lit("not a time of day"))
        .when(exists, F.concat(F.lit("over 8 years ahead ("), raw, F.lit("): check the year")))
    )
    return F.struct(
        at.alias("instant"),
        precision.alias("precision"),
        precision.isin("day", "minute").alias("confident"),
        warning.alias("warning"),
    )


def next_anchor(anchor: Column, after: Column, zone: Column) -> Column:
    """First 23:59 local on the month-day ``MM-DD`` strictly after an instant.

    A 29 February anchor falls on leap years only.
    """
    mmdd = F.trim(anchor)
    year = F.year(local_date(after, zone))
    candidates = F.transform(
        F.sequence(year, year + 2),
        lambda y: wall_clock_to_utc(
            F.concat(y.cast("string"), F.lit("-"), mmdd).try_cast("date"), 23, 59, zone
        ),
    )
    return F.when(mmdd.rlike(ANCHOR), F.array_min(F.filter(candidates, lambda t: t > after)))


def next_of_anchors(anchors: Column, after: Column, zone: Column) -> Column:
    return F.array_min(F.transform(anchors, lambda a: next_anchor(a, after, zone)))


def next_occurrence(recurrence: Column, after: Column, zone: Column) -> Column:
    """Annual and several-per-year cadences project; biennial and none do not."""
    return F.when(
        recurrence["cadence"] == "annual", next_anchor(recurrence["anchor"], after, zone)
    ).when(recurrence["cadence"] == "thrice-yearly", next_of_anchors(recurrence["anchors"], after, zone))


def zone_offset_minutes(zone: Column, at: Column) -> Column:
    return ((F.unix_seconds(F.from_utc_timestamp(at, zone)) - F.unix_seconds(at)) / 60).cast("int")


def zone_abbreviation(zone: Column, at: Column) -> Column:
    """Short zone name; a zone outside the table prints its offset as GMT+h[:mm]."""
    offset = zone_offset_minutes(zone, at)
    magnitude = F.abs(offset)
    minutes = F.when(
        magnitude % 60 == 0, F.lit("")
    ).otherwise(F.concat(F.lit(":"), F.lpad((magnitude % 60).cast("string"), 2, "0")))
    fallback = F.when(offset == 0, F.lit("GMT")).otherwise(
        F.concat(
            F.lit("GMT"),
            F.when(offset < 0, "-").otherwise("+"),
            F.floor(magnitude / 60).cast("string"),
            minutes,
        )
    )
    out = None
    for (name, minutes_east), short in ZONE_NAMES.items():
        hit = (zone == name) & (offset == minutes_east)
        out = F.when(hit, short) if out is None else out.when(hit, short)
    return out.otherwise(fallback)


def format_when(at: Column, zone: Column, precision: Column, reader_zone: str) -> Column:
    """A deadline in its own zone, and in the reader's too when they differ."""
    here = F.from_utc_timestamp(at, zone)
    there = F.from_utc_timestamp(at, F.lit(reader_zone))
    day_text = F.date_format(here, "d MMM yyyy")
    city = F.regexp_replace(F.element_at(F.split(zone, "/"), -1), "_", " ")
    timed = F.concat(day_text, F.lit(", "), F.date_format(here, "HH:mm"), F.lit(" "), zone_abbreviation(zone, at))
    return (
        F.when(precision == "month", F.concat(F.date_format(here, "MMMM yyyy"), F.lit(" (day unknown)")))
        .when(precision == "unknown", "date unknown")
        .when((precision == "day") & (zone == reader_zone), day_text)
        .when(precision == "day", F.concat(day_text, F.lit(" ("), city, F.lit(" time)")))
        .when(zone == reader_zone, timed)
        .otherwise(
            F.concat(
                timed,
                F.lit(" ("),
                F.date_format(there, "HH:mm"),
                F.lit(" "),
                zone_abbreviation(F.lit(reader_zone), at),
                F.lit(")"),
            )
        )
    )


def countdown_phrase(days: Column, hours: Column | None = None) -> Column:
    """``in 9 days``, ``tomorrow``, ``in 6 hours``, ``closed yesterday``."""
    if hours is None:
        today = F.lit("today")
    else:
        whole = F.greatest(F.lit(1), F.floor(hours))
        today = F.when(hours <= 0, "closed today").otherwise(
            F.concat(F.lit("in "), whole.cast("string"), F.when(whole == 1, " hour").otherwise(" hours"))
        )
    return (
        F.when(days < -1, F.concat(F.lit("closed "), F.abs(days).cast("string"), F.lit(" days ago")))
        .when(days == -1, "closed yesterday")
        .when(days == 0, today)
        .when(days == 1, "tomorrow")
        .otherwise(F.concat(F.lit("in "), days.cast("string"), F.lit(" days")))
    )


def t_minus(days: Column) -> Column:
    """``T-9`` before the day, ``T+3`` after it."""
    return (
        F.when(days.isNull(), "T-?")
        .when(days < 0, F.concat(F.lit("T+"), F.abs(days).cast("string")))
        .otherwise(F.concat(F.lit("T-"), days.cast("string")))
    )


def precision_note(precision: Column) -> Column:
    return F.when(precision == "month", "day unknown — check").when(precision == "unknown", "date unknown")


def stale_days(verified_on: Column, today: Column) -> Column:
    return F.datediff(today, col(verified_on))
