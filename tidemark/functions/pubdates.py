"""Publication dates. A future one is a feed error and is clamped; deadlines are in ``dates``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.common import let, squish
from tidemark.functions.dates import wall_clock_to_utc

# Layouts of dates in feeds.
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"
MAIL_DATE = r"(?i)^(?:[A-Za-z]{3,9},\s*)?(\d{1,2}\s[A-Za-z]{3})[a-z]*\s(\d{4})\s(\d{2}:\d{2})(:\d{2})?\s?([A-Za-z]{2,4}|[+-]\d{4})$"
PRESS_DATE = r"(?i)^([A-Za-z]{3})[A-Za-z]{0,6}\.?\s+(\d{1,2}),\s*(\d{4})\s+(\d{1,2}):(\d{2})\s*([ap])\.?m\.?$"
BARE_DAY = r"^(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]{0,6}\.?\s+(\d{4})$"
LOOSE_DAY = r"^([A-Za-z]{3})[A-Za-z]{0,6}\.?\s+(\d{1,2}),?\s+(\d{4})$"

# Named offsets that mail-style dates carry.
NAMED_OFFSETS = {
    "GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def _title_month(text: Column) -> Column:
    return F.initcap(F.lower(text))


def _day(day: Column, month: Column, year: Column) -> Column:
    return F.try_to_date(F.concat_ws(" ", day, _title_month(month), year), "d MMM yyyy")


def parse_press_date(raw: Column, zone: Column) -> Column:
    """``Jul 31, 2026 8:59am`` read as wall-clock time in ``zone``."""
    return let(squish(raw), lambda text: _press_date(text, zone))


def _press_date(text: Column, zone: Column) -> Column:
    part = lambda i: F.regexp_extract(text, PRESS_DATE, i)
    hit = text.rlike(PRESS_DATE)
    date = _day(part(2), part(1), part(3))
    hour12 = part(4).try_cast("int") % 12
    hour = hour12 + F.when(F.lower(part(6)) == "p", 12).otherwise(0)
    return F.when(hit, wall_clock_to_utc(date, hour, part(5).try_cast("int"), zone))


def _mail_date(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, MAIL_DATE, i)
    zone = F.upper(part(5))
    offset = F.when(zone.rlike(r"^[+-]\d{4}$"), zone)
    for name, value in NAMED_OFFSETS.items():
        offset = offset.when(zone == name, value)
    seconds = F.when(part(4) == "", ":00").otherwise(part(4))
    stamp = F.concat(_title_month(part(1)), F.lit(" "), part(2), F.lit(" "), part(3), seconds, offset)
    return F.when(text.rlike(MAIL_DATE), F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ssZ")))


def parse_feed_date(
    raw: Column, now: Column, zone: Column | None = None, max_future_hours: int = 36
) -> Column:
    """``struct(at, precision, confident, warning)``; six layouts, tried in order."""
    zone = zone if zone is not None else F.lit("UTC")
    limit = now + F.make_dt_interval(F.lit(0), F.lit(max_future_hours))
    return let(
        squish(raw),
        lambda text: let(_layouts(text, zone), lambda found: _dated(text, found, limit)),
    )


def _layouts(text: Column, zone: Column) -> Column:
    """``struct(at, precision, firm)`` of the first layout that fits."""
    part = lambda p, i: F.regexp_extract(text, p, i)
    named_day = lambda p, d, m: _day(part(p, d), part(p, m), part(p, 3))
    at = lambda value, precision, firm=True: F.struct(
        value.alias("at"), precision.alias("precision"), F.lit(firm).alias("firm")
    )
    iso_precision = F.when(text.rlike(r"T\d{2}:\d{2}(Z|[+-])"), "minute").otherwise("second")
    tries = F.array(
        F.when(text.rlike(ISO_INSTANT), at(F.try_to_timestamp(_colon_offset(text)), iso_precision)),
        F.when(
            text.rlike(ISO_DAY),
            at(wall_clock_to_utc(F.try_to_date(text, "yyyy-MM-dd"), 12, 0, F.lit("UTC")), F.lit("day")),
        ),
        at(_mail_date(text), F.lit("second")),
        at(_press_date(text, zone), F.lit("minute")),
        F.when(text.rlike(BARE_DAY), at(wall_clock_to_utc(named_day(BARE_DAY, 1, 2), 12, 0, zone), F.lit("day"))),
        F.when(text.rlike(LOOSE_DAY), at(named_day(LOOSE_DAY, 2, 1).cast("timestamp"), F.lit("day"), False)),
    )
    return F.get(F.filter(tries, lambda t: t["at"].isNotNull()), F.lit(0))


def _colon_offset(text: Column) -> Column:
    """Write seconds and the offset's colon where the layout leaves them out."""
    seconds = F.regexp_replace(text, r"(T\d{2}:\d{2})(Z|[+-])", "$1:00$2")
    return F.regexp_replace(seconds, r"([+-]\d{2})(\d{2})$", "$1:$2")


def _dated(text: Column, found: Column, limit: Column) -> Column:
    at = found["at"]
    future = F.coalesce(at > limit, F.lit(False))
    warning = (
        F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
        .when(at.isNull(), F.concat(F.lit("unparseable-date:"), text))
        .when(future, F.concat(F.lit("future-date-clamped:"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
        .when(~found["firm"], F.concat(F.lit("loose-date-parse:"), text))
    )
    return F.struct(
        F.when(future, limit).otherwise(at).alias("at"),
        F.coalesce(found["precision"], F.lit("unknown")).alias("precision"),
        (F.coalesce(found["firm"], F.lit(False)) & ~future).alias("confident"),
        warning.alias("warning"),
    )


def age_hours(published: Column, now: Column, undated: float = 720.0) -> Column:
    """Hours since publication, never negative; an undated item counts as thirty days old."""
    age = (F.unix_micros(now) - F.unix_micros(published)) / F.lit(3_600_000_000.0)
    return F.when(published.isNull(), F.lit(undated)).otherwise(F.greatest(F.lit(0.0), age))


def iso_day(at: Column, zone: Column | None = None) -> Column:
    shifted = at if zone is None else F.from_utc_timestamp(at, zone)
    return F.date_format(shifted, "yyyy-MM-dd")


def iso_week(at: Column) -> Column:
    date = F.to_date(at)
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), date).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(date).cast("string"), 2, "0"),
    )


def iso_week_start(at: Column) -> Column:
    return F.to_date(F.date_trunc("week", at))
