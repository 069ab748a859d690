"""Calendar bodies as event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import let, stage
from tidemark.functions.dates import known_zone, usable_zone

VEVENT = r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT"
NESTED = r"(?s)BEGIN:(V[A-Z]+)\n.*?END:\1\n?"


def unfold(body: Column) -> Column:
    """Line ends made plain and folded lines joined."""
    plain = F.regexp_replace(F.regexp_replace(body, "\r\n", "\n"), "\r", "\n")
    return F.regexp_replace(plain, "\n[ \t]", "")


def _property(event: Column, name: str, group: int) -> Column:
    """Parameters (group 1) or value (group 2) of the last property of that name."""
    pattern = rf'(?im)^{name}((?:;[A-Z0-9-]+=(?:"[^"\n]*"|[^":;\n]*))*):(.*)$'
    return F.regexp_extract(event, pattern, group)


def _unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\[nN]", "\n")
    return F.trim(F.regexp_replace(text, r"\\([\;,])", "$1"))


def normal_start(value: Column, params: Column) -> Column:
    """``struct(dtstart, all_day)``; null when the date does not exist or lies outside 1970..2100."""
    tzid = F.regexp_extract(params, r'(?i);TZID="?([^";:]+)"?', 1)
    date = F.when(value.rlike(r"^\d{8}$"), F.try_to_date(value, "yyyyMMdd"))
    stamp = F.when(
        value.rlike(r"^\d{8}T\d{6}Z?$") & ~params.rlike(r"(?i);VALUE=DATE(;|$)"),
        F.try_to_timestamp(F.left(value, F.lit(15)), F.lit("yyyyMMdd'T'HHmmss")),
    )
    in_range = lambda d: F.year(d).between(1970, 2100)
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    zulu = iso + "'Z'"
    start = lambda text, all_day: F.struct(text.alias("dtstart"), F.lit(all_day).alias("all_day"))
    return (
        F.when(in_range(date), start(F.date_format(date, "yyyy-MM-dd"), True))
        .when(in_range(stamp) & value.endswith("Z"), start(F.date_format(stamp, zulu), False))
        .when(
            in_range(stamp) & known_zone(tzid),
            start(F.date_format(F.to_utc_timestamp(stamp, usable_zone(tzid)), zulu), False),
        )
        .when(in_range(stamp), start(F.date_format(stamp, iso), False))
    )


def parse_calendars(bodies: DataFrame, keep: list[str]) -> DataFrame:
    """One row per dated VEVENT of each body; ``keep`` names the columns to carry along.

    A body without entries leaves no row: count bodies against rows to see it.
    """
    events = F.regexp_extract_all(unfold(F.col("body")), F.lit(VEVENT), F.lit(1))
    df = bodies.select(*keep, F.posexplode(events).alias("pos", "raw"))
    # alarms and other nested components carry properties of their own
    df = stage(df, {"event": F.regexp_replace("raw", NESTED, "")})
    e = F.col("event")
    start = let(
        F.trim(_property(e, "DTSTART", 2)), lambda v: let(_property(e, "DTSTART", 1), lambda p: normal_start(v, p))
    )
    df = stage(df, {"start": start})
    optional = lambda c: F.when(c != "", c)
    return df.filter(F.col("start").isNotNull()).select(
        *keep,
        "pos",
        _unescape(_property(e, "UID", 2)).alias("uid"),
        _unescape(_property(e, "SUMMARY", 2)).alias("summary"),
        F.col("start.dtstart").alias("dtstart"),
        F.trim(_property(e, "DTSTART", 2)).alias("dtstart_raw"),
        F.col("start.all_day").alias("all_day"),
        optional(_unescape(_property(e, "DESCRIPTION", 2))).alias("description"),
        optional(F.trim(_property(e, "URL", 2))).alias("url"),
        optional(F.upper(F.trim(_property(e, "STATUS", 2)))).alias("status"),
    )
