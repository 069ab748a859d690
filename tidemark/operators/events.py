"""Dated public events: what an entry says, which come up, which are watched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.config import EVENT_HORIZON_DAYS, MARKET_ZONE, NOT_TICKERS, WATCHED_TICKERS
from tidemark.functions.common import let, stage
from tidemark.functions.dates import days_until, local_date, wall_clock_to_utc

# Patterns and caps.
TICKER = r"^[A-Z]{2,5}(?:\.[A-Z]{1,2})?$"
EVENT_PHRASE = r"(?i)\s*\b(?:FDA\s+)?(?:PDUFA|ADCOMM?|ADVISORY\s+COMMITTEE)\b\s*$"
WATCHED_CAP = 12
UNWATCHED_CAP = 8
KIND_LABELS = {"pdufa": "PDUFA", "adcomm": "AdCom"}


def ticker_of(summary: Column) -> Column:
    first = F.regexp_extract(F.trim(summary), r"^(\S+)", 1)
    return F.when(first.rlike(TICKER) & ~first.isin(*NOT_TICKERS), first)


def kind_of(summary: Column, fallback: Column) -> Column:
    return (
        F.when(summary.rlike(r"(?i)\bad\s?comm?\b|advisory\s+committee"), "adcomm")
        .when(summary.rlike(r"(?i)\bpdufa\b"), "pdufa")
        .otherwise(fallback)
    )


def describe(summary: Column, fallback_kind: Column) -> Column:
    """``struct(ticker, company, label, kind)`` out of one summary line."""

    def split(text: Column, ticker: Column) -> Column:
        rest = F.when(ticker.isNotNull(), F.trim(F.substring(text, F.length(ticker) + 1, F.length(text)))).otherwise(text)
        return let(rest, lambda r: let(F.trim(F.regexp_replace(r, EVENT_PHRASE, "")), lambda c: entry(text, ticker, r, c)))

    def entry(text: Column, ticker: Column, rest: Column, company: Column) -> Column:
        return F.struct(
            ticker.alias("ticker"),
            F.when(company != "", company).alias("company"),
            F.when(company != "", rest).otherwise(text).alias("label"),
            kind_of(text, fallback_kind).alias("kind"),
        )

    return let(F.trim(summary), lambda text: let(ticker_of(text), lambda t: split(text, t)))


def calendar_day(all_day: Column, dtstart: Column, zone: str = MARKET_ZONE) -> Column:
    """The printed day: as written for all-day and floating starts, converted for instants."""
    at = F.try_to_timestamp(dtstart, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.when(all_day, F.try_to_date(dtstart, "yyyy-MM-dd")).when(
        dtstart.endswith("Z"), local_date(at, F.lit(zone))
    ).otherwise(F.try_to_date(F.left(dtstart, F.lit(10)), "yyyy-MM-dd"))


def watched(ticker: Column) -> Column:
    return F.coalesce(ticker.isin(*WATCHED_TICKERS), F.lit(False))


def resolve_events(entries: DataFrame, now: Column, horizon: int = EVENT_HORIZON_DAYS, zone: str = MARKET_ZONE) -> DataFrame:
    """Add the event fields, ``days_until``, ``watched`` and ``drop_reason`` to calendar entries.

    ``entries``: feed_id, feed_name, feed_rank, feed_kind, uid, summary,
    dtstart, all_day, status.
    """
    df = stage(
        entries,
        {
            "event": describe(F.coalesce("summary", F.lit("")), F.col("feed_kind")),
            "day": calendar_day(F.col("all_day"), F.col("dtstart"), zone),
        },
    )
    noon = wall_clock_to_utc(F.col("day"), 12, 0, F.lit(zone))
    df = df.withColumn("days_until", days_until(noon, F.lit(zone), now))
    return stage(
        df,
        {
            "days_until": F.col("days_until"),
            "ticker": F.col("event.ticker"),
            "company": F.col("event.company"),
            "label": F.col("event.label"),
            "kind": F.col("event.kind"),
            "watched": watched(F.col("event.ticker")),
            "drop_reason": F.when(F.upper("status") == "CANCELLED", "cancelled")
            .when(F.trim(F.coalesce("summary", F.lit(""))) == "", "untitled")
            .when(F.col("day").isNull(), "undated")
            .when(~F.col("days_until").between(0, horizon), "outside-horizon"),
        },
    ).drop("event")


def dedupe_events(events: DataFrame) -> DataFrame:
    """One row per date, kind and ticker (label without one); the earlier feed wins."""
    best = W.partitionBy("day", "kind", F.coalesce("ticker", "label")).orderBy("feed_rank", "label", "uid")
    return events.withColumn("_copy", F.row_number().over(best)).filter("_copy = 1").drop("_copy")


def event_order() -> list[Column]:
    return [F.col("watched").desc(), F.col("day"), F.coalesce("ticker", F.lit("")), F.col("label"), F.col("uid"), F.col("feed_id")]


def display_order() -> list[Column]:
    return [F.col("days_until"), F.col("day"), F.coalesce("ticker", "label"), F.col("label"), F.col("uid")]


def shown_events(events: DataFrame, watched_cap: int = WATCHED_CAP, unwatched_cap: int = UNWATCHED_CAP) -> DataFrame:
    """The first watched and unwatched rows, each with its own cap.

    The limit on ``rank`` reaches into the tasks: each sends on its best few
    rows per group, and only those are ranked together.
    """
    rank = F.row_number().over(W.partitionBy("watched").orderBy(*display_order()))
    few = events.withColumn("rank", rank).filter(F.col("rank") <= max(watched_cap, unwatched_cap))
    return few.filter(F.col("rank") <= F.when(F.col("watched"), watched_cap).otherwise(unwatched_cap))


def hidden_events(events: DataFrame, watched_cap: int = WATCHED_CAP, unwatched_cap: int = UNWATCHED_CAP) -> DataFrame:
    cap = F.when(F.col("watched"), watched_cap).otherwise(unwatched_cap)
    return events.groupBy("watched").agg(F.count("*").alias("total")).withColumn(
        "hidden", F.greatest(F.lit(0).cast("long"), F.col("total") - cap)
    )


def unless_broken(events: DataFrame, health: DataFrame, keys: list[str]) -> DataFrame:
    """A half-read calendar shows nothing at all: no events of any feed for a run with a failed or degraded one.

    ``keys`` name the run, such as its date.
    """
    broken = health.filter(F.col("status").isin("failed", "degraded")).select(*keys).distinct()
    return events.join(broken, keys, "left_anti")


def feed_status(resolved: DataFrame) -> DataFrame:
    """Counts per feed: no entries at all is a fault, none upcoming is a quiet quarter.

    A feed whose body held no entry is represented by one row with a null ``uid``.
    """
    is_entry = F.col("uid").isNotNull()
    reason = lambda r: F.count_if(is_entry & (F.col("drop_reason") == r))
    df = resolved.groupBy("feed_id").agg(
        F.count_if(is_entry).alias("parsed"),
        F.count_if(is_entry & F.col("drop_reason").isNull()).alias("kept"),
        reason("cancelled").alias("cancelled"),
        reason("untitled").alias("untitled"),
        reason("undated").alias("undated"),
    )
    return df.withColumn("status", F.when(F.col("parsed") == 0, "degraded").otherwise("ok"))


def event_title(ticker: Column, company: Column, label: Column) -> Column:
    joined = F.concat_ws(" — ", F.when(F.trim(ticker) != "", ticker), F.when(F.trim(company) != "", company))
    return F.when(joined != "", joined).otherwise(label)


def event_extra(ticker: Column, company: Column, label: Column) -> Column:
    """The label, when it says more than the title already does."""
    known = F.lower(F.trim(F.concat_ws(" ", ticker, company)))
    lower = F.lower(F.trim(label))
    repeats = (known != "") & (F.contains(lower, known) | F.contains(known, lower))
    return F.when(repeats | (lower == ""), "").otherwise(F.trim(label))


def event_detail(day: Column, kind: Column, ticker: Column, company: Column, label: Column) -> Column:
    shown = kind
    for name, text in KIND_LABELS.items():
        shown = F.when(kind == name, text).otherwise(shown)
    extra = event_extra(ticker, company, label)
    return F.concat_ws(" · ", day.cast("string"), shown, F.when(extra != "", extra))


def provenance(health: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct feed names behind a section; feeds are configured by hand, so they are few."""
    names = health.select(F.col("feed_name").alias("name")).unionByName(events.select(F.col("feed_name").alias("name")))
    names = names.filter(F.trim("name") != "").distinct()
    return names.agg(F.array_join(F.array_sort(F.collect_set("name")), " + ").alias("sources"))
