"""What a reader sees first: the strip, the alarm, the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.config import WEIGHTS
from tidemark.functions.dates import t_minus
from tidemark.functions.scoring import can_alert
from tidemark.functions.text import subject_label

MAX_STRIP_ROWS = 30
MIN_STRIP_ROWS = 3


def strip_order() -> list[Column]:
    return [F.col("days_until"), F.col("gating").desc(), F.col("label"), F.col("program_id")]


def select_strip(
    rows: DataFrame, horizon: int = WEIGHTS.strip_days, cap: int = MAX_STRIP_ROWS, fallback: int = MIN_STRIP_ROWS
) -> DataFrame:
    """The rows shown: all inside the horizon up to the cap, else the nearest few.

    The sort order already puts the horizon first, so the top ``cap`` rows
    decide everything; the window runs over those rows only.
    """
    top = rows.orderBy(*strip_order()).limit(cap)
    everyone = W.partitionBy(F.lit(1))
    ranked = top.withColumns(
        {
            "rank": F.row_number().over(everyone.orderBy(*strip_order())),
            "_any_inside": F.max(F.col("days_until") <= horizon).over(everyone),
        }
    )
    keep = F.when(F.col("_any_inside"), F.col("days_until") <= horizon).otherwise(F.col("rank") <= fallback)
    return ranked.filter(keep).drop("_any_inside")


def strip_summary(
    rows: DataFrame, horizon: int = WEIGHTS.strip_days, cap: int = MAX_STRIP_ROWS, fallback: int = MIN_STRIP_ROWS
) -> DataFrame:
    """One row: shown, not shown, and whether the strip borrowed from beyond the horizon."""
    counts = rows.agg(F.count("*").alias("total"), F.count_if(F.col("days_until") <= horizon).alias("inside"))
    wanted = F.when(F.col("inside") > 0, F.col("inside")).otherwise(F.least(F.lit(fallback), F.col("total")))
    shown = F.least(wanted, F.lit(cap))
    return counts.select(
        shown.cast("long").alias("shown"),
        (F.col("total") - shown).cast("long").alias("not_shown"),
        ((F.col("inside") == 0) & (F.col("total") > 0)).alias("borrowed"),
    )


def escalation(rows: DataFrame, days: int = WEIGHTS.escalation_days, strict: bool = True) -> DataFrame:
    """One row for the subject line: a gating row close by, else how many close soon, else the nearest.

    ``strict`` lets only dates that may alert take the subject line.
    """
    alarm = F.col("gating") & (F.col("days_until") <= days)
    if strict:
        alarm = alarm & can_alert(F.col("kind"), F.col("precision"), F.col("provenance"))
    order = F.struct("days_until", "label", "program_id")
    best = rows.agg(
        F.min(F.when(alarm, order)).alias("alarm"),
        F.count_if(F.col("days_until").between(0, days)).alias("closing_soon"),
        F.min(order).alias("nearest"),
    )
    short = lambda c: F.concat(t_minus(F.col(f"{c}.days_until")), F.lit(" "), subject_label(F.col(f"{c}.label")))
    return best.select(
        F.when(F.col("alarm").isNotNull(), "gating")
        .when(F.col("closing_soon") > 0, "closing")
        .when(F.col("nearest").isNotNull(), "nearest")
        .otherwise("none")
        .alias("tier"),
        F.when(F.col("alarm").isNotNull(), short("alarm"))
        .when(F.col("closing_soon") > 0, F.concat(F.col("closing_soon").cast("string"), F.lit(" closing soon")))
        .when(F.col("nearest").isNotNull(), F.concat(F.lit("next "), short("nearest")))
        .otherwise("nothing with a date")
        .alias("headline"),
        F.col("closing_soon").cast("long").alias("closing_soon"),
    )


def verify_headline(rows: DataFrame) -> DataFrame:
    """The smallest staleness is true of every row; a mixed set quotes a plain count."""
    agg = rows.agg(F.count("*").alias("n"), F.count("stale_days").alias("k"), F.min("stale_days").alias("least"))
    n = F.col("n").cast("string")
    noun = F.when(F.col("n") == 1, " deadline").otherwise(" deadlines")
    text = F.when(
        (F.col("k") == F.col("n")) & (F.col("n") > 0),
        F.concat(F.lit("VERIFY: "), n, noun, F.lit(" unchecked for "), F.col("least").cast("string"), F.lit("+ days")),
    ).otherwise(
        F.concat(F.lit("VERIFY: "), n, noun, F.when(F.col("n") == 1, " needs a human").otherwise(" need a human"))
    )
    return agg.select(text.alias("headline"), F.col("n").alias("rows"))


def next_unverified(verify: DataFrame, countdown: DataFrame) -> DataFrame:
    """The stalest row; else the soonest flagged one; else ``none``."""
    stalest = verify.filter("stale_days IS NOT NULL").select(
        F.lit(0).alias("tier"),
        (-F.col("stale_days")).alias("order"),
        F.col("program_id"),
        F.concat(F.col("label"), F.lit(" (stale "), F.col("stale_days").cast("string"), F.lit("d)")).alias("text"),
    )
    flagged = countdown.filter("needs_verification").select(
        F.lit(1).alias("tier"),
        F.col("days_until").alias("order"),
        "program_id",
        F.concat(F.col("label"), F.lit(" ("), t_minus(F.col("days_until")), F.lit(")")).alias("text"),
    )
    best = stalest.unionByName(flagged).agg(F.min(F.struct("tier", "order", "program_id", "text")).alias("best"))
    return best.select(F.coalesce(F.col("best.text"), F.lit("none")).alias("next_unverified"))


def obligation_stats(resolved: DataFrame) -> DataFrame:
    """Tracked, verified within a week, and the exact median score.

    Scores have two decimals and a small range, so the median is read from
    their counts: what is sorted is the distinct scores, never the rows.
    """
    kind = F.col("deadline.kind")
    counts = resolved.groupBy("score").agg(
        F.count("*").alias("n"),
        F.count_if(~kind.isin("rolling", "unknown")).alias("tracked"),
        F.count_if(F.col("stale_days") <= 7).alias("verified"),
    )
    return counts.agg(
        F.sum("n").alias("rows"),
        F.sum("tracked").alias("deadlines_tracked"),
        F.sum("verified").alias("verified_last_7d"),
        F.expr("percentile(score, 0.5, n)").alias("median_score"),
    )


def heartbeat(health: DataFrame) -> DataFrame:
    """Sources that work, out of how many, and the names of those that do not.

    There is one health row per source and run, so the names are as many as
    the configured sources at most.
    """
    bad = F.col("status").isin("failed", "degraded")
    return health.agg(
        F.count_if(F.col("status").isin("ok", "not-modified")).alias("ok"),
        F.count("*").alias("total"),
        F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col("source_name")))), ", ").alias("degraded"),
    )


def silence_guard(stats: DataFrame, countdown: DataFrame) -> DataFrame:
    """Dates on which something is tracked and the strip is empty: never a quiet day, always an error."""
    shown = countdown.select("date").distinct()
    return stats.filter("deadlines_tracked > 0").join(shown, "date", "left_anti").select("date", "deadlines_tracked")
