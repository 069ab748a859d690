"""One day's digest from its halves, as tables, each row computed and counted once.

The halves share no input, so a broken feed cannot take the countdown with it.
Every table that several parts read is written once; how many rows it keeps and
why it drops the others are metrics of that write. Delivering a day stages its
parts, counts broken rules in the same writes, and then commits the day.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import WEIGHTS, Weights
from tidemark.operators import accounting as A
from tidemark.operators import events as E
from tidemark.operators import lanes as L
from tidemark.operators import monitoring as M
from tidemark.operators import news as N
from tidemark.operators import obligations as O
from tidemark.operators import quality as Q
from tidemark.sources import digests

STATS = (
    "fetched long, kept long, deadlines_tracked long, verified_last_7d long, median_score double, dropped map<string, long>"
)
STATUS = "date date, outcome string, sources_ok long, sources_total long, items_kept long, deadlines_tracked long"


@dataclass
class Day:
    """The parts of a day, and what their writes counted."""

    parts: dict[str, DataFrame]
    counts: dict[str, Mapping] = field(default_factory=dict)

    @property
    def dropped(self) -> dict[str, int]:
        return A.drops(*self.counts.values())


def obligation_half(programs: DataFrame, clock: O.Clock, rungs: DataFrame, rolling: DataFrame, w: Weights = WEIGHTS) -> tuple[DataFrame, dict]:
    """Every programme of the registry with its outcome, and the day's obligation figures."""
    built = O.build(programs, clock, rungs, rolling, w, with_gated=True).drop("cycles", "cycle")
    resolved, kind = F.col("gate_reason").isNull(), F.col("deadline.kind")
    counts = A.drop_counts(A.OBLIGATION_DROPS) | {
        "tracked": F.count_if(resolved & ~kind.isin("rolling", "unknown")),
        "verified": F.count_if(resolved & (F.col("stale_days") <= 7)),
        # scores have two decimals: the buffer holds the distinct ones
        "median": F.percentile(F.when(F.col("drop_reason").isNull(), F.col("score")), 0.5),
    }
    return A.materialize_counted(built, "obligations", counts)


def news_half(items: DataFrame, rank: Callable[[DataFrame], DataFrame], w: Weights = WEIGHTS) -> tuple[DataFrame, dict]:
    """The day's best news, and what became of all others.

    Copies of an address count as ``duplicate``, what is kept beyond the day's
    cap as ``over-cap``: both follow from the counts of the two writes. The cap
    is a bounded number of rows, so no window sorts all items in one task.
    """
    collected = items.withColumn("drop_reason", N.intake_drop())
    collected, intake = A.materialize_counted(collected, "collected", A.drop_counts(A.INTAKE_DROPS))
    ranked = rank(collected.filter("drop_reason IS NULL").drop("drop_reason"))
    scratch = [c for c in ranked.columns if c.startswith("_")]
    ranked = ranked.drop(*scratch, "lane_scores", "scorable", "stripped")
    ranked, scored = A.materialize_counted(ranked, "news", A.drop_counts(A.NEWS_DROPS))
    best = ranked.filter("drop_reason IS NULL").orderBy(F.col("score").desc(), "item_id").limit(w.max_items_per_day)
    kept = min(scored["kept"], w.max_items_per_day)
    drops = {"duplicate": intake["kept"] - scored["rows"], "over-cap": scored["kept"] - kept}
    for reason, n in A.drops(intake, scored).items():
        drops[reason] = drops.get(reason, 0) + n
    return best, {"rows": intake["rows"], "kept": kept} | {f"drop:{r}": n for r, n in drops.items()}


def verify_part(built: DataFrame, pages: DataFrame | None = None, programs: DataFrame | None = None) -> DataFrame:
    """Obligations to verify, and pages that changed; only the registry ever names a date."""
    rows = O.verify_rows(built.filter("gate_reason IS NULL"))
    if pages is None:
        return rows
    return rows.unionByName(M.page_verify_rows(pages, programs if programs is not None else built))


def health_part(spark: SparkSession, programs: int, kept: int, sources: DataFrame | None = None, feeds: DataFrame | None = None) -> DataFrame:
    """One row for the registry, one per news source and one per event feed.

    ``sources``: of ``monitoring.source_health``; ``feeds``: of ``events.feed_status``.
    """
    columns = ["section", "source_id", "status", F.col("items_parsed").cast("long"), F.col("items_kept").cast("long")]
    rows = spark.range(1).select(
        F.lit("registry").alias("section"), F.lit("registry").alias("source_id"), F.lit("ok").alias("status"),
        F.lit(programs).alias("items_parsed"), F.lit(kept).alias("items_kept"),
    ).select(*columns)
    if sources is not None:
        rows = rows.unionByName(sources.withColumn("section", F.lit("source")).select(*columns))
    if feeds is not None:
        named = {"feed_id": "source_id", "parsed": "items_parsed", "kept": "items_kept"}
        rows = rows.unionByName(feeds.withColumn("section", F.lit("feed")).withColumnsRenamed(named).select(*columns))
    return rows


def assemble(
    spark: SparkSession,
    obligations: tuple[DataFrame, dict],
    news: tuple[DataFrame, dict],
    clock: O.Clock,
    pages: DataFrame | None = None,
    programs: DataFrame | None = None,
    sources: DataFrame | None = None,
    entries: DataFrame | None = None,
    w: Weights = WEIGHTS,
) -> Day:
    """All parts of a day. ``pages`` are compared pages, ``sources`` health rows, ``entries`` calendar entries.

    ``fetched`` counts every programme and every collected item; each of them
    is kept or has a reason in ``dropped``.
    """
    built, obliged = obligations
    best, newsy = news
    items = O.item_rows(built).unionByName(N.news_rows(best), allowMissingColumns=True)
    lanes = L.top_per_lane(items, w.max_items_per_lane)
    parts = {
        "items": items,
        "lane_items": lanes.select(F.col("primary_lane").alias("lane"), "item_id", "rank", "score"),
        "countdown": O.countdown_rows(built.filter("gate_reason IS NULL"), clock, w).withColumnRenamed("date", "deadline_date"),
        "verify": verify_part(built, pages, programs),
    }
    feeds = None
    if entries is not None:
        resolved = E.resolve_events(entries, clock.at)
        feeds = E.feed_status(resolved)
        parts["events"] = E.dedupe_events(resolved.filter("drop_reason IS NULL")).select(
            "uid", "feed_id", "day", "kind", "ticker", "company", "label", "watched", "days_until"
        )
    parts["health"] = health_part(spark, obliged["rows"], obliged["kept"], sources, feeds)
    day = Day(parts, {"obligations": obliged, "news": newsy})
    row = (obliged["rows"] + newsy["rows"], obliged["kept"] + newsy["kept"], obliged["tracked"], obliged["verified"], obliged["median"], day.dropped)
    parts["stats"] = spark.createDataFrame([row], STATS)
    return day


def deliver(spark: SparkSession, day: Day, ruled_out: DataFrame, root: str, date: str, run: str) -> DataFrame:
    """Stage every part, commit the day, add the run to the history; returns ``(rule, problems)``.

    Rules of single rows are counted by the writes; only repeated ids, lane
    references and the fence read the day's staged rows again. With a broken
    event feed the whole event section is empty. An unusable day, one with
    tracked dates and nothing to show, is recorded and not committed.
    """
    broken = F.col("status").isin("failed", "degraded")
    watch = {
        "items": A.rule_counts(Q.item_rules()) | {"opportunities": F.count_if(F.col("kind") == "opportunity"), "rows": F.count(F.lit(1))},
        "countdown": A.rule_counts(Q.countdown_rules()) | {"rows": F.count(F.lit(1))},
        "health": {
            "rows": F.count(F.lit(1)),
            "ok": F.count_if(F.col("status").isin("ok", "not-modified")),
            "broken-feeds": F.count_if(broken & (F.col("section") == "feed")),
        },
    }
    found: dict[str, Mapping] = {}
    for name in [n for n in digests.PARTS if n in day.parts]:
        rows = day.parts[name]
        if name == "events" and found["health"]["broken-feeds"]:
            rows = rows.filter(F.lit(False))
        found[name] = digests.stage_part(rows, root, name, date, run, watch.get(name))
    staged = {n: digests.read_run(spark, root, n, date, run) for n in ("items", "lane_items", "countdown", "stats")}
    tracked, kept = day.counts["obligations"]["tracked"], found["items"]["rows"]
    total = sum(c["rows"] for c in day.counts.values())
    left = sum(c["kept"] for c in day.counts.values()) + sum(day.dropped.values())
    broken_rules = A.violations(*found.values())
    broken_rules |= {"empty-strip": int(tracked > 0 and not found["countdown"]["rows"]), "unaccounted": abs(total - left)}
    outcome = "unusable" if broken_rules["empty-strip"] and not found["items"]["opportunities"] else "ok"
    if outcome == "ok":
        digests.commit_day(spark, root, date, run)
    status = spark.createDataFrame([(outcome, found["health"]["ok"], found["health"]["rows"], kept, tracked)], STATUS.replace("date date, ", ""))
    digests.append_run_status(status.withColumn("date", F.lit(date).cast("date")), f"{root}/run_status", run)
    one_by_one = spark.createDataFrame([(r, n) for r, n in broken_rules.items() if n], "rule string, problems long")
    joined = Q.joined_problems(staged["items"], staged["lane_items"], staged["countdown"], ruled_out)
    return one_by_one.unionByName(joined.groupBy("rule").agg(F.count("*").alias("problems")))
