"""From a registry of programmes to dated, ranked and explained obligations.

A programme row carries its own cycles and steps as arrays, so everything up
to the ledger lookups is computed inside the row: no shuffle, whatever the size
of the registry. Each stage adds columns the next one reads; a value used
more than once is a column of its own so Catalyst keeps it in one projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import READER_ZONE, WEIGHTS, Weights
from tidemark.functions import dates as D
from tidemark.functions import scoring as S
from tidemark.functions.common import instant, stage
from tidemark.functions.ids import obligation_id
from tidemark.sources.schemas import STEP

UNDATED_HEADLINE = "Application deadline"


@dataclass(frozen=True)
class Clock:
    """The moment a run describes, and whose calendar says what today is."""

    now: str | datetime
    reader_zone: str = READER_ZONE

    @property
    def at(self) -> Column:
        return instant(self.now)

    @property
    def today(self) -> Column:
        return D.local_date(self.at, F.lit(self.reader_zone))


def status_gate(programs: DataFrame, clock: Clock) -> DataFrame:
    """Add ``drop_reason``: null for programmes that go on. Every drop is counted."""
    waiting = (F.col("status") == "watch") & F.col("watch_from").isNotNull() & (clock.today < F.col("watch_from"))
    return programs.withColumn(
        "drop_reason",
        F.when(F.col("status") == "ruled-out", "ruled-out")
        .when(waiting, "not-yet-watched")
        .when(F.col("status").isin("closed", "won"), "closed")
        .when(F.coalesce(F.size("cycles"), F.lit(0)) <= 0, "no-cycle")
        .when(~F.coalesce(D.known_zone(F.col("time_zone")), F.lit(False)), "unknown-zone"),
    ).withColumn("time_zone", D.usable_zone(F.col("time_zone")))


def active_cycle(programs: DataFrame, clock: Clock, grace_days: int = WEIGHTS.grace_days) -> DataFrame:
    """Add ``cycle`` and ``rolled``.

    The soonest cycle still open within the grace window; else the first
    undated one; else the latest, to be rolled forward.
    """
    now = clock.at
    zone = F.col("time_zone")
    open_after = F.unix_seconds(now) - grace_days * 86_400
    df = programs.withColumn(
        "_ends",
        F.transform(
            "cycles",
            lambda c: F.unix_seconds(
                D.deadline_instant(c["deadline"], zone, now, c["time_of_day"])
            ),
        ),
    )
    # tier 0 is open, 1 undated, 2 closed
    rank = lambda tier, order, pos: F.struct(
        F.lit(tier).alias("tier"), order.cast("long").alias("order"), pos.alias("pos")
    )
    df = df.withColumn(
        "_pick",
        F.array_min(
            F.transform(
                "_ends",
                lambda t, i: F.when(t.isNull(), rank(1, F.lit(0), i))
                .when(t >= open_after, rank(0, t, i))
                .otherwise(rank(2, -t, -i)),
            )
        ),
    )
    return stage(
        df,
        {
            "rolled": F.col("_pick.tier") == 2,
            "cycle": F.get("cycles", F.abs(F.col("_pick.pos"))),
        },
    ).drop("_ends", "_pick")


def resolve_deadline(df: DataFrame, clock: Clock) -> DataFrame:
    """Add ``deadline`` and ``steps`` for the active cycle.

    A closed cycle becomes next year's projection when its cadence allows one,
    and an unknown deadline when it does not. Its steps keep their names and
    lose their dates.
    """
    now, zone, cycle = clock.at, F.col("time_zone"), F.col("cycle")
    none = F.lit(None).cast("string")
    df = df.withColumns(
        {
            "_parsed": D.parse_deadline(cycle["deadline"], zone, now, cycle["time_of_day"], cycle["precision"]),
            "_next": F.when(F.col("rolled"), D.next_occurrence(F.col("recurrence"), now, zone)),
        }
    )
    dated = cycle["kind"].isNull() | ~cycle["kind"].isin("rolling", "unknown")
    dated = dated & F.col("_parsed.instant").isNotNull()

    def struct(kind, date, tod, precision, year, confident, verify_by, evidence, provenance):
        return F.struct(
            kind.alias("kind"),
            date.alias("date"),
            tod.alias("time_of_day"),
            precision.alias("precision"),
            year.cast("int").alias("cycle_year"),
            F.lit(confident).alias("cycle_year_confident"),
            verify_by.cast("date").alias("verify_by"),
            evidence.alias("evidence"),
            F.lit(provenance).alias("provenance"),
        )

    has_time = cycle["time_of_day"].isNotNull()
    projected = struct(
        F.lit("projected"),
        D.local_date(F.col("_next"), zone).cast("string"),
        cycle["time_of_day"],
        F.when(has_time, "minute").otherwise("day"),
        cycle["year"] + 1,
        False,
        D.local_date(F.col("_next") - F.make_dt_interval(F.lit(60)), zone),
        none,
        "derived",
    )
    lost = struct(
        F.lit("unknown"), none, none, F.lit("unknown"), cycle["year"] + 1, False, F.lit(None), none, "derived"
    )
    own = struct(
        F.when(dated, F.when(cycle["confirmed"], "confirmed").otherwise("projected"))
        .when(cycle["kind"] == "rolling", "rolling")
        .otherwise("unknown"),
        F.when(dated, cycle["deadline"]),
        F.when(dated, cycle["time_of_day"]),
        F.when(dated, F.col("_parsed.precision")).otherwise("unknown"),
        cycle["year"],
        True,
        cycle["verify_by"],
        cycle["evidence"],
        "yaml",
    )
    steps = F.coalesce(cycle["steps"], F.array().cast(f"array<{STEP}>"))
    blank_steps = F.transform(
        steps,
        lambda s: s.withField("due", none).withField("time_of_day", none).withField("status", F.lit("pending")),
    )
    return stage(
        df,
        {
            "deadline": F.when(F.col("rolled"), F.when(F.col("_next").isNotNull(), projected).otherwise(lost)).otherwise(
                own
            ),
            "steps": F.when(F.col("rolled"), blank_steps).otherwise(steps),
        },
    ).drop("_parsed", "_next")


def next_step(steps: Column) -> Column:
    """Position of the first pending step whose precondition is done; -1 when all are blocked or done."""
    done = F.transform(F.filter(steps, lambda s: s["status"] == "done"), lambda s: s["id"])
    ready = F.transform(
        steps,
        lambda s: (s["status"] == "pending")
        & (
            s["precondition"].isNull()
            | (s["precondition"] == "")
            | F.array_contains(done, F.coalesce(s["precondition"], F.lit("")))
        ),
    )
    return (F.array_position(ready, F.lit(True)) - 1).cast("int")


def effective_target(df: DataFrame, clock: Clock) -> DataFrame:
    """Add ``target``, ``undated_gating``, ``instant``, ``days_until`` and ``next_index``.

    The countdown runs to the earliest unmet gating step that has a date, and
    ``deadline`` is moved to the date that is shown. A gating step without a
    date is always reported, even beside a good headline date.
    """
    now, zone = clock.at, F.col("time_zone")
    none = F.lit(None).cast("string")
    pending = F.filter("steps", lambda s: s["gating"] & (s["status"] == "pending"))
    df = df.withColumn("_pending", pending)
    df = df.withColumns(
        {
            "_dated": F.array_min(
                F.filter(
                    F.transform(
                        "_pending",
                        lambda s, i: F.struct(
                            D.deadline_instant(s["due"], zone, now, s["time_of_day"]).alias("at"), i.alias("pos")
                        ),
                    ),
                    lambda x: x["at"].isNotNull(),
                )
            ),
            "undated_gating": F.get(
                F.transform(F.filter("_pending", lambda s: s["due"].isNull()), lambda s: s["label"]), F.lit(0)
            ),
        }
    )
    step = F.get("_pending", F.col("_dated.pos"))
    undated = F.col("undated_gating")
    any_gating = F.exists("steps", lambda s: s["gating"])
    target = lambda date, tod, label, gating: F.struct(
        date.alias("date"), tod.alias("time_of_day"), label.alias("label"), gating.alias("gating")
    )
    df = df.withColumn(
        "target",
        F.when(
            F.col("_dated").isNotNull(),
            target(
                step["due"],
                step["time_of_day"],
                F.when(undated.isNull(), step["label"]).otherwise(
                    F.concat(step["label"], F.lit(" (but "), undated, F.lit(" comes first)"))
                ),
                F.lit(True),
            ),
        )
        .when(
            undated.isNotNull() & F.col("deadline.date").isNull(), target(none, none, undated, F.lit(True))
        )
        .otherwise(
            target(
                F.col("deadline.date"),
                F.col("deadline.time_of_day"),
                F.when(undated.isNull(), UNDATED_HEADLINE).otherwise(F.concat(undated, F.lit(" (date unknown)"))),
                any_gating,
            )
        ),
    )
    df = df.withColumn(
        "_at",
        D.parse_deadline(F.col("target.date"), zone, now, F.col("target.time_of_day"), F.col("cycle.precision")),
    )
    moved = F.col("_at.instant").isNotNull() & ~F.col("target.date").eqNullSafe(F.col("deadline.date"))
    deadline = F.col("deadline")
    df = stage(
        df,
        {
            "deadline": F.when(
                moved,
                deadline.withField("date", F.col("target.date"))
                .withField("time_of_day", F.col("target.time_of_day"))
                .withField("precision", F.col("_at.precision")),
            ).otherwise(deadline),
            "instant": F.col("_at.instant"),
            "next_index": next_step(F.col("steps")),
            "days_until": D.days_until(F.col("_at.instant"), zone, now),
        },
    )
    return df.drop("_pending", "_dated", "_at")


def verify_reason(df: DataFrame, clock: Clock) -> DataFrame:
    """Add ``stale_days``, ``verify_reason`` and ``needs_verification``; the first reason that fits is kept."""
    d = F.col("deadline")
    stale = F.col("stale_days")
    reason = (
        F.when(F.col("undated_gating").isNotNull(), F.concat(F.lit("gating step without a date: "), F.col("undated_gating")))
        .when(d["kind"] == "unknown", "no date known")
        .when(d["precision"] == "month", "month known, day missing: no alert")
        .when(
            d["verify_by"] <= clock.today,
            F.concat(
                F.lit("to be confirmed by "), d["verify_by"].cast("string"), F.lit(", which is past")
            ),
        )
        .when(stale > F.col("verify_every"), F.concat(F.lit("not checked for "), stale.cast("string"), F.lit(" days")))
        .when(
            F.col("verified_on").isNull() & d["kind"].isin("confirmed", "projected"),
            "never checked",
        )
    )
    df = df.withColumn("stale_days", D.stale_days(F.col("verified_on"), clock.today))
    df = stage(df, {"verify_reason": reason})
    return df.withColumn("needs_verification", F.col("verify_reason").isNotNull())


def resolve(programs: DataFrame, clock: Clock, w: Weights = WEIGHTS, with_gated: bool = False) -> DataFrame:
    """Every stage up to the ledgers, for the programmes that pass the status gate.

    ``with_gated`` keeps the others too, with their reason as ``gate_reason``.
    """
    df = status_gate(programs, clock)
    if with_gated:
        df = df.withColumnRenamed("drop_reason", "gate_reason")
    else:
        df = df.filter(F.col("drop_reason").isNull())
    df = active_cycle(df, clock, w.grace_days)
    df = resolve_deadline(df, clock)
    df = effective_target(df, clock)
    return verify_reason(df, clock)


def add_urgency(df: DataFrame, w: Weights = WEIGHTS) -> DataFrame:
    d = F.col("deadline")
    return stage(
        df, {"urgency": S.urgency(d["kind"], d["precision"], F.col("days_until"), F.col("lane"), d["date"], w)}
    )


def add_events(df: DataFrame, clock: Clock, rung_window: int = 7, step_window: int = 14) -> DataFrame:
    """Add ``events``: imminent, passed, due for verification, next step due."""
    days = F.col("days_until")
    step = F.get("steps", F.when(F.col("next_index") >= 0, F.col("next_index")))
    step_at = D.deadline_instant(step["due"], F.col("time_zone"), clock.at)
    flags = F.array(
        F.when(days.between(0, rung_window), "deadline-imminent"),
        F.when(days < 0, "deadline-passed"),
        F.when(F.col("deadline.verify_by") <= clock.today, "verify-deadline"),
        F.when(D.days_until(step_at, F.col("time_zone"), clock.at) <= step_window, "step-due"),
    )
    return stage(df, {"events": F.array_compact(flags)})


def score(df: DataFrame, w: Weights = WEIGHTS) -> DataFrame:
    """Add ``factors``, ``penalties``, ``score`` and ``weights_version``."""
    none = F.lit(None).cast("array<string>")
    factors = F.array_compact(
        F.array(
            S.factor(
                "deadlineUrgency",
                "Deadline urgency",
                F.col("urgency.raw"),
                w.points["deadlineUrgency"],
                F.col("urgency.evidence"),
            ),
            F.when(
                F.col("target.gating"),
                S.factor(
                    "gating",
                    "Gating step",
                    F.lit(1.0),
                    w.points["gating"],
                    F.array(F.lit("nothing can be submitted without it")),
                ),
            ),
            S.event_factor(F.col("events"), w),
            F.when(
                F.col("priority") == "high",
                S.factor("fit", "High priority", F.lit(1.0), w.points["fit"], F.array(F.lit("priority: high"))),
            ),
        )
    )
    has = lambda key: F.array_contains(F.col("urgency.penalties"), key)
    flat = lambda key: S.factor(key, key, F.lit(1.0), -w.penalties[key], none)
    penalties = F.array_compact(
        F.array(
            F.when(has("deadlineUnknown"), flat("deadlineUnknown")),
            F.when(has("deadlineProjected"), flat("deadlineProjected")),
            F.when(
                F.col("ruled_out").isNotNull(),
                S.factor(
                    "eligibilityMismatch",
                    "Ineligible",
                    F.lit(1.0),
                    -w.penalties["eligibilityMismatch"],
                    F.array(F.col("ruled_out.reason")),
                ),
            ),
        )
    )
    df = df.withColumns({"factors": factors, "penalties": penalties})
    return stage(
        df,
        {
            "factors": F.col("factors"),
            "penalties": F.col("penalties"),
            "score": S.total_score(F.col("factors"), F.col("penalties")),
            "weights_version": F.lit(w.fingerprint()),
        },
    )


def countdown_rows(df: DataFrame, clock: Clock, w: Weights = WEIGHTS) -> DataFrame:
    """Everything inside the strip, every day, whatever the ladder says."""
    inside = F.col("days_until").between(-w.grace_days, w.strip_days)
    return df.filter(F.col("instant").isNotNull() & inside).select(
        "program_id",
        "label",
        F.col("target.label").alias("target"),
        F.coalesce(F.col("deadline.date"), F.lit("")).alias("date"),
        "days_until",
        F.col("deadline.kind").alias("kind"),
        F.col("deadline.precision").alias("precision"),
        F.col("deadline.provenance").alias("provenance"),
        F.col("target.gating").alias("gating"),
        D.format_when(
            F.col("instant"), F.col("time_zone"), F.col("deadline.precision"), clock.reader_zone
        ).alias("display_when"),
        "needs_verification",
        "url",
    )


def verify_rows(df: DataFrame) -> DataFrame:
    return df.filter("needs_verification").select(
        "program_id", "label", F.col("verify_reason").alias("reason"), "stale_days", "url"
    )


def verify_order() -> list[Column]:
    """The longest unverified first, null as 0, then by label."""
    return [F.coalesce("stale_days", F.lit(0)).desc(), F.col("label"), F.col("program_id")]


def decide(df: DataFrame, w: Weights = WEIGHTS) -> DataFrame:
    """Add ``drop_reason`` for resolved rows that carry ``rung`` and ``last_rolling``.

    Reasons are tried in the order the run meets them: cooldown, passed, then
    the threshold that a pinned, crossed, unverified or imminent row may ignore.
    """
    rolling = F.col("deadline.kind") == "rolling"
    since = F.datediff(F.col("today"), F.col("last_rolling"))
    must_show = (
        (F.col("priority") == "high")
        | F.col("rung").isNotNull()
        | F.col("needs_verification")
        | F.array_contains("events", "deadline-imminent")
        | F.array_contains("events", "verify-deadline")
    )
    reason = (
        F.when(rolling & (since < w.rolling_redelivery_days), "rolling-cooldown")
        .when(F.col("days_until") < -w.grace_days, "deadline-passed")
        .when(~F.col("must_show") & (F.col("score") < w.keep_threshold), "below-threshold")
        .when(~F.col("must_show") & ~rolling, "no-rung")
    )
    df = df.withColumn("must_show", must_show)
    return stage(df, {"must_show": F.col("must_show"), "drop_reason": reason})


def _with_ledgers(programs: DataFrame, rungs: DataFrame, rolling: DataFrame) -> DataFrame:
    """Add ``_rungs`` and ``_deliveries``: a programme's ledger rows, one per cycle and one in all."""
    fired = rungs.groupBy("program_id").agg(F.collect_list(F.struct("cycle_year", "rung")).alias("_rungs"))
    delivered = rolling.groupBy("program_id").agg(F.collect_list(F.struct("last_delivered")).alias("_deliveries"))
    return programs.join(fired, "program_id", "left").join(delivered, "program_id", "left")


def build(
    programs: DataFrame,
    clock: Clock,
    rungs: DataFrame,
    rolling: DataFrame,
    w: Weights = WEIGHTS,
    with_gated: bool = False,
) -> DataFrame:
    """All resolved programmes with score, rung and ``drop_reason``; ledgers join by key.

    ``with_gated``: every programme, those that the status gate stops with its
    reason, so that one table accounts for the whole registry.

    Both ledgers hold one row per key, so a join never multiplies rows; bucket
    them by ``program_id`` like the registry and neither side is shuffled.

    What the ledgers say of a programme joins its registry row, before the row
    grows by targets, factors and evidence: no resolved row is ever shuffled,
    and a registry that comes by ``program_id`` is not shuffled at all.
    """
    df = score(add_events(add_urgency(resolve(_with_ledgers(programs, rungs, rolling), clock, w, with_gated), w), clock), w)
    df = stage(
        df,
        {
            "cycle_year": F.col("deadline.cycle_year"),
            "today": clock.today,
            "obligation_id": obligation_id(F.col("program_id"), F.col("deadline.cycle_year")),
        },
    )
    own = F.filter("_rungs", lambda r: r["cycle_year"] == F.col("cycle_year"))
    df = df.withColumn("_rung", F.explode_outer(own)).withColumn("_delivery", F.explode_outer("_deliveries"))
    df = df.withColumns({"last_rung": F.col("_rung.rung"), "last_rolling": F.col("_delivery.last_delivered")})
    df = df.drop("_rungs", "_rung", "_deliveries", "_delivery")
    df = stage(df, {"rung": S.rung_for(F.col("days_until"), F.col("last_rung"), w.rungs, w.rung_floor_days)})
    df = decide(df, w)
    if with_gated:
        df = df.withColumn("drop_reason", F.coalesce("gate_reason", "drop_reason"))
    return df


def item_rows(built: DataFrame) -> DataFrame:
    """Kept rows in the shape shared with news items."""
    target = F.col("target.label")
    titled = F.col("target.gating") & (target != UNDATED_HEADLINE)
    return built.filter(F.col("drop_reason").isNull()).select(
        F.lit("opportunity").alias("kind"),
        F.col("obligation_id").alias("item_id"),
        F.when(titled, F.concat(F.col("label"), F.lit(" — "), target)).otherwise(F.col("label")).alias("title"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce(F.col("url"), F.concat(F.lit("tidemark:program/"), F.col("program_id"))).alias("canonical_url"),
        F.lit("registry").alias("source_id"),
        F.lit("registry").alias("source_kind"),
        F.lit("self").alias("publisher_group"),
        F.coalesce("lane", F.lit("fellowships")).alias("primary_lane"),
        "score",
        "factors",
        "penalties",
        "weights_version",
        "program_id",
        "status",
        "deadline",
        "days_until",
        "rung",
        "events",
        "needs_verification",
        "verify_reason",
    )
