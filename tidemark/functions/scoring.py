"""Urgency, factor lists and totals. Every point in a score keeps its reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import WEIGHTS, Weights
from tidemark.functions.common import case_of, round2

FACTOR = "struct<key:string,label:string,raw:double,weight:double,contribution:double,evidence:array<string>>"


def urgency_curve(days: Column, horizon: Column, lead: Column, steepness: float = 2.2) -> Column:
    """0 past the deadline or beyond the horizon, 1 on the day, 0.5 at ``lead`` days."""
    return (
        F.when(days.isNull() | (days < 0), 0.0)
        .when(days == 0, F.when(horizon >= 0, 1.0).otherwise(0.0))
        .when(days > horizon, 0.0)
        .otherwise(1 / (1 + F.pow(days / lead, F.lit(steepness))))
    )


def urgency(
    kind: Column, precision: Column, days: Column, lane: Column, date: Column, w: Weights = WEIGHTS
) -> Column:
    """``struct(raw, evidence, penalties)`` with rolling and unknown as named cases."""
    base = urgency_curve(
        days,
        case_of(lane, w.horizon_days, w.default_horizon_days),
        case_of(lane, w.lead_days, w.default_lead_days),
        w.steepness,
    )
    unknown = (kind == "unknown") | days.isNull()
    projected = kind == "projected"
    monthly = precision == "month"
    raw = (
        F.when(kind == "rolling", w.rolling_floor)
        .when(unknown, w.unknown_floor)
        .otherwise(
            base
            * F.when(projected, w.projected_confidence).otherwise(1.0)
            * F.when(monthly, w.month_confidence).otherwise(1.0)
        )
    )
    evidence = (
        F.when(kind == "rolling", F.array(F.lit("rolling: no date")))
        .when(unknown, F.array(F.lit("no date is known: ask the organiser")))
        .otherwise(
            F.array_compact(
                F.array(
                    F.concat(days.cast("string"), F.lit(" days to "), F.coalesce(date, F.lit("?"))),
                    F.when(projected, f"projected, times {w.projected_confidence:g}"),
                    F.when(monthly, f"day unknown, times {w.month_confidence:g}"),
                )
            )
        )
    )
    dated = ~unknown & (kind != "rolling")
    penalties = F.array_compact(
        F.array(
            F.when(unknown & (kind != "rolling"), "deadlineUnknown"),
            F.when(dated & projected, "deadlineProjected"),
        )
    )
    return F.struct(raw.alias("raw"), evidence.alias("evidence"), penalties.alias("penalties"))


def can_alert(kind: Column, precision: Column, provenance: Column) -> Column:
    """Only a day-or-better date from the registry may ring."""
    return kind.isin("confirmed", "projected") & precision.isin("day", "minute") & (provenance == "yaml")


def rung_for(days: Column, last: Column, rungs: tuple[int, ...] = WEIGHTS.rungs, floor: int = WEIGHTS.rung_floor_days) -> Column:
    """The rung crossed today, or null. A missed rung still fires, once."""
    above = F.lit(None).cast("int") if not any(r > floor for r in rungs) else None
    for r in sorted(r for r in rungs if r > floor):
        unfired = last.isNull() | (last > r)
        hit = F.when(unfired, r)
        above = F.when(days <= r, hit) if above is None else above.when(days <= r, hit)
    return (
        F.when(days < 0, F.lit(None).cast("int"))
        .when(days <= floor, F.when(last.isNull() | (last > days), days))
        .otherwise(above)
        .cast("int")
    )


def factor(key, label, raw: Column, weight: float, evidence: Column | None = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    none = F.lit(None).cast("array<string>")
    return F.struct(
        lit(key).alias("key"),
        lit(label).alias("label"),
        raw.cast("double").alias("raw"),
        F.lit(float(weight)).alias("weight"),
        (raw * float(weight)).cast("double").alias("contribution"),
        (none if evidence is None else evidence).alias("evidence"),
    )


def total_score(factors: Column, penalties: Column) -> Column:
    add = lambda acc, f: acc + f["contribution"]
    return round2(
        F.greatest(F.lit(0.0), F.aggregate(factors, F.lit(0.0), add) + F.aggregate(penalties, F.lit(0.0), add))
    )


def top_event(events: Column, w: Weights = WEIGHTS) -> Column:
    """``struct(boost, pos, name)`` of the strongest event: boosts never add up."""
    ranked = F.transform(
        events,
        lambda e, i: F.struct(case_of(e, w.event_boosts, 0.0).alias("boost"), (-i).alias("pos"), e.alias("name")),
    )
    return F.array_max(ranked)


def event_factor(events: Column, w: Weights = WEIGHTS, with_evidence: bool = True) -> Column:
    top = top_event(events, w)
    return F.when(
        top["boost"] > 0,
        factor(
            F.concat(F.lit("event."), top["name"]),
            F.concat(F.lit("Event: "), top["name"]),
            top["boost"],
            w.points["event"],
            events if with_evidence else None,
        ),
    )


def why_line(factors: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(F.transform(factors, lambda f: f["label"]), 1, n), " · ")
