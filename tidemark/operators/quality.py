"""Rules as tables: every violation is a row of ``problems(rule, key, detail)``, all collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import CADENCES, KINDS, LANES, PRECISIONS, STATUSES
from tidemark.functions.common import blank, stage
from tidemark.functions.dates import known_zone, parse_deadline, usable_zone
from tidemark.operators.lanes import reference_problems

RESERVED_FACTOR_PREFIXES = ("llm", "claude")  # fixed values: a model never contributes a point
MAX_DAILY_MOVE = 60.0

#: By name: whether a row breaks the rule, and what to show of it.
Rules = dict[str, tuple[Column, Column | str]]


def _problem(rule: str, failed: Column, detail: Column | str) -> Column:
    text = detail if isinstance(detail, Column) else F.lit(detail)
    return F.when(F.coalesce(failed, F.lit(False)), F.struct(F.lit(rule).alias("rule"), text.alias("detail")))


def _all(rules: Rules) -> list[Column]:
    return [_problem(name, failed, detail) for name, (failed, detail) in rules.items()]


def _explode(df: DataFrame, key: Column, rules: list[Column]) -> DataFrame:
    """One pass over the rows, whatever the number of rules."""
    found = F.array_compact(F.array(*rules))
    return df.select(key.alias("key"), F.explode(found).alias("p")).select("p.rule", "key", "p.detail")


def _show(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def program_problems(programs: DataFrame) -> DataFrame:
    rules = [
        _problem("missing-id", blank(F.col("program_id")), "missing id"),
        _problem("missing-label", blank(F.col("label")), "missing label"),
        _problem("unknown-status", ~F.col("status").isin(*STATUSES), _show("status")),
        _problem("unknown-lane", ~F.col("lane").isin(*LANES), _show("lane")),
        _problem("unknown-zone", ~known_zone(F.col("time_zone")), _show("time_zone")),
        _problem(
            "ruled-out-without-reason",
            (F.col("status") == "ruled-out") & blank(F.col("ruled_out.reason")),
            "no reason given",
        ),
        _problem(
            "no-cycles",
            (F.coalesce(F.size("cycles"), F.lit(0)) <= 0) & (F.col("status") != "ruled-out"),
            "only a ruled-out program may omit cycles",
        ),
        _problem("unknown-cadence", ~F.col("recurrence.cadence").isin(*CADENCES), F.col("recurrence.cadence")),
        _problem(
            "anchors-missing",
            (F.col("recurrence.cadence") == "thrice-yearly")
            & (F.coalesce(F.size("recurrence.anchors"), F.lit(0)) <= 0),
            "thrice-yearly needs an anchors list",
        ),
    ]
    twice = (
        programs.groupBy("program_id")
        .count()
        .filter("count > 1")
        .select(F.lit("duplicate-id").alias("rule"), F.col("program_id").alias("key"), F.lit("duplicate id").alias("detail"))
    )
    return _explode(programs, F.coalesce("program_id", F.lit("")), rules).unionByName(twice)


def cycle_problems(programs: DataFrame, now: Column) -> DataFrame:
    df = programs.select("program_id", "time_zone", "event_start", F.posexplode("cycles").alias("ci", "c"))
    df = stage(
        df, {"parsed": parse_deadline(F.col("c.deadline"), F.coalesce(usable_zone(F.col("time_zone")), F.lit("UTC")), now, F.col("c.time_of_day"))}
    )
    deadline, kind = F.col("c.deadline"), F.col("c.kind")
    day = F.try_to_date(deadline, "yyyy-MM-dd")
    rules = [
        _problem("cycle-year", ~F.col("c.year").between(2024, 2045) | F.col("c.year").isNull(), _show("c.year")),
        _problem("unknown-kind", ~kind.isin(*KINDS), kind),
        _problem("unknown-precision", ~F.col("c.precision").isin(*PRECISIONS), F.col("c.precision")),
        _problem(
            "unparseable-deadline",
            deadline.isNotNull() & F.col("parsed.instant").isNull(),
            F.coalesce("parsed.warning", F.lit("unparseable deadline")),
        ),
        _problem("rolling-with-deadline", (kind == "rolling") & deadline.isNotNull(), deadline),
        _problem("unknown-with-deadline", (kind == "unknown") & deadline.isNotNull(), deadline),
        _problem("no-deadline-no-kind", deadline.isNull() & kind.isNull(), "say unknown or rolling explicitly"),
        _problem("deadline-after-event", day > F.col("event_start"), deadline),
        _problem("deadline-too-early", F.datediff(F.col("event_start"), day) > 400, deadline),
    ]
    key = F.concat(F.col("program_id"), F.lit("#"), F.col("ci").cast("string"))
    return _explode(df, key, rules)


def step_problems(programs: DataFrame) -> DataFrame:
    """Step rules, checked inside the cycle that owns the steps."""
    df = programs.select("program_id", F.posexplode("cycles").alias("ci", "c")).select(
        "program_id", "ci", F.col("c.steps").alias("steps")
    )
    df = df.withColumn("ids", F.transform("steps", lambda s: s["id"])).select(
        "program_id", "ci", "ids", F.posexplode("steps").alias("si", "s")
    )
    before = F.slice(F.col("ids"), F.lit(1), F.col("si"))
    named = ~blank(F.col("s.precondition"))
    rules = [
        _problem("step-missing-id", blank(F.col("s.id")), "missing id"),
        _problem("step-duplicate-id", F.array_contains(before, F.coalesce("s.id", F.lit(""))), F.col("s.id")),
        _problem("step-missing-label", blank(F.col("s.label")), "missing label"),
        _problem("step-due-format", ~F.col("s.due").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("s.due")),
        _problem(
            "step-precondition-unknown",
            named & ~F.array_contains("ids", F.coalesce("s.precondition", F.lit(""))),
            F.col("s.precondition"),
        ),
        _problem("step-precondition-self", named & (F.col("s.precondition") == F.col("s.id")), F.col("s.precondition")),
    ]
    key = F.concat_ws("#", F.col("program_id"), F.col("ci").cast("string"), F.coalesce("s.id", F.lit("")))
    return _explode(df, key, rules)


def registry_problems(programs: DataFrame, now: Column) -> DataFrame:
    return program_problems(programs).unionByName(cycle_problems(programs, now)).unionByName(step_problems(programs))


def item_rules() -> Rules:
    """Checks on a delivered item by itself: identity, title, kind, stamp, provenance, dates, factor names."""
    factors = F.concat(F.col("factors"), F.col("penalties"))
    reserved = F.filter(
        F.transform(factors, lambda f: F.lower(f["key"])),
        lambda k: reduce(lambda a, b: a | b, [k.startswith(p) for p in RESERVED_FACTOR_PREFIXES]),
    )
    opportunity = F.col("kind") == "opportunity"
    d = F.col("deadline")
    dated = d["date"].isNotNull() & F.try_to_date(F.rpad(d["date"], 10, "-01"), "yyyy-MM-dd").isNull()
    return {
        "item-id": (blank(F.col("item_id")), "missing id"),
        "item-title": (blank(F.col("title")), "no title"),
        "item-kind": (~F.col("kind").isin("news", "opportunity") | F.col("kind").isNull(), _show("kind")),
        "item-weights": (blank(F.col("weights_version")), "no weights version"),
        "item-status": (opportunity & (F.col("status") == "ruled-out"), "ruled-out and delivered"),
        "item-provenance": (opportunity & blank(d["provenance"]), "deadline without provenance"),
        "item-date": (opportunity & dated, d["date"]),
        "item-undated": (opportunity & d["date"].isNull() & ~d["kind"].isin("rolling", "unknown"), d["kind"]),
        "factor-key": (F.size(reserved) > 0, F.array_join(reserved, ",")),
    }


def repeated_items(items: DataFrame) -> DataFrame:
    return (
        items.groupBy("date", "item_id")
        .count()
        .filter("count > 1")
        .select(
            F.lit("item-duplicate").alias("rule"),
            F.concat_ws("#", F.col("date").cast("string"), "item_id").alias("key"),
            F.col("count").cast("string").alias("detail"),
        )
    )


def item_problems(items: DataFrame, ruled_out: DataFrame) -> DataFrame:
    """The rules of an item, repeated ids and the fence."""
    key = F.concat_ws("#", F.col("date").cast("string"), F.coalesce("item_id", F.lit("")))
    found = _explode(items, key, _all(item_rules()))
    return found.unionByName(repeated_items(items)).unionByName(fence(items, ruled_out))


def fence(rows: DataFrame, ruled_out: DataFrame) -> DataFrame:
    """Rows that reference a programme the registry rules out."""
    hit = rows.filter("program_id IS NOT NULL").join(ruled_out.select("program_id"), "program_id", "left_semi")
    return hit.select(
        F.lit("ruled-out").alias("rule"),
        F.concat_ws("#", F.col("date").cast("string"), "program_id").alias("key"),
        F.lit("a ruled-out program was delivered").alias("detail"),
    )


def countdown_rules(date: str = "deadline_date") -> Rules:
    return {
        "strip-date": (~F.coalesce(F.col(date).rlike(r"^\d{4}-\d{2}(-\d{2})?$"), F.lit(False)), _show(date)),
        "strip-days": (F.col("days_until").isNull(), "no days"),
    }


def countdown_problems(countdown: DataFrame, ruled_out: DataFrame) -> DataFrame:
    key = F.concat_ws("#", F.col("date").cast("string"), F.col("program_id"))
    return _explode(countdown, key, _all(countdown_rules())).unionByName(fence(countdown, ruled_out))


def joined_problems(items: DataFrame, refs: DataFrame, countdown: DataFrame, ruled_out: DataFrame) -> DataFrame:
    """The rules that need more than one row: repeated ids, lane references, the fence."""
    lanes = reference_problems(refs, items).select(
        F.col("problem").alias("rule"),
        F.concat_ws("#", F.col("date").cast("string"), "lane", "item_id").alias("key"),
        F.col("lane").alias("detail"),
    )
    return repeated_items(items).unionByName(fence(items, ruled_out)).unionByName(fence(countdown, ruled_out)).unionByName(lanes)


def move_problems(quotes: DataFrame, limit: float = MAX_DAILY_MOVE) -> DataFrame:
    """A change that is not a number, or beyond the limit in a day, is a data fault."""
    change = F.col("change_pct")
    bad_number = F.isnan(change) | (F.abs(change) == float("inf"))
    rules = [
        _problem("move-not-finite", change.isNotNull() & bad_number, "not finite"),
        _problem("move-too-large", ~bad_number & (F.abs(change) >= limit), F.format_string("%.2f", change)),
    ]
    return _explode(quotes, F.col("key"), rules)


def digest_problems(
    items: DataFrame, refs: DataFrame, countdown: DataFrame, stats: DataFrame, ruled_out: DataFrame
) -> DataFrame:
    """Everything wrong with delivered digests, in one table: for an archive of many days.

    ``plans.daily.deliver`` finds the same for the day that it writes, without reading the rows again.
    """
    shown = countdown.select("date").distinct()
    silent = (
        stats.filter("deadlines_tracked > 0")
        .join(shown, "date", "left_anti")
        .select(
            F.lit("empty-strip").alias("rule"),
            F.col("date").cast("string").alias("key"),
            F.col("deadlines_tracked").cast("string").alias("detail"),
        )
    )
    key = F.concat_ws("#", F.col("date").cast("string"), F.coalesce("item_id", F.lit("")))
    strip = F.concat_ws("#", F.col("date").cast("string"), F.col("program_id"))
    return (
        _explode(items, key, _all(item_rules()))
        .unionByName(_explode(countdown, strip, _all(countdown_rules())))
        .unionByName(joined_problems(items, refs, countdown, ruled_out))
        .unionByName(silent)
    )
