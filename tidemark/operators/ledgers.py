"""State carried from one run to the next, as keyed snapshots and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import WEIGHTS, Weights
from tidemark.functions.scoring import rung_for


def upsert(previous: DataFrame, current: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """New values over old ones; keys seen on one side only are kept.

    Of several new rows of a key the one of the highest ``version`` counts, or
    of the highest values where none is named, so the result has one row per key.
    """
    values = [c for c in previous.columns if c not in keys]
    row = F.struct(*values)
    best = F.max(row) if version is None else F.max(F.struct(F.col(version).alias("version"), row.alias("row")))["row"]
    new = current.groupBy(*keys).agg(best.alias("_new"))
    old = previous.select(*keys, F.struct(*values).alias("_old"))
    joined = old.join(new, keys, "full")
    return joined.select(
        *keys, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{v}")).otherwise(F.col(f"_old.{v}")).alias(v) for v in values]
    )


def first_seen(ids: DataFrame, ledger: DataFrame, today: Column, key: str = "item_id") -> DataFrame:
    """``(key, first_seen, is_new)`` for every distinct id of a run."""
    seen = ids.select(key).distinct().join(ledger, key, "left")
    date = F.coalesce(F.col("first_seen"), today)
    return seen.select(key, date.alias("first_seen"), (date == today).alias("is_new"))


def earliest_seen(observations: DataFrame, key: str, at: str) -> DataFrame:
    """The ledger rebuilt from history: the first day each key occurs."""
    return observations.groupBy(key).agg(F.min(F.to_date(at)).alias("first_seen"))


def rungs_delivered(built: DataFrame) -> DataFrame:
    """Ledger rows a run adds: every crossed rung, delivered or not."""
    return built.filter(F.col("rung").isNotNull()).select("program_id", "cycle_year", "rung")


def rolling_delivered(items: DataFrame, today: Column) -> DataFrame:
    return items.filter(F.col("deadline.kind") == "rolling").select("program_id", today.alias("last_delivered"))


def replay_rungs(days_from: Column, w: Weights = WEIGHTS) -> Column:
    """Cards fired by one obligation over a daily run from ``days_from`` down to the day itself.

    The ledger is a fold over the days, inside the row. Between two rungs the
    crossed rung stays the same and has already fired, so the first day and the
    days of the ladder are the only ones that can matter.
    """
    state = lambda last, fired: F.struct(last.cast("int").alias("last"), fired.cast("int").alias("fired"))

    def step(acc: Column, day: Column) -> Column:
        rung = rung_for(day, acc["last"], w.rungs, w.rung_floor_days)
        return state(F.coalesce(rung, acc["last"]), acc["fired"] + rung.isNotNull().cast("int"))

    ladder = sorted({*w.rungs, *range(w.rung_floor_days + 1)}, reverse=True)
    later = F.filter(F.array(*[F.lit(d) for d in ladder]), lambda d: d < days_from)
    days = F.concat(F.array(days_from.cast("int")), later)
    return F.when(
        days_from >= 0, F.aggregate(days, state(F.lit(None), F.lit(0)), step, lambda acc: acc["fired"])
    ).otherwise(F.lit(0))


def on_cooldown(last_delivered: Column, today: Column, days: int = WEIGHTS.rolling_redelivery_days) -> Column:
    return F.coalesce(F.datediff(today, last_delivered) < days, F.lit(False))
