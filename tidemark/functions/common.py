"""Small Column helpers shared by everything else."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(value: Column | str | datetime) -> Column:
    """A fixed instant as a Column; naive values are UTC."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(int(value.timestamp()) * 1_000_000 + value.microsecond))


def day(value: Column | str | date) -> Column:
    """A fixed calendar date as a Column."""
    if isinstance(value, Column):
        return value
    return F.lit(date.fromisoformat(value) if isinstance(value, str) else value)


def case_of(key: Column, table: Mapping[str, object], default: object) -> Column:
    """Lookup in a small fixed table, as CASE WHEN: nothing to join or ship."""
    default = default if isinstance(default, Column) else F.lit(default)
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return default if out is None else out.otherwise(default)


def literal_map(table: Mapping[str, str]) -> Column:
    """A fixed table as one map literal, however many entries: one call to build, folded once by the planner."""
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"map({', '.join(quoted(x) for kv in table.items() for x in kv)})")


def round2(value: Column) -> Column:
    """Two decimals, halves up, computed the same way in every engine."""
    return F.floor(value * 100 + 0.5) / 100


def squish(value: Column) -> Column:
    """Collapse white space, non-breaking spaces included."""
    return F.trim(F.regexp_replace(value, r"[\s\u00a0]+", " "))


def any_match(value: Column, patterns: Sequence[str]) -> Column:
    """True when any pattern is found, ignoring case. One literal pattern each,
    so every regex is compiled once per task and not per row."""
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike("(?i)" + p)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it many times inside one expression.

    Without it a helper that mentions its argument n times copies the whole
    argument n times, and nested helpers multiply.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stage(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are computed once, whoever filters or joins on them later.

    The optimizer pushes a filter below a projection by writing the projected
    expressions out in full, and through a chain of projections that grows with
    every reference to every step. A one-row generator keeps the values as
    values: later filters see a column, and nothing is computed twice.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(row)))


def blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")
