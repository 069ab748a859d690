"""Counts taken by the write that makes the rows, so nothing is computed twice to be counted.

The counts are metrics of the last stage before the write. A task of that stage
that is run again counts once, since the driver takes each of its partitions
once; a metric further up, before a shuffle, could count a lost task's rows twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.session import checkpoint_root

#: Every reason that an operator of this library gives, by half. Others are counted together.
OBLIGATION_DROPS = (
    "ruled-out", "not-yet-watched", "closed", "no-cycle", "unknown-zone",
    "rolling-cooldown", "deadline-passed", "below-threshold", "no-rung",
)
INTAKE_DROPS = ("no-title", "no-url", "below-threshold", "excluded", "filtered", "over-cap")
NEWS_DROPS = ("too-old", "below-threshold")
_DROP, _RULE = "drop:", "rule:"


def counted(df: DataFrame, counts: Mapping[str, Column], write: Callable[[DataFrame], None]) -> dict:
    """Write the rows and return the counts, each an aggregate over them."""
    seen = Observation(f"counts-{uuid.uuid4().hex}")
    write(df.observe(seen, *[c.alias(f"c{i}") for i, c in enumerate(counts.values())]))
    found = seen.get
    return {name: found[f"c{i}"] for i, name in enumerate(counts)}


def materialize_counted(df: DataFrame, name: str, counts: Mapping[str, Column]) -> tuple[DataFrame, dict]:
    """``session.materialize`` with counts."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    found = counted(df, counts, lambda rows: rows.write.option("compression", "zstd").parquet(path))
    return df.sparkSession.read.schema(df.schema).parquet(path), found


def drop_counts(reasons: tuple[str, ...], reason: str = "drop_reason") -> dict[str, Column]:
    """Rows in all, kept, and dropped by each reason; a reason that is not named is counted as ``other``."""
    dropped = F.col(reason)
    out = {"rows": F.count(F.lit(1)), "kept": F.count_if(dropped.isNull())}
    out |= {f"{_DROP}{r}": F.count_if(dropped == r) for r in dict.fromkeys(reasons)}
    return out | {f"{_DROP}other": F.count_if(~dropped.isin(*reasons))}


def rule_counts(rules: Mapping[str, tuple[Column, Column]]) -> dict[str, Column]:
    """Rows that break each rule. ``rules``: whether a row breaks it, and what to show."""
    return {f"{_RULE}{name}": F.count_if(F.coalesce(failed, F.lit(False))) for name, (failed, _) in rules.items()}


def _picked(found: Mapping, prefix: str) -> dict[str, int]:
    return {k.removeprefix(prefix): v for k, v in found.items() if k.startswith(prefix) and v}


def drops(*found: Mapping) -> dict[str, int]:
    """What the counts say was dropped, by reason, over any number of writes."""
    out: dict[str, int] = {}
    for one in found:
        for reason, n in _picked(one, _DROP).items():
            out[reason] = out.get(reason, 0) + n
    return out


def violations(*found: Mapping) -> dict[str, int]:
    """Rows that broke a rule, by rule, over any number of writes."""
    out: dict[str, int] = {}
    for one in found:
        for rule, n in _picked(one, _RULE).items():
            out[rule] = out.get(rule, 0) + n
    return out
