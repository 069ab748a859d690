"""Positions in a total order, without sorting a table or a large group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

#: A row's number within its task is in the lower bits of ``monotonically_increasing_id``.
_TASK_BITS = 33


def ranked(df: DataFrame, by: list[Column], groups: list[str] | None = None, rank: str = "rank", size: str | None = None) -> DataFrame:
    """The rows with their place from 1 on in the order ``by``, per group where groups are named.

    Rows are dealt out by ranges of (groups, by), so a group that holds a large
    share of the rows is spread over many tasks; each task sorts its range and
    writes it with the rows numbered. What the ranges before it hold of a group
    is added to these numbers: one row per range and group, never the rows
    themselves. ``size`` names a column for the number of rows of the group.

    Null groups are a group, and nulls in ``by`` go where the given column sorts
    them (first, unless it says otherwise). Rows equal in all of ``by`` get
    neighbouring places, in an order that is fixed once written: add a column
    that tells them apart where that matters, also for many such rows to be
    spread. An empty table gives an empty table.
    """
    groups = groups or []
    order = [*[F.col(f"`{g}`") for g in groups], *by]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "ranked")
    own = [F.shiftright("_at", _TASK_BITS).alias("_range"), *[F.col(f"`{g}`").alias(f"_group{i}") for i, g in enumerate(groups)]]
    runs = placed.groupBy(*own).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before, total = _before(runs, [f"_group{i}" for i in range(len(groups))])
    runs = runs.select("*", before.alias("_before"), total.alias("_total")) if groups else _before_in_all(runs)
    same = [F.shiftright(F.col("_at"), _TASK_BITS) == F.col("_range")]
    same += [F.col(f"`{g}`").eqNullSafe(F.col(f"_group{i}")) for i, g in enumerate(groups)]
    joined = placed.join(runs, reduce(lambda a, b: a & b, same))
    added = [(F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(rank)]
    added += [F.col("_total").alias(size)] if size else []
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *added)


def _before(runs: DataFrame, groups: list[str]) -> tuple[Column, Column]:
    """Rows of the group in earlier ranges, and in all: over one row per range that the group touches."""
    own = Window.partitionBy(*groups)
    earlier = F.sum("_n").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(earlier, F.lit(0)), F.sum("_n").over(own)


def _before_in_all(runs: DataFrame) -> DataFrame:
    """The same without groups: one row per range reaches the driver, as many as the shuffle has partitions."""
    found = sorted(tuple(r) for r in runs.select("_range", "_first", "_n").collect())
    total = sum(n for _, _, n in found)
    rows, before = [], 0
    for part, first, n in found:
        rows.append((part, first, before, total))
        before += n
    return F.broadcast(runs.sparkSession.createDataFrame(rows, "_range long, _first long, _before long, _total long"))
