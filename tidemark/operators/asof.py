"""Joins to what was known at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_at: str,
    right_at: str,
    values: list[str],
    width: int,
    strict: bool = False,
    matched_at: str | None = None,
) -> DataFrame:
    """Left rows with ``values`` of the newest right row of their key at or before their time (``strict``: before it).

    Times are whole numbers, such as days, turns or seconds; ``width`` of them
    make a range. Both sides are merged by (key, range), so a key with a long
    history is many tasks' work, and each range is given what the ranges before
    it left: the last right row per key and range, never the history itself.

    Rows without a match, with a null key or with a null time get nulls. Of right
    rows of a key and time the one with the greatest values counts. ``matched_at``
    names a column for the time of the row found.
    """
    if width < 1:
        raise ValueError("a range holds one time at least")
    names = [f"_key{i}" for i in range(len(keys))]
    time = lambda c: F.col(f"`{c}`").cast("long").alias("_at")
    usable = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in [*names, "_at"]])
    # rows that cannot match are scattered
    range_of = F.when(usable, F.floor(F.col("_at") / width)).otherwise(F.xxhash64("_row")).alias("_range")
    keyed = lambda df, at: [*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], time(at)]
    payload = F.struct(F.col("_at"), *[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)])

    known = right.select(*keyed(right, right_at), *[F.col(f"`{v}`") for v in values]).filter(usable)
    known = known.select(*names, "_at", F.floor(F.col("_at") / width).alias("_range"), payload.alias("_found"))
    rows = left.select(*keyed(left, left_at), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    rows = rows.select(*names, "_at", range_of, "_row")

    # what each range leaves behind, and what it finds: one row per key and range
    left_over = known.groupBy(*names, "_range").agg(F.max("_found").alias("_left"))
    spans = rows.filter(usable).select(*names, "_range").distinct()
    both = spans.withColumn("_left", F.lit(None).cast(left_over.schema["_left"].dataType)).unionByName(left_over)
    both = both.groupBy(*names, "_range").agg(F.max("_left").alias("_left"))
    earlier = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.select(*names, "_range", F.last("_left", ignorenulls=True).over(earlier).alias("_carried"))

    # inside a range: rows in order of time, right rows first unless only earlier ones count
    no_row, no_found = F.lit(None).cast(rows.schema["_row"].dataType), F.lit(None).cast(known.schema["_found"].dataType)
    merged = rows.select(*names, "_at", "_range", "_row", no_found.alias("_found"), F.lit(0).alias("_side")).unionByName(
        known.select(*names, "_at", "_range", no_row.alias("_row"), "_found", F.lit(1 if strict else -1).alias("_side"))
    )
    so_far = Window.partitionBy(*names, "_range").orderBy("_at", "_side", "_found").rowsBetween(Window.unboundedPreceding, 0)
    seen = merged.withColumn("_seen", F.when(usable, F.last("_found", ignorenulls=True).over(so_far))).filter(F.col("_row").isNotNull())
    out = seen.join(carried, [*names, "_range"], "left")
    found = F.coalesce("_seen", "_carried")
    columns: list[Column] = [F.col(f"_row.`{c}`").alias(c) for c in left.columns]
    columns += [found[f"v{i}"].alias(v) for i, v in enumerate(values)]
    return out.select(*columns, *([found["_at"].alias(matched_at)] if matched_at else []))


def last_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: str, width: int, n: int) -> DataFrame:
    """Left rows with ``value_1`` to ``value_n``: the values of the newest right rows before their time, newest first."""
    out, at = left, left_at
    for i in range(1, n + 1):
        renamed = right.select(*keys, F.col(right_at).alias(f"_right_at{i}"), F.col(value).alias(f"{value}_{i}"))
        out = as_of(out, renamed, keys, at, f"_right_at{i}", [f"{value}_{i}"], width, strict=True, matched_at=f"_matched{i}")
        at = f"_matched{i}"
    return out.drop(*[f"_matched{i}" for i in range(1, n + 1)])
