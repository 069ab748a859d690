"""Joins that stay balanced when a single key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT = 256


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: list[str],
    weight: str,
    spread: Column,
    max_hot: int = MAX_HOT,
) -> DataFrame:
    """Left join to a table with one row per key, exact under any skew.

    ``right[weight]`` says how many left rows a key has. The ``max_hot``
    heaviest keys are broadcast, a bounded number of rows; every other key goes
    through an ordinary shuffle join. Left rows already answered by the
    broadcast are given a key of their own (``spread``) so they scatter over
    the shuffle instead of meeting in one task, and so are rows with a null
    key. Rows whose key ``right`` lacks meet by that key: a key that many left
    rows may have belongs into ``right``, with null values.
    """
    values = [c for c in right.columns if c not in key and c != weight]
    hot = right.orderBy(F.col(weight).desc(), *key).limit(max_hot)
    hot = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in key], *[F.col(v).alias(f"_hot_{v}") for v in values])
    hot_match = None
    for k in key:
        one = F.col(k) == F.col(f"_hot_{k}")
        hot_match = one if hot_match is None else hot_match & one
    marked = left.join(F.broadcast(hot), hot_match, "left")
    cold = F.col(f"_hot_{key[0]}").isNull()
    for k in key:
        cold = cold & F.col(k).isNotNull()
    # a constant on the right would be moved into the join's condition, and the rows would meet by the key alone
    marked = marked.withColumn("_spread", F.when(cold, F.xxhash64(*key)).otherwise(F.xxhash64(spread)))
    rest = right.select(*key, F.xxhash64(*key).alias("_spread"), *[F.col(v).alias(f"_cold_{v}") for v in values])
    joined = marked.join(rest, [*key, "_spread"], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in left.columns],
        *[F.coalesce(F.col(f"_hot_{v}"), F.col(f"_cold_{v}")).alias(v) for v in values],
    )
