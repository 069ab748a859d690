"""Lanes: top rows per lane, and references from lanes to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.config import LANES, PINNED_LANE, WEIGHTS
from tidemark.functions.common import case_of


def lane_rank(lane: Column) -> Column:
    """Pinned lane first, the others in declared order."""
    order = [PINNED_LANE, *[x for x in LANES if x != PINNED_LANE]]
    return case_of(lane, {name: i for i, name in enumerate(order)}, len(order))


def top_per_lane(items: DataFrame, k: int = WEIGHTS.max_items_per_lane, pinned: str = PINNED_LANE) -> DataFrame:
    """The best ``k`` per lane; the pinned lane is whole.

    ``rank <= k`` is applied inside each task before the shuffle, so no lane is
    sorted in one place. Every pinned row is a group of its own: all are kept
    and none of them meet.
    """
    is_pinned = F.col("primary_lane") == pinned
    by_score = W.partitionBy("primary_lane", F.when(is_pinned, F.col("item_id"))).orderBy(
        F.col("score").desc(), F.col("item_id")
    )
    best = items.withColumn("_rank", F.row_number().over(by_score)).filter(F.col("_rank") <= k)
    return best.withColumns(
        {"rank": F.when(~is_pinned, F.col("_rank")), "lane_rank": lane_rank(F.col("primary_lane"))}
    ).drop("_rank")


def over_cap(items: DataFrame, k: int = WEIGHTS.max_items_per_lane, pinned: str = PINNED_LANE) -> DataFrame:
    """How many rows each lane left out, so a shortened list says so."""
    counts = items.groupBy("primary_lane").count()
    hidden = F.when(F.col("primary_lane") == pinned, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("count") - k))
    return counts.select("primary_lane", F.col("count").alias("items"), hidden.cast("long").alias("over_cap"))


def lane_entries(refs: DataFrame, items: DataFrame) -> DataFrame:
    """Lane references resolved to items, pinned lane first; dangling ones drop out."""
    found = refs.join(items, ["date", "item_id"], "inner")
    return found.withColumn("lane_rank", lane_rank(F.col("lane")))


def reference_problems(refs: DataFrame, items: DataFrame) -> DataFrame:
    """Dangling and repeated references, and unknown lanes."""
    dangling = refs.join(items.select("date", "item_id"), ["date", "item_id"], "left_anti").select(
        "date", "lane", "item_id", F.lit("missing item").alias("problem")
    )
    repeated = (
        refs.groupBy("date", "lane", "item_id")
        .count()
        .filter("count > 1")
        .select("date", "lane", "item_id", F.lit("listed twice").alias("problem"))
    )
    unknown = refs.filter(~F.col("lane").isin(*LANES)).select(
        "date", "lane", "item_id", F.lit("unknown lane").alias("problem")
    )
    return dangling.unionByName(repeated).unionByName(unknown)
