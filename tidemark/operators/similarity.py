"""Set overlap of character shingles, each item against one representative of its group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import let
from tidemark.functions.text import normalize_title, shingles, title_key
from tidemark.operators.skew import lookup_join


def _overlap(a: Column, b: Column, ratio) -> Column:
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(ratio(shared, F.size(a) + F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    return _overlap(a, b, lambda shared, total: shared / (total - shared))


def dice(a: Column, b: Column) -> Column:
    return _overlap(a, b, lambda shared, total: 2 * shared / total)


def near_duplicates(items: DataFrame, row_id: str = "item_id", title: str = "title", n: int = 3) -> DataFrame:
    """Shingle overlap of each headline with the first item that has the same title key.

    Comparing with one representative keeps the work linear in the items,
    however many share a headline; pairs inside a group are never listed.
    """
    keyed = items.select(row_id, title, title_key(F.col(title)).alias("title_key"))
    first = keyed.groupBy("title_key").agg(
        F.min(F.struct(F.col(row_id).alias("id"), F.col(title).alias("t"))).alias("first"),
        F.count("*").alias("group_size"),
    )
    reps = first.select(
        "title_key",
        "group_size",
        F.col("first.id").alias("representative"),
        F.col("first.t").alias("rep_title"),
        F.col("group_size").alias("members"),
    )
    joined = lookup_join(keyed, reps, ["title_key"], "group_size", F.col(row_id))
    grams = lambda c: shingles(normalize_title(F.col(c)), n)
    return joined.select(
        row_id,
        "title_key",
        "representative",
        "members",
        let(
            F.struct(grams(title).alias("a"), grams("rep_title").alias("b")),
            lambda g: F.struct(jaccard(g["a"], g["b"]).alias("jaccard"), dice(g["a"], g["b"]).alias("dice")),
        ).alias("overlap"),
    ).select(row_id, "title_key", "representative", "members", "overlap.jaccard", "overlap.dice")
