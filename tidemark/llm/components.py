"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of every node that has a link to another one.

    Each round points all larger neighbours of a node, then all smaller ones,
    at the smallest; the number of rounds grows with the logarithm of a
    component's size. Every round is written to the shared folder. Links with a
    null or to itself say nothing and are dropped; repeated ones count once.
    """
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    links = materialize(links.filter(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        last, state, links = state, _state(after), after
        if state == last:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
