"""Generated text joined to the input it was generated from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import stage
from tidemark.functions.grounding import verdict


def input_blocks(items: DataFrame, top: int = 12) -> DataFrame:
    """One block per date: its best items, one fact each.

    ``items``: date, item_id, lane, score, title, fact, days_until. The ranking
    keeps ``top`` rows per date and task before its shuffle, so what is
    gathered per date is ``top`` rows.
    """
    from pyspark.sql import Window as W

    rank = W.partitionBy("date").orderBy(F.col("score").desc(), "item_id")
    best = items.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top)
    days = F.when(F.col("days_until").isNull(), "no date").otherwise(
        F.concat(F.col("days_until").cast("string"), F.lit(" days remaining"))
    )
    line = F.concat(
        F.lit("- ["), "lane", F.lit("] (score "), F.format_string("%.2f", "score"), F.lit(") "), "title",
        F.lit("\n  "), days, F.lit(". "), F.coalesce("fact", F.lit("")),
    )
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return best.groupBy("date").agg(body.alias("body"), F.count("*").alias("n")).select(
        "date",
        F.concat(
            F.lit("Digest date: "), F.col("date").cast("string"), F.lit("\nItems: "), F.col("n").cast("string"),
            F.lit("\n\n"), "body",
        ).alias("block"),
    )


def verdicts(rows: DataFrame) -> DataFrame:
    """Candidates beside their block with ``reason``: null when every number and name comes from the block.

    A candidate without a block has nothing to stand on: ``no-input``.
    """
    reason = F.when(F.col("block").isNull(), "no-input").otherwise(verdict(F.col("candidate"), F.col("block")))
    return stage(rows, {"reason": reason})


def check(candidates: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    return verdicts(candidates.join(blocks, keys, "left"))
