"""Located quotes against their pages and the registry: a proposal, never an edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import stage
from tidemark.functions.reader import quote_appears_in, read_deadline

MIN_PAGE_CHARS = 200


def propose(quotes: DataFrame, pages: DataFrame, registry: DataFrame, now: Column, min_page: int = MIN_PAGE_CHARS) -> DataFrame:
    """Every quote with its outcome.

    ``quotes``: program_id, quote. ``pages``: program_id, page_text.
    ``registry``: program_id, label, time_zone, cycle_year, current_date,
    current_kind, current_precision. The page check is made as the page is
    joined, and page text goes no further.
    """
    with_page = quotes.join(pages, "program_id", "left")
    checked = with_page.select(
        *quotes.columns,
        F.when(F.coalesce(F.length("page_text"), F.lit(0)) < min_page, "page too short")
        .when(F.trim("quote") == "", "nothing quoted")
        .when(~quote_appears_in(F.col("quote"), F.col("page_text")), "quote not on page")
        .alias("page_reason"),
    )
    df = checked.join(registry, "program_id", "left")
    df = stage(df, {"read": read_deadline(F.col("quote"), F.col("time_zone"), now, F.col("cycle_year"))})
    reason = F.coalesce("page_reason", "read.reason")
    return df.select(
        "program_id",
        "label",
        "quote",
        F.when(reason.isNull(), F.col("read.date")).alias("proposed_date"),
        "cycle_year",
        "current_date",
        "current_kind",
        "current_precision",
        reason.alias("refused"),
        F.when(reason.isNull(), F.col("read.date").eqNullSafe(F.col("current_date"))).alias("agrees"),
    )


def proposal_report(proposals: DataFrame) -> DataFrame:
    """Changes and confirmations."""
    accepted = proposals.filter(F.col("refused").isNull())
    return accepted.groupBy("agrees").agg(F.count("*").alias("proposals"))
