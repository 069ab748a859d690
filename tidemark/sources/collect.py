"""Feed and board entries with the attributes of their sources, in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.dims import attach

FIELDS = (
    "source_id", "pos", "title", "url", "canonical_url", "item_id", "published_at", "date_precision", "body",
    "body_provenance", "paywalled", "outcome", "warning",
)
ATTRIBUTES = ("source_kind", "publisher_group", "authority", "lane_hints", "exclude_url", "exclude_title", "require_any")


def collected_items(feeds: DataFrame, boards: DataFrame, dim: DataFrame) -> DataFrame:
    """One row per entry of either kind, with its source's attributes.

    ``outcome`` keeps why an entry is not an item; an entry that would be kept
    but whose source has no row is ``unknown-source``. No entry is lost.
    """
    parts = [f.select(*[c for c in FIELDS if c in f.columns]) for f in (feeds, boards)]
    entries = parts[0].unionByName(parts[1], allowMissingColumns=True)
    known = attach(entries, dim.select("source_id", *ATTRIBUTES))
    missing = (F.col("outcome") == "kept") & F.col("source_problem").isNotNull()
    return known.withColumn("outcome", F.when(missing, F.col("source_problem")).otherwise(F.col("outcome"))).drop("source_problem")
