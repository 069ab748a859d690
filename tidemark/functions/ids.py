"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import slug


def short_hash(text: Column, length: int = 12) -> Column:
    return F.left(F.sha2(text, 256), F.lit(length))


def item_id(canonical_url: Column) -> Column:
    """Identity is the address alone, so a syndicated story is one item."""
    return short_hash(canonical_url, 16)


def cluster_id(member_ids: Column) -> Column:
    return F.concat(F.lit("c_"), short_hash(F.array_join(F.array_sort(member_ids), "|"), 10))


def obligation_id(program_id: Column, cycle_year: Column, step_id: Column | None = None) -> Column:
    """Identity is the cycle: next year's round of a programme is a new obligation."""
    parts = [program_id.cast("string"), cycle_year.cast("string")]
    if step_id is not None:
        parts.append(F.when(step_id != "", step_id))
    return short_hash(F.concat_ws("#", *parts), 16)


def calendar_uid(program_id: Column, cycle_year: Column, step_id: Column) -> Column:
    """Readable and stable; ``step_id`` is null for the headline date."""
    key = F.concat_ws("|", program_id.cast("string"), cycle_year.cast("string"), F.coalesce(step_id, F.lit("")))
    return F.concat(
        slug(program_id.cast("string")),
        F.lit("-"),
        cycle_year.cast("string"),
        F.lit("-"),
        slug(F.coalesce(step_id, F.lit("deadline"))),
        F.lit("-"),
        short_hash(key, 8),
        F.lit("@tidemark"),
    )
