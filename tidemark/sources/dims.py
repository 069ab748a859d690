"""Source and page-watch dimensions: configuration rows with defaults merged in."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import DEFAULT_NEWS_LANE
from tidemark.sources.schemas import PAGE_WATCHES, SOURCES

MAX_SOURCES = 100_000

# What a source row means when it leaves a field out.
DEFAULTS = {
    "role": "news",
    "source_kind": "news",
    "dialect": "rss2",
    "paywalled": False,
    "max_items": 40,
    "enabled": True,
    "optional": True,
    "authority": 0.5,
    "crawl_delay_ms": 2000,
}
JOB_BOARD = {
    "role": "opportunity",
    "source_kind": "jobs",
    "dialect": "ats",
    "authority": 0.6,
    "max_items": 200,
    "lane_hints": {"venture-founder": 1.0},
}


def _frame(spark: SparkSession, rows: Iterable[Mapping], schema: str, extra: Mapping) -> DataFrame:
    fields = T._parse_datatype_string(schema)
    data = []
    for row in rows:
        merged = {**DEFAULTS, **extra, **{k: v for k, v in row.items() if v is not None}}
        data.append(tuple(merged.get(f.name) for f in fields))
    if len(data) > MAX_SOURCES:
        raise ValueError(f"{len(data)} configuration rows, more than {MAX_SOURCES}: load them as a table")
    return spark.createDataFrame(data, fields)


def sources(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    return _frame(spark, rows, SOURCES, {})


def job_boards(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    return _frame(spark, rows, SOURCES, JOB_BOARD)


def page_watches(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    return _frame(spark, rows, PAGE_WATCHES, {})


def with_defaults(df: DataFrame) -> DataFrame:
    """The same merge for a dimension that is already a table."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items() if c in df.columns})


def enabled(df: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Enabled sources, or the named few of them; applied before bodies are read."""
    df = df.filter("enabled")
    return df.filter(F.col("source_id").isin(*only)) if only else df


def attach(items: DataFrame, dim: DataFrame) -> DataFrame:
    """Source attributes on items; ``source_problem`` says which items have no source row.

    The planner broadcasts the dimension if it is small, and else shuffles and
    splits hot sources at run time.
    """
    known = dim.withColumn("_known", F.lit(True))
    joined = items.join(known, "source_id", "left")
    return joined.withColumn("source_problem", F.when(F.col("_known").isNull(), "unknown-source")).drop("_known")


def lane_from_hints(hints: Column, default: str = DEFAULT_NEWS_LANE) -> Column:
    """The strongest hinted lane; the default without hints, the first name on a tie."""
    entries = F.transform(
        F.map_entries(hints), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("lane"))
    )
    return F.coalesce(F.array_min(entries)["lane"], F.lit(default))
