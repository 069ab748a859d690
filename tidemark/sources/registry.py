"""The registry table: an explicit schema, with defaults applied on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import READER_ZONE, WEIGHTS
from tidemark.sources.schemas import PROGRAMS


def with_defaults(
    programs: DataFrame, time_zone: str = READER_ZONE, verify_every: int = WEIGHTS.verify_every_days
) -> DataFrame:
    fill = {"status": "active", "priority": "normal", "time_zone": time_zone, "verify_every": verify_every}
    return programs.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def read_registry(spark: SparkSession, path: str, fmt: str = "json", **defaults) -> DataFrame:
    """Programmes from JSON lines or Parquet. Types are declared, never inferred."""
    return with_defaults(spark.read.schema(PROGRAMS).format(fmt).load(path), **defaults)
