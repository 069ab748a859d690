"""Late and future rows of a stream, set aside and counted instead of lost.

Spark drops rows behind the watermark before a stateful step sees them. Here a
batch is first split by the newest time of the batches before it, so what the
step would lose is filed beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.accounting import counted
from tidemark.sources.state import folders

_MARK = "newest timestamp, on_time long, late long, future long"


def newest(spark: SparkSession, root: str, before: int | None = None):
    """The newest time that the batches so far, or those before a batch, have shown; None at the start."""
    found = [v for v in folders(spark, f"{root}/marks", "b=") if before is None or int(v) < before]
    if not found:
        return None
    return spark.read.schema(_MARK).parquet(f"{root}/marks/b={found[-1]}").first()["newest"]


def split_sink(
    root: str, at: str, delay: str, latest: Column, handle: Callable[[DataFrame, int], None] | None = None
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that files every row under ``rows`` as on-time, late or future.

    Late is what lies more than ``delay`` behind the newest time of earlier
    batches, future what lies after ``latest``; future rows do not move the
    newest time on. Rows without a time are on time. ``handle`` gets the rows
    that are on time. A replayed batch sees the batches before it and replaces its rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, number = batch.sparkSession, f"{batch_id:012d}"
        mark = newest(spark, root, before=batch_id)
        time = F.col(at).cast("timestamp")
        behind = F.lit(False) if mark is None else time < F.lit(mark) - F.expr(f"INTERVAL {delay}")
        outcome = F.when(time > latest, "future").when(behind, "late").otherwise("on-time")
        marked = batch.withColumns({"outcome": outcome, "batch": F.lit(f"b-{number}")})

        def file(rows: DataFrame) -> None:
            out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.partitionBy("batch", "outcome").parquet(f"{root}/rows")

        is_ = lambda name: F.col("outcome") == name
        counts = {n.replace("-", "_"): F.count_if(is_(n)) for n in ("on-time", "late", "future")}
        found = counted(marked, counts | {"newest": F.max(F.when(~is_("future"), time))}, file)
        top = max([t for t in (mark, found["newest"]) if t is not None], default=None)
        row = [(top, found["on_time"], found["late"], found["future"])]
        if handle is not None:
            done = spark.read.parquet(f"{root}/rows").filter((F.col("batch") == f"b-{number}") & (F.col("outcome") == "on-time"))
            handle(done.drop("batch", "outcome"), batch_id)
        spark.createDataFrame(row, _MARK).coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/b={number}")

    return write


def split_counts(spark: SparkSession, root: str) -> DataFrame:
    """batch, newest, on_time, late, future: one row per batch."""
    rows = spark.read.schema(f"{_MARK}, b string").parquet(f"{root}/marks")
    return rows.select(F.col("b").cast("long").alias("batch"), "newest", "on_time", "late", "future")
