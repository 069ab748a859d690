"""Daily digests: one table per part, by date and run, visible once the run is committed.

A run stages its parts under ``<part>/date=<date>/run=<run>`` and then commits
the day with one small file, ``_commits/<date>/<number>-<run>``. Readers look
for the last commit of a date, so a run that dies half-way shows nothing, a run
that is repeated replaces its own rows, and a forced run replaces the day at
the moment it commits.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.accounting import counted
from tidemark.sources.state import _fs

PARTS = ("health", "items", "lane_items", "countdown", "verify", "events", "stats")
LOOK_BACK = 10
_COMMITS = "_commits"


def _folder(run: str) -> str:
    """A run's folder: never a name that reads as a number."""
    return f"r-{run}"


def commits(spark: SparkSession, root: str) -> dict[str, str]:
    """The run that counts for every committed date: the last one. One small name per day reaches the driver."""
    path, fs = _fs(spark, f"{root}/{_COMMITS}")
    if not fs.exists(path):
        return {}
    out = {}
    for day in fs.listStatus(path):
        names = sorted(s.getPath().getName() for s in fs.listStatus(day.getPath()))
        if names:
            out[day.getPath().getName()] = names[-1].split("-", 1)[1]
    return dict(sorted(out.items()))


def digest_dates(spark: SparkSession, root: str) -> list[str]:
    """Dates with a complete digest."""
    return list(commits(spark, root))


def stage_part(df: DataFrame, root: str, name: str, date: str, run: str, counts: Mapping[str, Column] | None = None) -> dict:
    """Write one part of a run; nobody sees it yet. Returns the counts of its rows."""
    dated = df.withColumns({"date": F.lit(date).cast("date"), "run": F.lit(_folder(run))})

    def write(rows: DataFrame) -> None:
        out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("date", "run").parquet(f"{root}/{name}")

    if counts:
        return counted(dated, counts, write)
    write(dated)
    return {}


def commit_day(spark: SparkSession, root: str, date: str, run: str) -> None:
    """From now on the date shows this run. Committing a run twice changes nothing."""
    path, fs = _fs(spark, f"{root}/{_COMMITS}/{date}")
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    if run in [n.split("-", 1)[1] for n in names]:
        return
    number = int(names[-1].split("-", 1)[0]) + 1 if names else 0
    # a name is taken once only: of two runs that commit at the same time, one fails
    marker, _ = _fs(spark, f"{root}/{_COMMITS}/{date}/{number:06d}-{run}")
    if not fs.createNewFile(marker):
        raise ValueError(f"{date} is being committed by another run")


def write_digest(
    spark: SparkSession, parts: dict[str, DataFrame], root: str, date: str, force: bool = False, run: str | None = None
) -> bool:
    """Write a day once; a date already there is left alone unless forced.

    ``run`` names the attempt: repeating it gives the same files and touches no
    other day.
    """
    if date in digest_dates(spark, root) and not force:
        return False
    run = run or uuid.uuid4().hex
    for name, df in parts.items():
        stage_part(df, root, name, date, run)
    commit_day(spark, root, date, run)
    return True


def previous_date(spark: SparkSession, root: str, date: str, look_back: int = LOOK_BACK) -> str | None:
    """The newest digest strictly before a date, among the last few."""
    earlier = [d for d in digest_dates(spark, root) if d < date]
    return earlier[-look_back:][-1] if earlier else None


def window_start(spark: SparkSession, root: str, date: str) -> str:
    return previous_date(spark, root, date) or date


def read_part(spark: SparkSession, root: str, name: str, date: str | None = None) -> DataFrame:
    """One part of the archive, of the runs that count.

    A date reads one folder. Without one, the table is joined with the commits,
    a row per day, which the planner turns into a choice of folders.
    """
    runs = commits(spark, root)
    df = spark.read.parquet(f"{root}/{name}")
    if date is not None:
        return df.filter((F.col("date") == F.lit(date).cast("date")) & (F.col("run") == _folder(runs.get(date, "")))).drop("run")
    rows = [(d, _folder(r)) for d, r in runs.items()]
    known = spark.createDataFrame(rows, "date string, run string").select(F.to_date("date").alias("date"), "run")
    return df.join(F.broadcast(known), ["date", "run"], "left_semi").drop("run")


def read_run(spark: SparkSession, root: str, name: str, date: str, run: str) -> DataFrame:
    """One part as a run staged it, committed or not."""
    df = spark.read.parquet(f"{root}/{name}")
    return df.filter((F.col("date") == F.lit(date).cast("date")) & (F.col("run") == _folder(run))).drop("run")


def previous_rows(rows: DataFrame, before, n: int = 1) -> DataFrame:
    """The last ``n`` dates strictly before a date, from a table of dated rows."""
    return rows.filter(F.col("date") < before).select("date").distinct().orderBy(F.col("date").desc()).limit(n)


def append_run_status(status: DataFrame, path: str, run: str) -> None:
    """Add a run's row to the history of runs; a run that reports again replaces its row."""
    out = status.withColumns({"run_id": F.lit(run), "run": F.lit(_folder(run))}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("run").parquet(path)


def read_run_status(spark: SparkSession, path: str) -> DataFrame:
    """One row per run that reported."""
    return spark.read.parquet(path).drop("run")


def to_document(items: DataFrame) -> DataFrame:
    """Items as one JSON text per row, for exports that want the nested form."""
    return items.select("date", "item_id", F.to_json(F.struct(*items.columns)).alias("document"))
