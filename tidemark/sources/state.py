"""Keyed state as versioned snapshots: written beside the old one, never over what is being read.

A snapshot of date d is the folder ``<root>/v=<d>``; Spark's commit marker
(``_SUCCESS``) tells a finished one from one whose writer died, so a run that is
killed leaves the previous state as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, root: str, prefix: str = "") -> list[str]:
    """Folders in ``root`` that were written to the end, without the prefix of their names, in order."""
    path, fs = _fs(spark, root)
    if not fs.exists(path):
        return []
    names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(path)]
    return sorted(n[len(prefix) :] for n, p in names if n.startswith(prefix) and fs.exists(p.suffix("/_SUCCESS")))


def snapshots(spark: SparkSession, root: str) -> list[str]:
    """Versions that were written to the end, oldest first."""
    return folders(spark, root, "v=")


def read_state(spark: SparkSession, root: str, schema: str, before: str | None = None) -> DataFrame:
    """The latest finished snapshot, or an empty table when there is none.

    ``before`` looks strictly earlier than a version, so that repeating a run
    reads what its first attempt read.
    """
    versions = [v for v in snapshots(spark, root) if before is None or v < before]
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/v={versions[-1]}")


def write_state(state: DataFrame, root: str, version: str) -> None:
    state.write.mode("overwrite").parquet(f"{root}/v={version}")
