"""Keyed state in hash buckets: a merge writes only the buckets it touches.

``data/v=<version>/bucket=<n>`` holds a bucket as a version left it;
``manifest/v=<version>`` names for every bucket the version that holds it now.
The manifest is written last, and Spark's commit marker makes it count, so a
merge that dies leaves the state as it was, and one that is repeated starts
again from the version before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ledgers import upsert
from tidemark.sources.state import _fs, folders

_MANIFEST = "bucket int, version string, buckets int"


class BucketedState:
    """The state under ``root``. ``buckets`` counts when the state is first written and stays; a merge reads and writes one file or more of each."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root, schema, keys, buckets

    def versions(self) -> list[str]:
        """Versions that were written to the end, oldest first."""
        return folders(self.spark, f"{self.root}/manifest", "v=")

    def manifest(self, before: str | None = None) -> dict[int, str]:
        """The version that holds each bucket, as of the last merge, or the last one before a version."""
        found = [v for v in self.versions() if before is None or v < before]
        if not found:
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/v={found[-1]}").collect()
        self.buckets = rows[0]["buckets"] if rows else self.buckets
        return {r["bucket"]: r["version"] for r in rows}

    def _read(self, held: dict[int, str]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.root}/data/v={v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, before: str | None = None) -> DataFrame:
        """The state after the last merge, or before a version."""
        return self._read(self.manifest(before))

    def merge(self, batch: DataFrame, version: str, order: str | None = None) -> int:
        """Upsert a batch as a version and return the number of buckets written.

        Of several rows of a key the one with the highest ``order`` counts. Only
        bucket numbers reach the driver, never rows.
        """
        held = self.manifest(before=version)
        fields = self.spark.createDataFrame([], self.schema).schema.fields
        # a key hashes to the same bucket only as the same type
        extra = [] if order is None or order in [f.name for f in fields] else [F.col(order)]
        batch = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields], *extra)
        number = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = {r["b"] for r in batch.select(number.alias("b")).distinct().collect()}
        old = self._read({b: v for b, v in held.items() if b in touched})
        merged = upsert(old, batch, self.keys, order).withColumn("bucket", number)
        target = f"{self.root}/data/v={version}"
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        rows = [(b, v, self.buckets) for b, v in (held | dict.fromkeys(touched, version)).items()]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}")
        return len(touched)

    def prune(self, keep: int = 2) -> int:
        """Delete what none of the last ``keep`` versions needs; returns the folders deleted."""
        versions = self.versions()
        kept = versions[-keep:] if keep else []
        needed = set()
        for v in kept:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/v={v}").collect()
            needed |= {(r["version"], r["bucket"]) for r in rows}
        deleted = 0
        for v in versions:
            path, fs = _fs(self.spark, f"{self.root}/data/v={v}")
            for status in fs.listStatus(path):
                name = status.getPath().getName()
                if name.startswith("bucket=") and (v, int(name[7:])) not in needed:
                    deleted += bool(fs.delete(status.getPath(), True))
            if v not in kept:
                fs.delete(_fs(self.spark, f"{self.root}/manifest/v={v}")[0], True)
        return deleted
