"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest, with one folder per batch.
A batch is first reduced to one row per digest; the digests that no earlier
batch holds are found by a sort-merge anti-join, for which only the batch is
shuffled, and appended to the index.

A batch that is run again, after a failure or by choice, sees only the batches
before it and replaces what it wrote, so nothing is counted twice. A batch is
part of the index once Spark has marked its folder as complete.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.skew import lookup_join
from tidemark.session import checkpoint_root, materialize
from tidemark.sources.state import folders

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ENTRY = "digest binary, keep_id {id}, keep_row long"


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z in lower case; a null is an empty text."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower()), 256))


class DigestIndex:
    """digest, keep_id, keep_row, batch: the row that stays of every text seen so far.

    ``buckets`` counts when the index is made and stays as it is; opening an
    index that exists reads it. Its default is the session's number of shuffle
    partitions, which is set for the size of the data.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        self.spark, self.path, self.id_type = spark, path, id_type
        settings = f"{path}/settings"
        if "settings" in folders(spark, path):
            self.buckets, self.id_type = spark.read.schema("buckets int, id_type string").parquet(settings).first()
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            made = spark.range(1).select(F.lit(self.buckets).alias("buckets"), F.lit(id_type).alias("id_type"))
            made.coalesce(1).write.mode("overwrite").parquet(settings)
        self.table = f"digests_{uuid.uuid4().hex}"
        self._create(self.table, f"{path}/digests", "PARTITIONED BY (batch)")
        for batch in folders(spark, f"{path}/digests", "batch="):
            self._show(int(batch))

    def _create(self, name: str, path: str, partitioned: str = "") -> None:
        columns = _ENTRY.format(id=self.id_type) + (", batch int" if partitioned else "")
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (compression 'zstd') {partitioned} "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _show(self, batch: int) -> None:
        self.spark.sql(f"ALTER TABLE {self.table} ADD IF NOT EXISTS PARTITION (batch = {batch})")
        self.spark.catalog.refreshTable(self.table)

    def entries(self, before: int | None = None) -> DataFrame:
        """All entries, or those of the batches before a batch."""
        found = self.spark.table(self.table)
        return (found if before is None else found.filter(F.col("batch") < before)).select("digest", "keep_id", "keep_row")

    def unseen(self, best: DataFrame, batch: int) -> DataFrame:
        """The rows whose digest no earlier batch holds, dealt and sorted as the index is."""
        # the anti-join would be pushed below the repartition, and a small index shuffled again; it is not pushed below a metric
        dealt = best.repartition(self.buckets, "digest").observe(f"batch-{uuid.uuid4().hex}", F.count("*").alias("texts"))
        return dealt.join(self.entries(batch).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, best: DataFrame, batch: int) -> None:
        """Add the digests of ``best`` (digest, keep_id, keep_row; one row each) that no earlier batch holds.

        The batch's own folder is written as a table like the whole index, and becomes part of it when it is done.
        """
        folder = f"digests_{uuid.uuid4().hex}"
        self._create(folder, f"{self.path}/digests/batch={batch}")
        new = self.unseen(best, batch).select("digest", "keep_id", "keep_row")
        new.sortWithinPartitions("digest").write.insertInto(folder, overwrite=True)
        self.spark.sql(f"DROP TABLE {folder}")
        self._show(batch)


def best_of(digests: DataFrame) -> DataFrame:
    """digest, keep_id, keep_row, n: per text the row with the largest id, combined before the shuffle.

    Rows equal in id too are told apart by their row number, of which the least counts. Null ids are least.
    """
    best = F.max(F.struct("id", (-F.col("row")).alias("row"))).alias("best")
    rows = digests.groupBy("digest").agg(best, F.count("*").alias("n"))
    return rows.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.row")).alias("keep_row"), "n")


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, index: str | None = None
) -> DataFrame:
    """The kept columns, keep_id, group_size, kept and text_sha256 of every row.

    The row with the largest id stays of equal texts; exactly one, also of rows
    equal in id. Rows with a null id stay only if no other row has the text. Null
    texts count as empty. The rows with larger ids are loaded into the index first, the
    others as a second batch, so earlier batches hold the rows that stay (ids that
    are no numbers come in one batch). An empty table gives an empty table. A kept column named as one of the four new
    ones is left out. ``index``: where the index is to be, a new folder; it can be
    opened again with ``DigestIndex`` and extended.
    """
    spark = docs.sparkSession
    new = ["keep_id", "group_size", "kept", "text_sha256"]
    keep = [c for c in ([doc_id] if keep is None else keep) if c not in new]
    columns = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*columns, F.col(f"`{doc_id}`").alias("id"), digest(F.col(f"`{text}`")).alias("digest"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "text-digests")
    seen = DigestIndex(spark, index or f"{checkpoint_root(spark)}/digest-index-{uuid.uuid4().hex}", rows.schema["id"].dataType.simpleString())
    numeric = isinstance(rows.schema["id"].dataType, T.NumericType)
    middle = rows.agg((F.min("id") / 2 + F.max("id") / 2).cast(seen.id_type)).first()[0] if numeric else None
    later = F.lit(False) if middle is None else F.coalesce(F.col("id") > F.lit(middle), F.lit(False))
    halves = []
    for batch, part in enumerate([later, ~later]):
        halves.append(materialize(best_of(rows.filter(part)), "best-of-batch"))
        seen.append(halves[-1], batch)
    sizes = halves[0].unionByName(halves[1]).groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1")
    groups = materialize(sizes.join(seen.entries(), "digest").withColumn("size", F.col("n")), "copies")
    found = lookup_join(rows, groups, ["digest"], "n", F.col("row"))
    stays = F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True))
    return found.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        stays.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
