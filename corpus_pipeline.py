"""The corpus pipeline: rule quality, line and near deduplication, decontamination, packing.

Each stage reads the documents that the one before kept and returns the columns
of ``documents``; the last returns packed pieces. Rows may have null or repeated
ids, null or empty texts and extra columns; a stage passes all columns on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, line_dedup, packing, quality, simhash
from tidemark.llm.corpus_queries import word_tokenizer
from tidemark.session import materialize

ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, dict, list[str]]:
    """The documents under column names that clash with none of an operator's, and the operator's arguments."""
    names = [f"column_{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    return docs.toDF(*names), {"text": of["text"], "keep": names}, of["doc_id"]


#: Rejected texts that are sent to all tasks at most, as two hashes each; of more, both sides are shuffled.
MAX_BROADCAST_TEXTS = 500_000
_KEYS = ["text_key_1", "text_key_2"]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumns({k: F.xxhash64(F.lit(i), text) for i, k in enumerate(_KEYS)})


def _without(keyed: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """Rows whose text is not among the rejected ones; a verdict on a text holds for all its copies."""
    rejected = materialize(rejected.select(*_KEYS).distinct(), name)
    few = rejected.count() <= MAX_BROADCAST_TEXTS
    return keyed.join(F.broadcast(rejected) if few else rejected, _KEYS, "left_anti").drop(*_KEYS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rules find good."""
    plain, arguments, _ = _plain(docs)
    keyed = _keyed(plain, arguments["text"])
    judged = quality.quality(keyed, arguments["text"], _KEYS)
    return _without(keyed, judged.filter("not kept"), "rejected-by-quality").toDF(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that an earlier line resembles; a document may become empty."""
    plain, arguments, doc_id = _plain(docs)
    return line_dedup.dedup_lines(plain, doc_id, **arguments).select(*plain.columns).toDF(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints.

    Similar is what ``op4_simhash`` links: fingerprints of 3-word shingles that differ
    in 3 bits at most. Documents alike by another rule, such as a 5-word Jaccard of
    0.8, mostly lie further apart and stay.
    """
    plain, arguments, doc_id = _plain(docs)
    return simhash.near_duplicates(plain, doc_id, **arguments).filter("stays").select(*plain.columns).toDF(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more lies in passages of the benchmark."""
    plain, arguments, doc_id = _plain(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumnRenamed("text", arguments["text"])
    keyed = _keyed(plain, arguments["text"])
    judged = decontamination.contamination(keyed, items, doc_id, text=arguments["text"], keep=_KEYS)
    return _without(keyed, judged.filter("contaminated"), "contaminated").toDF(*docs.columns)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return packing.pack(docs, word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("near dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("packing", token_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
