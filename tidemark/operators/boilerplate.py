"""Sentences a source repeats across its own items say nothing about any of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import sentence_key, sentences
from tidemark.operators.skew import lookup_join

MIN_ITEMS = 4
REPEAT_FRACTION = 0.5
MIN_SENTENCE_CHARS = 40
#: Buckets that a source's sentences are first counted in.
SKETCH_BUCKETS = 1024


def _digest(key: Column) -> Column:
    """128 bits instead of the sentence: what is counted and compared, never shown."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def with_sentences(items: DataFrame, body: str = "body", min_chars: int = MIN_SENTENCE_CHARS) -> DataFrame:
    """Add ``sentences``: the sentences of the whole body, in order, with their digests."""
    df = items.withColumn("_raw", sentences(F.coalesce(F.col(body), F.lit("")), min_chars))
    return df.withColumn(
        "sentences", F.transform("_raw", lambda s: F.struct(s.alias("text"), _digest(sentence_key(s)).alias("h")))
    ).drop("_raw")


def _sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("source_id").agg(F.count("*").alias("source_items"))


def _of_every_source(items: DataFrame, found: DataFrame) -> DataFrame:
    """What was found, and a row of nulls for each source without it: ``lookup_join`` spreads only keys that it knows."""
    return _sizes(items).join(found, "source_id", "left")


def _thresholds(items: DataFrame, fraction: float, min_items: int) -> DataFrame:
    sizes = _sizes(items)
    needed = F.greatest(F.lit(2), F.ceil(F.col("source_items") * fraction))
    return sizes.filter(F.col("source_items") >= min_items).withColumn("needed", needed)


def _distinct(digests: Column) -> Column:
    """The digests of an item, each once."""
    return F.array_distinct(F.transform(digests, lambda s: s["h"]))


def sentence_counts(items: DataFrame) -> DataFrame:
    """Items per (source, sentence digest).

    A sentence counts once per item, removed inside the row, so the explode
    feeds straight into a partial count: a sentence shared by a third of all
    items leaves each task as one row.
    """
    return (
        items.select("source_id", F.explode(_distinct(F.col("sentences"))).alias("h"))
        .groupBy("source_id", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
        .agg(F.count("*").alias("n"))
    )


def _bucket(digest: Column) -> Column:
    return F.pmod(digest["a"], F.lit(SKETCH_BUCKETS)).cast("int")


def possible_buckets(items: DataFrame, limits: DataFrame) -> DataFrame:
    """``(source_id, buckets)``: buckets of digests whose sentences can be frequent enough, per source.

    A bucket counts all its sentences together, so it reaches the threshold if
    one of them does. What other sentences put into a bucket is (sentences per
    item) / ``SKETCH_BUCKETS`` of the items, far below a fixed share of them
    however many items there are. A task sends on a count per source and bucket.
    """
    rows = items.select("source_id", F.explode(F.transform(_distinct(F.col("sentences")), _bucket)).alias("bucket"))
    counts = rows.groupBy("source_id", "bucket").agg(F.count("*").alias("n"))
    reached = counts.join(limits, "source_id").filter("n >= needed")
    return reached.groupBy("source_id").agg(F.collect_list("bucket").alias("buckets"))


def find_boilerplate(items: DataFrame, fraction: float = REPEAT_FRACTION, min_items: int = MIN_ITEMS, row_id: str = "item_id") -> DataFrame:
    """``(source_id, a, b, n)`` for sentences in enough of their source's items.

    Sentences are exactly counted only where their bucket reaches the threshold.
    """
    limits = _thresholds(items, fraction, min_items)
    buckets = _of_every_source(items, possible_buckets(items, limits))
    known = lookup_join(items.select(row_id, "source_id", "sentences"), buckets, ["source_id"], "source_items", F.col(row_id))
    possible = F.filter("sentences", lambda s: F.array_contains(F.col("buckets"), _bucket(s["h"])))
    found = sentence_counts(known.select("source_id", possible.alias("sentences")).filter(F.size("sentences") > 0))
    return found.filter("n >= 2").join(limits, "source_id").filter("n >= needed").select("source_id", "a", "b", "n", "source_items")


def boilerplate_sentences(
    items: DataFrame, fraction: float = REPEAT_FRACTION, min_items: int = MIN_ITEMS
) -> DataFrame:
    """The same with the text of each key, for reading: grouped by text, counted before the shuffle."""
    keys = F.array_distinct(F.transform("sentences", lambda s: sentence_key(s["text"])))
    counts = (
        items.select("source_id", F.explode(keys).alias("key")).groupBy("source_id", "key").agg(F.count("*").alias("n"))
    )
    limits = _thresholds(items, fraction, min_items)
    return counts.filter("n >= 2").join(limits, "source_id").filter("n >= needed").select("source_id", "key", "n")


def boilerplate_size(boilerplate: DataFrame) -> DataFrame:
    return boilerplate.groupBy("source_id").agg(F.count("*").alias("stripped"))


def strip_boilerplate(
    items: DataFrame,
    fraction: float = REPEAT_FRACTION,
    min_items: int = MIN_ITEMS,
    row_id: str = "item_id",
) -> DataFrame:
    """Add ``stripped``: the body without its source's boilerplate, sentence order kept.

    A source's boilerplate is short whatever its size: a sentence must occur in
    a fixed share of the items, so there are at most (sentences per item) /
    fraction of them. They are gathered into one array per source and looked
    up from each item, and the filtering happens inside the row; bodies are not
    taken apart across a shuffle and put together again. A source with nothing
    to strip keeps its body as it is.
    """
    per_source = (
        find_boilerplate(items, fraction, min_items, row_id)
        .groupBy("source_id")
        .agg(F.collect_list(F.struct("a", "b")).alias("boiler"))
    )
    joined = lookup_join(items, _of_every_source(items, per_source), ["source_id"], "source_items", F.col(row_id))
    kept = F.filter("sentences", lambda s: ~F.array_contains(F.col("boiler"), s["h"]))
    text = F.trim(F.array_join(F.transform(kept, lambda s: s["text"]), " "))
    return joined.withColumn("stripped", F.when(F.col("boiler").isNull(), F.col("body")).otherwise(text)).drop("boiler")
