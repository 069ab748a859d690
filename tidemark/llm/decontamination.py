"""Benchmark decontamination by winnowed fingerprints.

Documents and benchmark items are cut into words. Of every window of ``width``
k-grams the least hash is a fingerprint, so any ``k + width - 1`` (13) words that
a document shares with an item hold a fingerprint of both. Fingerprints are
joined, and each hit is extended to the left and right, word by word, over the
words that a window around the fingerprint can reach; those words travel with
the fingerprint, so no text is joined. Items shorter than a window are a window
themselves, found by the hash of all their words.

Before the join, document fingerprints pass a bitmap of the benchmark's. Its
size is a parameter and does not grow with either table; with a very large
benchmark it lets more rows through, and the join stays right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import texts as X
from tidemark.session import materialize

_HITS = T.ArrayType(
    T.StructType(
        [
            T.StructField("span", T.IntegerType()),
            T.StructField("h", T.LongType()),
            T.StructField("pos", T.IntegerType()),
            T.StructField("words", T.ArrayType(T.StringType())),
        ]
    )
)
_ARROW_HITS = pa.list_(
    pa.struct([("span", pa.int32()), ("h", pa.int64()), ("pos", pa.int32()), ("words", pa.list_(pa.string()))])
)


def _fingerprints(df: DataFrame, keep: list[str], text: str, k: int, width: int, shorts, bitmap=None) -> DataFrame:
    """The kept columns as k0, k1, ..., n_words and the fingerprints of each row.

    ``shorts``: window lengths under the full one to look for everywhere, or
    None for benchmark items, whose length decides. ``bitmap``: a broadcast of
    the fingerprints worth keeping.
    """
    full = k + width - 1
    names = [f"k{i}" for i in range(len(keep))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for part in X.slices(batches, "text"):
            data, offsets = X.buffers(part.column("text"))
            data = X.LOWER[data]
            starts, ends, first = X.word_spans(data, offsets, X.LETTER_OR_DIGIT)
            hashes, stops = X.span_hashes(data, starts, ends), X.row_ends(first)
            sizes = np.diff(first)
            found = []
            grams = X.gram_hashes(hashes, k)
            at = X.winnow(grams, k, width, stops)
            found.append((full, at, grams[at]))
            for n in range(1, full) if shorts is None else shorts:
                grams = X.gram_hashes(hashes, n)
                if shorts is None:
                    at = first[:-1][sizes == n]
                else:
                    at = np.flatnonzero(np.arange(len(grams)) + n <= stops[: len(grams)])
                found.append((n, at, grams[at]))
            rows: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for span, at, h in found:
                if bits is not None:
                    slot = h & np.uint64(len(bits) * 64 - 1)
                    keep = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                    at, h = at[keep], h[keep]
                doc = np.searchsorted(first, at, "right") - 1
                for p, d, value in zip(at.tolist(), doc.tolist(), h.view(np.int64).tolist(), strict=True):
                    low, high = (p - width + 1, p + full) if span == full else (p, p + span)
                    words = [
                        bytes(data[starts[i] : ends[i]]).decode("utf-8", "replace") if first[d] <= i < first[d + 1] else None
                        for i in range(low, high)
                    ]
                    rows[d].append({"span": span, "h": value, "pos": p - int(first[d]), "words": words})
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(sizes, pa.int64()), pa.array(rows, _ARROW_HITS)], [*names, "n_words", "hits"]
            )

    schema = T.StructType(
        [T.StructField(n, df.schema[c].dataType) for n, c in zip(names, keep, strict=True)]
        + [T.StructField("n_words", T.LongType()), T.StructField("hits", _HITS)]
    )
    kept = [F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)]
    return df.select(*kept, F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(scan, schema)


def _bitmap(prints: DataFrame, log2_bits: int):
    """The fingerprints' low bits as a bitmap of a fixed size, broadcast to the tasks."""
    low = F.col("h").bitwiseAND(F.lit((1 << log2_bits) - 1))
    words = (
        prints.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.expr("bit_or(bit)").alias("bits"))
        .collect()
    )
    out = np.zeros((1 << log2_bits) // 64, np.int64)
    for row in words:
        out[row["word"]] = row["bits"]
    return prints.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def _differing(low: int, high: int) -> Column:
    """Offsets at which the words around a document's and an item's fingerprint differ or end."""
    return F.filter(
        F.sequence(F.lit(low), F.lit(high)), lambda i: ~F.coalesce(F.get("words", i) == F.get("item_words", i), F.lit(False))
    )


def matched_spans(
    docs: DataFrame, items: DataFrame, keep: list[str], item_id: str, text: str = "text", k: int = 5, width: int = 9, log2_bits: int = 24
) -> tuple[DataFrame, DataFrame]:
    """Scanned documents (row, kept columns as k0, ..., n_words) and their hits (row, start, end, item_id).

    A hit is a run of words of a document that an item has as well: as long as
    the words carried around the fingerprint reach, and k + width - 1 words at
    least, or all words of a shorter item. Runs of one document overlap.
    """
    full = k + width - 1
    prints = materialize(
        _fingerprints(items, [item_id], text, k, width, None)
        .select(F.col("k0").alias("item_id"), F.explode("hits").alias("hit"))
        .select("item_id", "hit.span", "hit.h", F.col("hit.words").alias("item_words"))
        .distinct(),
        "item-fingerprints",
    )
    # at most full - 1 values
    shorts = [r["span"] for r in prints.filter(F.col("span") < full).select("span").distinct().collect()]
    scanned = materialize(
        _fingerprints(docs, keep, text, k, width, sorted(shorts), _bitmap(prints, log2_bits)).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "scanned-documents",
    )
    hits = scanned.select("row", F.explode("hits").alias("hit")).select("row", "hit.span", "hit.h", "hit.pos", "hit.words")
    both = hits.join(prints, ["span", "h"])
    left = F.lit(width - 2) - F.coalesce(F.array_max(_differing(0, width - 2)), F.lit(-1))
    right = F.coalesce(F.array_min(_differing(width - 1 + k, full + width - 2)), F.lit(full + width - 1)) - (width - 1 + k)
    long = (
        both.filter(F.col("span") == full)
        .filter(F.size(_differing(width - 1, width - 2 + k)) == 0)
        .select("row", "item_id", (F.col("pos") - left).alias("start"), (F.col("pos") + k + right).alias("end"))
        .filter(F.col("end") - F.col("start") >= full)
    )
    short = both.filter((F.col("span") < full) & (F.col("words") == F.col("item_words"))).select(
        "row", "item_id", F.col("pos").alias("start"), (F.col("pos") + F.col("span")).alias("end")
    )
    return scanned.drop("hits"), long.unionByName(short).distinct()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    log2_bits: int = 24,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: the kept columns (its id), words, words inside any shared window, items found.

    A null or empty text has no words and is clean. Rows with a null or repeated
    id are judged one by one. Items without words have no window; repeated item
    ids count once, null ids are hits but not listed. Other columns are ignored.
    """
    keep = [doc_id] if keep is None else keep
    scanned, spans = matched_spans(docs, items, keep, item_id, text, log2_bits=log2_bits)
    spans = materialize(spans, "matched-spans")
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    hit = (
        spans.select("row", "start", "end")
        .distinct()
        .withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0)))
        .groupBy("row")
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "done"))).alias("n_hit"))
    )
    found = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    n_hit, items_found = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return (
        scanned.join(hit, "row", "left")
        .join(found, "row", "left")
        .select(
            *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
            F.col("n_words").cast("long").alias("n_words"),
            n_hit.alias("n_hit"),
            F.size(items_found).cast("long").alias("n_items"),
            F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )
