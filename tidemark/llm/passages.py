"""Passages that repeat across documents, by a sparse suffix array.

Of all suffixes only those at minimisers are kept: positions whose k-gram has the
least hash of some window, so they depend on the words alone and equal passages
keep the same ones. A suffix is ranked by a hash of as many words as any long
enough passage has after its first minimiser; the table is range-partitioned
and sorted by it, and suffixes that equal a neighbour are candidates. A match is
then extended to the left and right: of a candidate, every window of
``min_words`` words that begins so far to the left that the candidate can be its
first minimiser is looked up, and windows that two documents hold are joined to
maximal passages. So no pair of suffixes is ever made and a passage of
thousands of documents costs as much as that many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import texts as X
from tidemark.session import materialize


def _hashed(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = X.buffers(part.column("text"))
    data = X.LOWER[data]
    starts, ends, first = X.word_spans(data, offsets, X.LETTER_OR_DIGIT)
    return X.span_hashes(data, starts, ends), first


def suffixes(keyed: DataFrame, min_words: int, k: int, width: int) -> DataFrame:
    """r, doc, pos: each kept suffix of each document with the hash of the words it is ranked by."""
    reach = min_words - width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches, "text"):
            hashes, first = _hashed(part)
            ends = X.row_ends(first)
            at = X.winnow(X.gram_hashes(hashes, k), k, width, ends)
            at = at[at + reach <= ends[at]]
            ranks = X.gram_hashes(hashes, reach)[at]
            doc = np.searchsorted(first, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranks.view(np.int64)), part.column("doc").take(pa.array(doc)), pa.array(at - first[doc], pa.int32())], ["r", "doc", "pos"]
            )

    return keyed.select("doc", "text").mapInArrow(run, "r long, doc long, pos int")


def repeated_suffixes(table: DataFrame) -> DataFrame:
    """doc, pos of the suffixes that equal a neighbour in rank order; of a batch's first and last rank, all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the neighbours of a batch's first and last rank may be in another one: these ranks are all kept
        for batch in batches:
            r = np.asarray(batch.column("r"))
            if not len(r):
                continue
            same = np.zeros(len(r) + 1, bool)
            same[1:-1] = r[1:] == r[:-1]
            keep = same[1:] | same[:-1]
            keep |= (r == r[0]) | (r == r[-1])
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[1:]], ["doc", "pos"])

    ordered = table.repartitionByRange("r", "doc", "pos").sortWithinPartitions("r", "doc", "pos")
    return ordered.mapInArrow(run, "doc long, pos int")


def candidate_windows(keyed: DataFrame, candidates: DataFrame, min_words: int, width: int) -> DataFrame:
    """h, doc, id where the documents have it, pos: the windows of which a candidate can be the first minimiser."""
    own = [f for f in keyed.schema if f.name in ("doc", "id")]
    schema = T.StructType([T.StructField("h", T.LongType()), *own, T.StructField("pos", T.IntegerType())])
    places = candidates.groupBy("doc").agg(F.collect_list("pos").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches, "text"):
            hashes, first = _hashed(part)
            windows = X.gram_hashes(hashes, min_words)
            places = part.column("places")
            at = np.asarray(places.flatten()).astype(np.int64) + np.repeat(first[:-1], np.diff(np.asarray(places.offsets)))
            wanted = np.zeros(len(hashes) + 1, np.int64)
            doc = np.searchsorted(first, at, "right") - 1
            np.add.at(wanted, np.maximum(at - width + 1, first[doc]), 1)
            np.add.at(wanted, at + 1, -1)
            begin = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
            begin = begin[begin + min_words <= X.row_ends(first)[begin]]
            doc = np.searchsorted(first, begin, "right") - 1
            taken = [part.column(f.name).take(pa.array(doc)) for f in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(windows[begin].view(np.int64)), *taken, pa.array(begin - first[doc], pa.int32())], schema.names
            )

    return keyed.join(places, "doc").select(*[f.name for f in own], "text", "places").mapInArrow(run, schema)


def repeated_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, k: int = 8, width: int = 18
) -> DataFrame:
    """doc_id, start, n_words, n_seen_before: the maximal passages that other documents hold as well.

    Words are lower-cased runs of letters and digits, places count words. Every
    word of every window of ``min_words`` words that occurs in two documents lies
    in a passage; passages overlap no other one of their document. A passage of
    one document may consist of windows from several others. ``n_seen_before``:
    how many of its windows an earlier document (by id) has. Rows equal in id and
    text are one document; null texts have no words; an empty table no passages.
    """
    if min_words < k + width - 1 + width - 1:
        raise ValueError("min_words is too small for the minimisers' window")
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = docs.select(F.xxhash64(F.col(f"`{doc_id}`"), value).alias("doc"), F.col(f"`{doc_id}`").alias("id"), value.alias("text"))
    keyed_once = keyed.select("doc", "text")
    table = materialize(suffixes(keyed_once, min_words, k, width).distinct(), "suffixes")
    candidates = materialize(repeated_suffixes(table), "candidate-suffixes")
    windows = materialize(candidate_windows(keyed, candidates, min_words, width), "candidate-windows")
    return passages_of(windows, doc_id, min_words)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col(f"`{doc_id}`"), value).alias("doc"), F.col(f"`{doc_id}`").alias("id"), value.alias("text"))


def removable_windows(docs: DataFrame, doc_id: str, text: str, min_words: int, k: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The documents, doc, id and text; doc and pos of each window that has an earlier place.

    The first place of a window is that in the least document by id, of equal ids
    the least by text hash, and there the leftmost; null ids come last.
    """
    keyed = _keyed(docs, doc_id, text).distinct()
    once = keyed.select("doc", "text")
    table = materialize(suffixes(once, min_words, k, width), "suffixes")
    candidates = materialize(repeated_suffixes(table).distinct(), "candidate-suffixes")
    windows = materialize(candidate_windows(once, candidates, min_words, width), "candidate-windows")
    ids = keyed.select("doc", F.struct(F.col("id").isNull().alias("none"), "id", "doc").alias("at"))
    placed = windows.join(ids, "doc").select("h", "doc", "pos", F.struct("at", "pos").alias("place"))
    # the least place is found before the shuffle; a window of one place only has no other row to remove
    first = placed.groupBy("h").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first")
    again = placed.join(first, "h").filter(F.col("place") != F.col("first")).select("doc", "pos")
    return keyed, materialize(again, "removable-windows")


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, k: int = 8, width: int = 18
) -> DataFrame:
    """doc_id, n_words, n_removed, spans, text: each document without what it repeats.

    A word is removed if it lies in a window of ``min_words`` words that an earlier
    document (by id) or an earlier place of its own document holds; of every
    window the first place stays, unless its words lie in another repeated one.
    ``spans``: start and n_words of the runs of removed words, in order; places
    count words. The text between two kept words goes with the removed ones; all
    other bytes stay. Rows equal in id and text are one document.
    """
    if min_words < k + width - 1 + width - 1:
        raise ValueError("min_words is too small for the minimisers' window")
    keyed, again = removable_windows(docs, doc_id, text, min_words, k, width)
    places = again.groupBy("doc").agg(F.collect_list("pos").alias("places"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType())])
    schema = T.StructType(
        [
            T.StructField("id", keyed.schema["id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(span)),
            T.StructField("text", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches, "text"):
            data, offsets = X.buffers(part.column("text"))
            starts, ends, first = X.word_spans(X.LOWER[data], offsets, X.LETTER_OR_DIGIT)
            spans, texts = [], []
            for row, mine in enumerate(part.column("places").to_pylist()):
                runs: list[list[int]] = []
                for pos in sorted(mine or ()):
                    if runs and pos <= runs[-1][1]:
                        runs[-1][1] = pos + min_words
                    else:
                        runs.append([pos, pos + min_words])
                low, pieces = int(offsets[row]), []
                for a, b in runs:
                    pieces.append(data[low : starts[first[row] + a]].tobytes())
                    last = int(first[row] + b)
                    # up to the next kept word, or the end of the last removed one
                    low = int(starts[last]) if last < first[row + 1] else int(ends[last - 1])
                pieces.append(data[low : offsets[row + 1]].tobytes())
                spans.append([{"start": a, "n_words": b - a} for a, b in runs])
                texts.append(b"".join(pieces).decode())
            removed = [sum(s["n_words"] for s in x) for x in spans]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.string())],
                schema.names,
            )

    joined = keyed.join(places, "doc", "left").select("id", "text", "places")
    return joined.mapInArrow(run, schema).withColumnRenamed("id", doc_id)


def passages_of(windows: DataFrame, doc_id: str, min_words: int) -> DataFrame:
    """Join windows (h, doc, id, pos) that two documents hold to passages."""
    # windows bring their document's id, so that they travel by their hash once
    known = windows.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.min("id").alias("first")).filter("a <> b").select("h", "first")
    held = windows.join(known, "h").select("h", "doc", "id", "pos", (F.col("first") < F.col("id")).alias("seen"))
    marked = held.distinct().select("doc", "id", "pos", "seen")

    kind = windows.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("id", kind)] + [T.StructField(c, T.LongType()) for c in ("start", "n_words", "n_seen_before")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            if not table.num_rows:
                continue
            doc = np.asarray(table.column("doc"))
            cut = int(np.searchsorted(doc, doc[-1]))
            rest = table.slice(cut).combine_chunks().to_batches()[0]
            if cut:
                yield spans(table.slice(0, cut))
        if rest is not None:
            yield spans(pa.Table.from_batches([rest]))

    def spans(table: pa.Table) -> pa.RecordBatch:
        doc, pos = np.asarray(table.column("doc")), np.asarray(table.column("pos")).astype(np.int64)
        seen = np.asarray(table.column("seen").fill_null(False).cast(pa.int8())).astype(np.int64)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + min_words)
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(doc)) - 1
        return pa.RecordBatch.from_arrays(
            [
                table.column("id").combine_chunks().take(pa.array(start)),
                pa.array(pos[start]),
                pa.array(pos[last] + min_words - pos[start]),
                pa.array(np.add.reduceat(seen, start)),
            ],
            schema.names,
        )

    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = marked.repartition(n, "doc").sortWithinPartitions("doc", "pos")
    return ordered.mapInArrow(run, schema).withColumnRenamed("id", doc_id)
