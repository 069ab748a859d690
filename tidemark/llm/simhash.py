"""SimHash near-duplicates through a positional byte index with count filtering.

A fingerprint has eight bytes, each at its position. Two fingerprints that
differ in at most three bits differ in at most three bytes, so they share at
least five positional bytes: the guaranteed minimum of matches. An index of
single positional bytes would hold a 256th of all documents in every list and
tally all pairs; here a posting is a choice of five positions with their bytes
(56 for each fingerprint), so two fingerprints meet in a list if, and only if,
their tally of shared positional bytes reaches the minimum. What meets is
verified by its differing bits.

Copies share a fingerprint and are one entry of the index. A list gives only
the links that connect its members, never all pairs: they share five bytes, so
a list holds at most 2^24 values, and the links of a long one are found by
looking up each member's neighbours instead of comparing all members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import texts as X
from tidemark.llm.components import components
from tidemark.session import materialize

SEED = 42


def text_fingerprints(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """SimHash of each text over the XXH64 of its word shingles."""
    data, offsets = X.buffers(column)
    data = X.LOWER[data]
    starts, ends, first = X.word_spans(data, offsets, X.NOT_SPACE)
    # the texts again with one space after each word
    word = X.NOT_SPACE[data]
    keep = word.copy()
    keep[1:] |= word[:-1]
    place = np.cumsum(keep) - 1
    tight = np.where(word, data, 0x20)[keep].astype(np.uint8).tobytes()
    counts = np.diff(first)
    grams = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(grams)])
    head = np.repeat(first[:-1] - begin[:-1], grams) + np.arange(begin[-1])
    last = np.minimum(head + shingle, np.repeat(first[1:], grams)) - 1
    out = np.zeros(len(counts), np.uint64)
    if not len(head):
        return out
    digest = xxhash.xxh64_intdigest
    spans = zip(place[starts[head]].tolist(), (place[ends[last] - 1] + 1).tolist(), strict=True)
    hashes = np.array([digest(tight[a:b], SEED) for a, b in spans], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    filled = np.flatnonzero(grams)
    sums = np.add.reduceat(bits, begin[:-1][filled], axis=0, dtype=np.int32)
    out[filled] = np.packbits(2 * sums > grams[filled, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def with_fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = 3) -> DataFrame:
    """The kept columns and ``simhash_bits``, the fingerprint as a signed long. A null text has no words: zero."""
    keep = df.columns if keep is None else keep
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    schema = T.StructType(
        [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(keep)] + [T.StructField("simhash_bits", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches, "t"):
            values = text_fingerprints(part.column("t"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(values)], schema.names)

    return df.select(*columns, F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, schema).toDF(*keep, "simhash_bits")


def _neighbours(bits: int, most: int) -> np.ndarray:
    """All differences within the given free bits of at most so many bits, but none."""
    free = [1 << i for i in range(64) if bits >> i & 1]
    return np.array([sum(c) for n in range(1, most + 1) for c in combinations(free, n)], np.uint64)


def connecting_links(values: np.ndarray, free_bits: int, most: int, masks: dict[int, np.ndarray]) -> list[tuple[int, int]]:
    """Links within sorted distinct values that connect what pairs of at most ``most`` differing bits connect."""
    n, links = len(values), []
    left = np.ones(n, bool)
    look_up = n > 4096
    if look_up and free_bits not in masks:
        masks[free_bits] = _neighbours(free_bits, most)
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed], queue = False, [seed]
        while queue:
            at = queue.pop()
            if look_up:
                wanted = values[at] ^ masks[free_bits]
                slot = np.minimum(np.searchsorted(values, wanted), n - 1)
                near = slot[(values[slot] == wanted) & left[slot]]
            else:
                others = np.flatnonzero(left)
                near = others[np.bitwise_count(values[others] ^ values[at]) <= most]
            left[near] = False
            queue += near.tolist()
            links += [(int(values[at]), int(values[i])) for i in near.tolist()]
    return links


def fingerprint_links(prints: DataFrame, bits: str = "simhash_bits", most: int = 3) -> DataFrame:
    """a, b: links that connect the distinct fingerprints with at most ``most`` differing bits."""
    shared = 8 - most
    chosen = [sum(0xFF << 8 * p for p in c) for c in combinations(range(8), shared)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    postings = prints.select(
        F.col(bits).alias("bits"), F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("which", "mask")
    ).select(F.col("which").cast("byte").alias("which"), F.col("bits").bitwiseAND(F.col("mask")).alias("bytes"), "bits")
    schema = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, np.ndarray] = {}
        rest = np.zeros((0, 3), np.int64)

        def links_of(rows: np.ndarray) -> list[tuple[int, int]]:
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            bounds = np.concatenate([[0], cuts, [len(rows)]])
            out: list[tuple[int, int]] = []
            for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
                group = rows[bounds[i] : bounds[i + 1]]
                free = (1 << 64) - 1 - chosen[int(group[0, 0])]
                out += connecting_links(np.sort(group[:, 2].view(np.uint64)), free, most, masks)
            return out

        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

        for batch in batches:
            rows = np.stack([np.asarray(c, dtype=np.int64) for c in batch.columns], axis=1)
            rows = np.concatenate([rest, rows])
            if not len(rows):
                continue
            # the last posting list may go on in the next batch
            last = int(np.argmax((rows[:, :2] == rows[-1, :2]).all(axis=1)))
            rest = rows[last:]
            yield batch_of(links_of(rows[:last]))
        yield batch_of(links_of(rest))

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.repartition(n, "which", "bytes").sortWithinPartitions("which", "bytes")
    return dealt.mapInArrow(run, schema).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, most: int = 3) -> DataFrame:
    """The kept columns of every row with its fingerprint, component and whether it is the one that stays.

    ``component_id``: the smallest id reachable over links, itself included
    (null ids are larger than all others). One row of a component stays: that
    of the smallest id, of several the first as they were read. Texts without
    words have fingerprint zero and link like any other. A kept column named as
    one of the three new ones is left out.
    """
    keep = [c for c in ([doc_id] if keep is None else keep) if c not in ("fingerprint", "component_id", "stays")]
    # kept columns go by numbers inside, so that no name clashes and none needs quotes
    names = [f"k{i}" for i in range(len(keep))]
    plain = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")
    )
    tagged = with_fingerprints(plain, "text", [*names, "id"]).withColumn("simhash_row", F.monotonically_increasing_id())
    tagged = materialize(tagged, "fingerprints")
    least = F.min(F.struct(F.col("id").isNull().alias("no"), "id", F.col("simhash_row").alias("row")))
    prints = materialize(tagged.groupBy("simhash_bits").agg(least.alias("least")), "distinct-fingerprints")
    linked = components(fingerprint_links(prints, most=most))
    classes = prints.join(linked, F.col("simhash_bits") == F.col("node"), "left").select(
        "simhash_bits", F.coalesce("component", "simhash_bits").alias("component"), "least"
    )
    first = classes.groupBy("component").agg(F.min("least").alias("first"))
    named = classes.join(first, "component").select("simhash_bits", "first")
    return tagged.join(named, "simhash_bits").select(
        *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)],
        F.lower(F.lpad(F.hex("simhash_bits"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"),
        (F.col("first.row") == F.col("simhash_row")).alias("stays"),
    )
