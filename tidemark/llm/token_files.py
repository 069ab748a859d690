"""Packed token ids as binary matrices, by best-fit-decreasing with a segment tree over free space.

Each task takes documents in blocks of a bounded number of tokens. Documents
longer than a sequence are cut into full ones and a rest, without loss. The
parts of a block are placed from the longest to the shortest into the sequence
with the least free space that is enough; a segment tree over the amounts of
free space finds it in logarithmic time.

A written row is a shard: a matrix of ids (rows of the same width, little
endian), the cumulative lengths of the segments of each row, the positions at
which position ids start again from 0, and which part of which document a
segment is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import texts as X
from tidemark.llm.tokens import WordEncoder


class FreeSpace:
    """How many sequences have which free space; finds the least that is enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.of: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, space: int, by: int) -> None:
        at = space + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, space: int, sequence: int) -> None:
        self.of[space].append(sequence)
        self._change(space, 1)

    def take(self, space: int) -> int:
        self._change(space, -1)
        return self.of[space].pop()

    def least(self, wanted: int) -> int | None:
        """The least free space of at least so much, if any."""
        at = wanted + self.size
        if self.count[at]:
            return wanted
        while at > 1:
            # up, until a sibling to the right has some
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Which parts, by number, each sequence holds."""
    free, sequences = FreeSpace(capacity), []
    for part in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        space = free.least(lengths[part])
        if space is None:
            space, number = capacity, len(sequences)
            sequences.append([])
        else:
            number = free.take(space)
        sequences[number].append(part)
        free.add(space - lengths[part], number)
    return sequences


def _schema(id_type: T.DataType) -> T.StructType:
    segment = T.StructType([T.StructField("doc", id_type), T.StructField("start", T.LongType()), T.StructField("doc_tokens", T.LongType())])
    return T.StructType(
        [
            T.StructField("shard", T.LongType()),
            T.StructField("n_sequences", T.IntegerType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("id_bytes", T.IntegerType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("cu_seqlens", T.ArrayType(T.ArrayType(T.IntegerType()))),
            T.StructField("position_resets", T.ArrayType(T.ArrayType(T.IntegerType()))),
            T.StructField("segments", T.ArrayType(T.ArrayType(segment))),
        ]
    )


def shards(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 2,
    pad_id: int = 0,
    width: int = 4096,
    id_bytes: int = 2,
    block_tokens: int = 2_000_000,
    rows_per_shard: int = 64,  # 1024 at most: the row's number takes 10 bits
) -> DataFrame:
    """The shards of a table, to be written with any Spark writer of binary columns.

    Every row is a document, also with a null or repeated id; a null or empty
    text is its end id alone. An empty table has no shards. An id that does not
    fit into ``id_bytes`` is an error.
    """
    schema = _schema(docs.schema[doc_id].dataType)
    kind = np.dtype(f"<u{id_bytes}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        encoder, number = None, 0
        prefix = TaskContext.get().partitionId() << 32
        parts: list[tuple] = []
        held = 0

        def write() -> Iterator[pa.RecordBatch]:
            nonlocal number
            placed = best_fit_decreasing([len(p[2]) for p in parts], width)
            for low in range(0, len(placed), rows_per_shard):
                rows = placed[low : low + rows_per_shard]
                matrix = np.full((len(rows), width), pad_id, kind)
                lengths, segments = [], []
                for r, members in enumerate(rows):
                    at = [0]
                    for m in members:
                        matrix[r, at[-1] : at[-1] + len(parts[m][2])] = parts[m][2]
                        at.append(at[-1] + len(parts[m][2]))
                    lengths.append(at)
                    segments.append([{"doc": parts[m][0], "start": parts[m][1], "doc_tokens": parts[m][3]} for m in members])
                values = [prefix | number, len(rows), width, id_bytes, matrix.tobytes(), lengths, [c[:-1] for c in lengths], segments]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        for part in X.slices(batches, "text", 1 << 22):
            encoder = encoder or WordEncoder(tokenizer)
            ids, bounds = encoder.encode(part.column("text"))
            if len(ids) and int(ids.max()) >> (8 * id_bytes):
                raise ValueError(f"token ids need more than {id_bytes} bytes")
            for doc, low, high in zip(part.column("doc").to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                own = np.append(ids[low:high], np.uint32(end_id)).astype(kind)
                parts += [(doc, s, own[s : s + width], len(own)) for s in range(0, len(own), width)]
                held += len(own)
                if held >= block_tokens:
                    yield from write()
                    parts, held = [], 0
        yield from write()

    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    return chosen.mapInArrow(run, schema)


def read_segments(written: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per segment of written shards, with the checksum of its ids as 32-bit little-endian numbers."""
    segment = written.schema["segments"].dataType.elementType.elementType
    schema = T.StructType(
        [T.StructField("doc", segment["doc"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                matrix = np.frombuffer(shard["ids"], f"<u{shard['id_bytes']}").reshape(shard["n_sequences"], shard["width"])
                out = []
                for r, (ends, resets, members) in enumerate(
                    zip(shard["cu_seqlens"], shard["position_resets"], shard["segments"], strict=True)
                ):
                    for low, high, m in zip(resets, ends[1:], members, strict=True):
                        crc = zlib.crc32(matrix[r, low:high].astype("<u4").tobytes())
                        out.append((m["doc"], m["start"], high - low, crc, m["doc_tokens"], shard["shard"] << 10 | r, low))
                columns = list(zip(*out, strict=True)) or [()] * len(schema)
                kinds = [batch.schema.field("segments").type.value_type.value_type.field("doc").type, *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)

    return written.mapInArrow(run, schema).withColumnRenamed("doc", doc_id)
