"""Bounded-space online packing of token sequences into windows of a fixed size.

Each task tokenizes its documents and keeps a fixed number of open windows. A
document goes into the window that it fits best; if none has room and no more
may be opened, the fullest is topped up with the head of the document and
emitted, and the rest is placed again. So emitted windows are full. When its
rows end, a task pours its open windows together, so that at most one is left.
Leftovers of all tasks are merged in rounds of groups of a bounded number of
windows; what is left at the very end is cut into sequences whose lengths are
powers of two, which need no padding.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import texts as X
from tidemark.llm.tokens import WordEncoder
from tidemark.session import materialize

_LOCAL, _GROUP = 31, 24


class Packer:
    """Open windows of one task. A piece is (document, start, ids, tokens of its document)."""

    def __init__(self, capacity: int, windows: int, prefix: int):
        self.capacity, self.windows, self.prefix = capacity, windows, prefix
        self.open: list[list] = []
        self.free: list[int] = []
        self.sequences = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list, is_open: bool = False) -> None:
        number, at = self.prefix << _LOCAL | self.sequences, 0
        self.sequences += 1
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, number, at, raw if is_open else None))
            at += len(ids)

    def put(self, slot: int, piece: tuple) -> None:
        self.open[slot].append(piece)
        self.free[slot] -= len(piece[2])
        if not self.free[slot]:
            self.emit(self.open.pop(slot))
            self.free.pop(slot)

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.capacity:
            self.emit([(doc, start, ids[: self.capacity], total)])
            start, ids = start + self.capacity, ids[self.capacity :]
        while len(ids):
            fits = [(f, i) for i, f in enumerate(self.free) if f >= len(ids)]
            if fits:
                self.put(min(fits)[1], (doc, start, ids, total))
                return
            if len(self.open) < self.windows:
                self.open.append([])
                self.free.append(self.capacity)
                self.put(len(self.open) - 1, (doc, start, ids, total))
                return
            least = min(self.free)
            self.put(self.free.index(least), (doc, start, ids[:least], total))
            start, ids = start + least, ids[least:]

    def pour(self) -> None:
        """Fill the fullest windows from the emptiest ones until at most one is left."""
        while len(self.open) > 1:
            source = self.open.pop(most := self.free.index(max(self.free)))
            self.free.pop(most)
            for doc, start, ids, total in source:
                while len(ids):
                    if not self.open:
                        self.open.append([])
                        self.free.append(self.capacity)
                    slot = self.free.index(min(self.free))
                    n = min(self.free[slot], len(ids))
                    self.put(slot, (doc, start, ids[:n], total))
                    start, ids = start + n, ids[n:]

    def close(self, last: bool) -> None:
        self.pour()
        for pieces in self.open:
            if not last:
                self.emit(pieces, is_open=True)
                continue
            left = sum(len(p[2]) for p in pieces)
            sizes = [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]
            for size in sizes:
                part, room = [], size
                while room:
                    doc, start, ids, total = pieces[0]
                    n = min(room, len(ids))
                    part.append((doc, start, ids[:n], total))
                    room -= n
                    pieces[0] = (doc, start + n, ids[n:], total)
                    if n == len(ids):
                        pieces.pop(0)
                self.emit(part)
        self.open, self.free = [], []

    def take(self, kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 8
        self.rows = []
        kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 2,
    capacity: int = 4096,
    windows: int = 16,
    fan_in: int = 64,
) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in which sequence.

    Every document, also a null or an empty text, ends with ``end_id``; each id
    lies in exactly one piece. Rows with null or repeated ids are documents of
    their own. ``sequence_id`` is unique, not dense. An empty table gives no rows.
    Memory of a task: a slice of texts, ``windows`` windows, in merges
    ``fan_in`` leftovers; none grows with the table.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType(
        [T.StructField("doc", id_type)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("ids", T.BinaryType())]
    )

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = WordEncoder(tokenizer)
        packer = Packer(capacity, windows, TaskContext.get().partitionId())
        kind = None
        for part in X.slices(batches, "text", 1 << 22):
            ids, bounds = encoder.encode(part.column("text"))
            kind = part.schema.field("doc").type
            for doc, low, high in zip(part.column("doc").to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                packer.add(doc, 0, np.append(ids[low:high], np.uint32(end_id)), high - low + 1)
            yield packer.take(kind)
        if kind is not None:
            packer.close(last=False)
            yield packer.take(kind)

    def merged(level: int, last: bool):
        def run(key, table):
            packer = Packer(capacity, windows, level << _GROUP | key[0].as_py())
            table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            rows = zip(*(table.column(c).to_pylist() for c in ("doc", "start", "ids", "doc_tokens")), strict=True)
            for doc, start, raw, total in rows:
                packer.add(doc, start, np.frombuffer(raw, "<u4"), total)
            packer.close(last)
            return pa.Table.from_batches([packer.take(table.schema.field("doc").type)])

        return run

    made = materialize(docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(first_pass, schema), "packed")
    done = [made.filter("ids is null")]
    left = made.filter("ids is not null")
    group = F.shiftright("sequence_id", _LOCAL).bitwiseAND(F.lit((1 << _GROUP) - 1))
    most = left.agg(F.max(group)).first()[0]
    level, last = 0, most is None
    while not last:
        level, last = level + 1, most < fan_in
        merge = left.withColumn("group", F.floor(group / fan_in)).groupBy("group").applyInArrow(merged(level, last), schema)
        made = materialize(merge, "merged-windows")
        done.append(made.filter("ids is null"))
        left, most = made.filter("ids is not null"), math.floor(most / fan_in)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("doc").alias(doc_id), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
