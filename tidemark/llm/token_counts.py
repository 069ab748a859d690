"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton lists the vocabulary pieces that end at each
character; dynamic programming carries the best score and the number of pieces
of the best segmentation, no ids and no way back. Ties go as in the tokenizer:
of the pieces that end at a place and score the same, the one that starts first
wins, and an unknown character only where nothing scores as well. No piece
reaches from a word into the space after it, so a text's count is the sum over
its words, and each distinct word is counted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import texts as X

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a SentencePiece file and their scores, read as a unigram vocabulary."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    skip = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not skip(i)]


class Counter:
    """Best score and number of pieces of texts; unknown characters fall back to their bytes or fuse to one unknown."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True, cache_words: int = 400_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback, self.cache_words = byte_fallback, cache_words
        #: Words may be counted one by one only if no piece crosses from a word into a space.
        inner = lambda p: any(a != SPACE and b == SPACE for a, b in zip(p, p[1:], strict=False))
        self.by_words = byte_fallback and not any(inner(p) for p, _ in pieces)
        self.known: dict[bytes, tuple[float, int]] = {}

    def best(self, text: str) -> tuple[float, int]:
        n = len(text)
        score, count, fused = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        found = self.automaton.iter(text)
        end, match = next(found, (n, None))
        for i in range(n):
            top, pieces, single, lost = None, 0, False, False
            # pieces that end here, the longest first
            while end == i:
                length, own = match
                value = own + score[i + 1 - length]
                if top is None or value > top:
                    top, pieces = value, count[i + 1 - length] + 1
                single = single or length == 1
                end, match = next(found, (n, None))
            if not single:
                value = self.unknown + score[i]
                if top is None or value > top:
                    top, lost = value, True
                    pieces = count[i] + (len(text[i].encode("utf-8", "replace")) if self.byte_fallback else not fused[i])
            score[i + 1], count[i + 1], fused[i + 1] = top, pieces, lost
        return score[n], count[n]

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores and counts of the rows of a column."""
        data, offsets = X.buffers(column)
        filled = offsets[:-1] < offsets[1:]
        begin = offsets[:-1] + np.cumsum(filled) - filled
        data = np.insert(data, offsets[:-1][filled], 0x20)
        cut = np.zeros(len(data), bool)
        if self.by_words and len(data):
            space = data == 0x20
            cut[1:] = space[1:] & ~space[:-1]
            mark = np.frombuffer(SPACE.encode(), np.uint8)
            after = np.flatnonzero((data[:-3] == mark[0]) & (data[1:-2] == mark[1]) & (data[2:-1] == mark[2])) + 3
            cut[after] = False
        cut[begin[filled]] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        words = words.dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) + len(distinct) > self.cache_words:
            self.known = {}
        for w in distinct:
            if w not in self.known:
                self.known[w] = self.best(w.decode("utf-8", "replace").replace(" ", SPACE))
        each = np.array([self.known[w] for w in distinct], np.float64).reshape(-1, 2)[np.asarray(words.indices)]
        total = np.concatenate([np.zeros((1, 2)), np.cumsum(each, axis=0)])
        # rows in order: the words before each row's begin
        first = np.searchsorted(starts, np.append(begin, len(data)))
        sums = total[first[1:]] - total[first[:-1]]
        sums[~filled] = 0
        return sums[:, 0], sums[:, 1].astype(np.int64)


def token_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, score: pieces of the best segmentation of each row's whole text.

    Spaces count as the vocabulary's space mark and one is put before each text.
    A null or empty text has no tokens. Rows are counted one by one, repeated or
    not; other columns are ignored.
    """
    schema = T.StructType(
        [T.StructField("doc", docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for part in X.slices(batches, "text"):
            counter = counter or Counter(vocabulary(model))
            scores, counts = counter.column(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(counts), pa.array(scores)], schema.names)

    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    return chosen.mapInArrow(run, schema).withColumnRenamed("doc", doc_id)
