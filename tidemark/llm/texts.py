"""Vectorised work on the bytes of many texts at once, inside tasks.

A column of strings arrives as one byte buffer with offsets. All word classes
used here separate words by ASCII bytes only, so words can be found on the
bytes, without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256)
#: Lower case of A-Z; all other bytes stay.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
LETTER_OR_DIGIT = (
    (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings and where each row begins; a null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about so many bytes of text, at least a row each."""
    for batch in batches:
        _, offsets = buffers(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + max_bytes, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end in the bytes, and the number of words before each row."""
    mask = inside[data]
    before, after = np.zeros_like(mask), np.zeros_like(mask)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers = {b: np.ones(1, np.uint64) for b in (_BASE, _INVERSE)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 21), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: differences of a running polynomial."""
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_OF_BYTE[data] * _power(_BASE, len(data)), out=running[1:], dtype=np.uint64)
    own = (running[ends] - running[starts]) * _power(_INVERSE, len(data) + 1)[starts]
    return mix(own + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbouring words, never 0; row limits are the caller's."""
    n = max(0, len(words) - k + 1)
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = total * np.uint64(_BASE) + words[j : j + n]
    return np.maximum(mix(total), np.uint64(1))


def sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op (minimum or maximum) over each window of so many neighbours."""
    if len(values) < width:
        return values[:0]
    out, size = values, 1
    while 2 * size <= width:
        out, size = op(out[:-size], out[size:]), 2 * size
    rest = width - size
    return op(out[:-rest], out[rest:]) if rest else out


def row_ends(first: np.ndarray) -> np.ndarray:
    """For each word, the number of words up to the end of its row."""
    return np.repeat(first[1:], np.diff(first))


def winnow(grams: np.ndarray, k: int, width: int, ends: np.ndarray) -> np.ndarray:
    """Positions whose k-gram has the least hash of some window of so many k-grams within one row.

    Any k + width - 1 neighbouring words have such a position, and it is the
    same one wherever these words occur.
    """
    least = sliding(grams, width, np.minimum).copy()
    n = len(least)
    least[np.arange(n) + k + width - 1 > ends[:n]] = 0
    pad = np.zeros(width - 1, np.uint64)
    if not n:
        return np.zeros(0, np.int64)
    best = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    return np.flatnonzero(best == grams)
