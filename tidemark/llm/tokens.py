"""Token ids of whole texts by a tokenizer file, each distinct word encoded once.

The pre-tokenizer of the word-level file never lets a token reach over white
space, so the ids of a text are those of its words in order. Words repeat, so a
batch is split into distinct words; those not seen before are encoded together
in calls of the tokenizers library. Words of letters up to U+00FF are joined by
spaces where the tokenizer's tokens tell a word's end, all others by a mark.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa

from tidemark.llm import texts as X

MARK = "¶"
#: Bytes that begin a new part after a letter. No apostrophe: it begins contractions. No bar: it is in special tokens.
_BREAKS = np.isin(np.arange(256), np.frombuffer(b".,!?;:#$%&*", np.uint8))
#: Words of ASCII letters and of those from U+00C0 to U+00FF.
_LATIN = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+").fullmatch
_ASCII_LETTER = (np.arange(256) >= 0x61) & (np.arange(256) <= 0x7A)


def _parts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where words, and marks after a letter, start. Of letters beyond ASCII, those of U+00C0 to U+00FF are known."""
    begins = np.zeros(len(data), bool)
    begins[starts] = True
    letter = _ASCII_LETTER[data]
    second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter[1:] |= second
    begins[1:] |= _BREAKS[data[1:]] & letter[:-1]
    return np.flatnonzero(begins)


class WordEncoder:
    """Encodes columns of texts; keeps the ids of at most ``cache_words`` words between calls."""

    def __init__(self, path: str, cache_words: int = 1_000_000, per_call: int = 200):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words, self.per_call = cache_words, per_call
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        #: By id: whether a token ends a word. None where the tokens do not tell.
        self.ends = None
        if suffix and vocab:
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _run(self, rows: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> list[list[int]]:
        plain = [i for i, w in enumerate(words) if self.mark is not None and MARK not in w]
        out: list[list[int]] = [[]] * len(words)
        groups = [plain[i : i + self.per_call] for i in range(0, len(plain), self.per_call)]
        for group, ids in zip(groups, self._run([f" {MARK} ".join(words[i] for i in g) for g in groups]), strict=True):
            ids = np.array(ids, np.uint32)
            cuts = [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            if len(cuts) != len(group) + 1:
                raise ValueError("the mark between words is not a token of its own in this tokenizer")
            for i, low, high in zip(group, cuts, cuts[1:], strict=False):
                out[i] = ids[low + 1 : high]
        rest = sorted(set(range(len(words))) - set(plain))
        for i, ids in zip(rest, self._run([words[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _by_ends(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of words of letters, one after the other, and each word's number; None if ends do not tell."""
        groups = [b" ".join(words[i : i + self.per_call]).decode() for i in range(0, len(words), self.per_call)]
        rows = [np.array(ids, np.uint32) for ids in self._run(groups)]
        # each word is one run of letters, so it has one end: a group with another number of ends is not read by them
        counts = [int(np.count_nonzero(self.ends[r])) if len(r) and self.ends[r[-1]] else 0 for r in rows]
        if counts != [len(words[i : i + self.per_call]) for i in range(0, len(words), self.per_call)]:
            return None
        ids = np.concatenate(rows)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _learn(self, words: list[bytes]) -> None:
        if self.ends is not None:
            kinds = plain, latin, others = [], [], []
            for w in words:
                kinds[0 if w.isalpha() else 1 if _LATIN(w) else 2].append(w)
            words = others
            for letters in (plain, latin):
                if letters and (found := self._by_ends(letters)) is not None:
                    self._keep(letters, *found)
                else:
                    words = words + letters
        if not words:
            return
        encoded = self._encode([w.decode("utf-8", "replace") for w in words])
        self._keep(words, np.concatenate([np.asarray(e, np.uint32) for e in encoded]), np.fromiter(map(len, encoded), np.int64, len(encoded)))

    def _keep(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, n = len(self.known), len(self.known) + len(words)
        total = self.used + len(ids)
        if n > len(self.starts):
            self.starts, self.lengths = (np.resize(a, 2 * n) for a in (self.starts, self.lengths))
        if total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * total)
        self.starts[first:n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first:n] = lengths
        self.ids[self.used : total] = ids
        self.used = total
        self.known.update(zip(words, range(first, n), strict=True))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column, and where each row's begin."""
        data, offsets = X.buffers(column)
        if b"<|" not in data.tobytes():  # special tokens have their own case
            data = X.LOWER[data]
        starts, _, _ = X.word_spans(data, offsets, X.NOT_SPACE)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = _parts(data, starts)
        first = np.searchsorted(starts, offsets)
        inside = X.NOT_SPACE[data]
        before = np.cumsum(inside, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        bounds = np.append(before[starts] - 1, before[-1]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]
        ).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) + len(distinct) > self.cache_words:
            self._reset()
        slots = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new = [distinct[i] for i in missing.tolist()]
            self._learn(new)
            slots[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        slots = slots[np.asarray(words.indices)]
        lengths = self.lengths[slots]
        stops = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.starts[slots] - stops[:-1], lengths) + np.arange(stops[-1])]
        return ids, stops[first]
