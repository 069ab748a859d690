"""Licence scans: a classifier of word windows over n-grams, confirmed by comparison with templates.

A multinomial logistic regression over hashed word 1-, 2- and 3-grams tells
licence families from other words. It is trained on variations of the templates
and on windows of the documents' paragraphs. On held-out rows a temperature and
the least probability at which a family may be named are calibrated; what looks
like a licence but stays under it, or has too few of the word pairs of its
family's templates, is ``unknown``. Every window of some sizes of every line is
scored, and those that run on into the next line, so neither a long line nor a
line break hides a notice. A place with nearly all word pairs of a template is
one of its family whatever the classifier says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import texts as X

# How each family is usually named in a notice.
TEMPLATES = {
    "mit": ("Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "apache": ("Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License, Version 2.0", "Apache Software License 2.0"),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL version 2 or later.", "This program is free software: you can redistribute it under the terms of the GNU General Public License"),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the MPL 2.0."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright under CC0."),
    "proprietary": ("All rights reserved.", "No part of this publication may be reproduced without prior written permission of the publisher."),
}
#: The sentences of the families' full texts.
FULL_TEXTS = {
    "mit": (
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise",
    ),
    "apache": (
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties are disclaimed.",
    ),
    "gpl": (
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version of the GNU General Public License.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "mpl": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
}
#: Notices of no family above, to learn what a licence looks like; they make up the unknown class.
OTHER_NOTICES = (
    "Licensed under the terms agreed with the owner.",
    "This work is licensed under its own license, version 7.",
    "Released under a custom license, see the file.",
    "You may redistribute this work under the terms of the license.",
)
#: Sentences that share words with notices and are none.
NO_NOTICES = (
    "The license of the driver was taken away after the accident.",
    "She lost her license plate on the way under the bridge.",
    "The rights of all citizens are reserved for later sessions of the court.",
    "The committee granted permission to use the hall, free of charge.",
    "Copies of the software were distributed to the public library.",
)
OTHER, UNKNOWN = "other", "unknown"
CLASSES = (OTHER, UNKNOWN, *TEMPLATES)
#: Words in a window. Lines of fewer words are windows of their own.
SIZES = (4, 8, 16, 32, 64)
#: Weights are multiples of 1/ONE, so sums over windows are exact in any order.
ONE = 1 << 20


@dataclass(frozen=True)
class Model:
    """Weights in 1/ONE by hashed n-gram and class; calibrated temperature and least probability; word pairs of the templates."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    pairs: dict
    accuracy: float


@dataclass(frozen=True)
class Words:
    """For each word of a column: row, line in its row, end of its line and of its run of lines, n-gram buckets, pair hash."""

    row: np.ndarray
    line: np.ndarray
    line_end: np.ndarray
    block_end: np.ndarray
    slots: list
    pairs: np.ndarray


def _run_ends(new: np.ndarray) -> np.ndarray:
    head = np.append(np.flatnonzero(new), len(new))
    return np.repeat(head[1:], np.diff(head))


def words_of(column: pa.Array, buckets: int) -> Words:
    """The words of all rows. A line without words ends a run of lines; n-grams lie within one run.

    An n-gram that repeats one of the four before it counts nothing, lest a word
    said over and over adds up to a notice.
    """
    data, offsets = X.buffers(column)
    data = X.LOWER[data]
    starts, ends, first = X.word_spans(data, offsets, X.LETTER_OR_DIGIT)
    breaks = np.flatnonzero(data == 0x0A)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    line = np.searchsorted(breaks, starts)
    new_line, new_block = np.ones(len(starts), bool), np.ones(len(starts), bool)
    new_line[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    new_block[1:] = (line[1:] > line[:-1] + 1) | (row[1:] != row[:-1])
    block_end = _run_ends(new_block)
    hashes = X.span_hashes(data, starts, ends)
    slots = []
    for n in (1, 2, 3):
        h = X.gram_hashes(hashes, n)
        slot = np.full(len(hashes), buckets)
        slot[: len(h)] = (h & np.uint64(buckets - 1)).astype(np.int64)
        slot[np.arange(len(hashes)) + n > block_end] = buckets
        again = np.zeros(len(slot), bool)
        for gap in (1, 2, 3, 4):
            again[gap:] |= slot[gap:] == slot[:-gap]
        slot[again] = buckets
        slots.append(slot)
    pairs = np.zeros(len(hashes), np.uint64)
    pairs[:-1] = X.gram_hashes(hashes, 2)
    pairs[np.arange(len(hashes)) + 2 > block_end] = 0
    number = line - np.searchsorted(breaks, offsets[:-1])[row]
    return Words(row, number, _run_ends(new_line), block_end, slots, pairs)


def _scores(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Class scores of each training row: summed weights of its n-grams."""
    out = np.repeat(bias[None], n, axis=0)
    if len(owners):
        head = np.flatnonzero(np.diff(owners, prepend=-1))
        out[owners[head]] += np.add.reduceat(weights[slots], head, axis=0)
    return out


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _variations(others: list[str], each: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Windows of other paragraphs; notices with words dropped, doubled, recased or surrounded by such words; their classes."""
    rng = np.random.default_rng(seed)
    texts = list(NO_NOTICES) * 4
    for words in (t.split() for t in others):
        for size in {min(len(words), int(rng.choice(sizes))) for sizes in (SIZES[:3], SIZES[3:])}:
            begin = int(rng.integers(len(words) - size + 1))
            texts.append(" ".join(words[begin : begin + size]))
    classes = [0] * len(texts)
    pool = [w for t in others[:500] for w in t.split()[:40]] or ["text"]
    some = lambda n: [pool[j] for j in rng.integers(len(pool), size=rng.integers(n))]
    for family, notices in [(UNKNOWN, OTHER_NOTICES), *TEMPLATES.items()]:
        templates = (*notices, *FULL_TEXTS.get(family, ()))
        for i in range(max(each, 24 * len(templates))):
            words = templates[i % len(templates)].split()
            if i >= len(templates):
                words = [w for w in words if len(words) < 5 or rng.random() > 0.06]
                if rng.random() < 0.3:
                    # in the middle of a long paragraph, as a window of it
                    words, size = some(40) + words + some(40), max(8, 2 * len(words))
                    begin = int(rng.integers(max(1, len(words) - size + 1)))
                    whole = " ".join(words[begin : begin + size])
                    if not any(_covered(whole, t) >= 0.8 for t in templates):
                        continue
                    words = whole.split()
                elif rng.random() < 0.5:
                    words = some(8) + words + some(8)
                words = [w.upper() for w in words] if rng.random() < 0.1 else words
            texts.append(" ".join(words))
            classes.append(CLASSES.index(family))
    return texts, np.array(classes)


def _covered(text: str, template: str) -> float:
    mine, wanted = set(_pairs(text).tolist()), set(_pairs(template).tolist())
    return len(mine & wanted) / max(len(wanted), 1)


def train(others: list[str], buckets: int = 1 << 15, each: int = 120, rounds: int = 300, seed: int = 7) -> Model:
    """Fit on three quarters of the rows and calibrate on the rest. ``others``: paragraphs that are no licence."""
    texts, classes = _variations(others, each, seed)
    words = words_of(pa.array([t.replace("\n", " ") for t in texts]), buckets)
    n = len(texts)
    held = np.arange(n) % 4 == 3
    pair = np.sort(np.concatenate([words.row[s < buckets] * buckets + s[s < buckets] for s in words.slots]))
    owners, slots = owner, slot = pair // buckets, pair % buckets
    used, slot = np.unique(slot, return_inverse=True)
    fit = ~held[owner]
    order = np.argsort(slot[fit], kind="stable")
    f_owner, f_slot = owner[fit], slot[fit]
    by_slot, by_owner = np.flatnonzero(np.diff(f_slot[order], prepend=-1)), np.flatnonzero(np.diff(f_owner, prepend=-1))
    target = np.eye(len(CLASSES))[classes]
    weights, bias = np.zeros((len(used), len(CLASSES))), np.zeros(len(CLASSES))
    squares, bias_squares = np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(rounds):
        scores = np.repeat(bias[None], n, axis=0)
        scores[f_owner[by_owner]] += np.add.reduceat(weights[f_slot], by_owner, axis=0)
        error = np.where(held[:, None], 0, _softmax(scores) - target) / (~held).sum()
        grad = 1e-4 * weights
        grad[f_slot[order][by_slot]] += np.add.reduceat(error[f_owner[order]], by_slot, axis=0)
        squares, bias_squares = squares + grad**2, bias_squares + error.sum(axis=0) ** 2
        weights, bias = weights - 0.3 * grad / np.sqrt(squares), bias - 0.3 * error.sum(axis=0) / np.sqrt(bias_squares)
    table = np.zeros((buckets + 1, len(CLASSES)), np.int64)
    table[used] = np.where(np.abs(weights) > 1e-3, np.round(weights * ONE), 0)
    bias = np.round(bias * ONE).astype(np.int64)
    scores = (_scores(table, bias, slots, owners, n) / ONE)[held]
    truth = classes[held]
    loss = lambda t: -np.log(_softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=loss)
    p = _softmax(scores / temperature)
    named, best = p.argmax(axis=1), p.max(axis=1)
    # the least probability over which 99 in 100 families of held-out rows are right
    is_family = named >= 2
    grid = [x for x in np.arange(0.5, 1.0, 0.01) if not (is_family & (best >= x)).any() or (named == truth)[is_family & (best >= x)].mean() >= 0.99]
    pairs = {f: [np.unique(_pairs(t)) for t in (*ts, *FULL_TEXTS.get(f, ()))] for f, ts in TEMPLATES.items()}
    return Model(table, bias, temperature, float(grid[0]) if grid else 0.99, pairs, float((named == truth).mean()))


def _pairs(text: str) -> np.ndarray:
    pairs = words_of(pa.array([text.replace("\n", " ")]), 1).pairs
    return pairs[pairs > 0]


def _windows(model: Model, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every window in which the classifier can prefer a licence class.

    The bound adds up, over the n-grams, the most that any class has over ``other``.
    """
    lift = model.weights[:, 1:].max(axis=1) - model.weights[:, 0]
    need = -int((model.bias[1:] - model.bias[0]).max())
    sums = [np.concatenate([[0], np.cumsum(lift[s])]) for s in words.slots]
    at = np.arange(len(words.row))
    begins, ends = [], []
    for limit in (words.line_end, words.block_end):
        for j, size in enumerate(SIZES):
            end = np.minimum(at + size, limit)
            new = np.ones(len(at), bool) if j == 0 else at + SIZES[j - 1] < limit
            if limit is words.block_end:
                new &= end > words.line_end
            i, e = at[new], end[new]
            total = sum(c[np.maximum(e - n, i)] - c[i] for n, c in enumerate(sums))
            good = total > need
            begins.append(i[good])
            ends.append(e[good])
    return np.concatenate(begins), np.concatenate(ends)


def _window_scores(model: Model, words: Words, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Exact class scores of windows, by running sums over the words that any of them has."""
    cover = np.zeros(len(words.row) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, end, -1)
    used = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    b, e = np.searchsorted(used, begin), np.searchsorted(used, end)
    out = np.repeat(model.bias[None], len(begin), axis=0)
    for n, slots in enumerate(words.slots):
        running = np.concatenate([np.zeros((1, len(CLASSES)), np.int64), np.cumsum(model.weights[slots[used]], axis=0)])
        out += running[np.maximum(e - n, b)] - running[b]
    return out / (ONE * model.temperature)


class _Cover:
    """Shares of the templates' word pairs in spans of words."""

    def __init__(self, model: Model, words: Words):
        self.templates = [(CLASSES.index(f), t) for f, ts in model.pairs.items() for t in ts]
        known = np.unique(np.concatenate([t for _, t in self.templates]))
        slot = np.minimum(np.searchsorted(known, words.pairs), len(known) - 1)
        self.at = np.flatnonzero(known[slot] == words.pairs)
        self.pair = slot[self.at]
        self.wanted = [np.searchsorted(known, t) for _, t in self.templates]
        self.words = words

    def of(self, family: int, begin: int, end: int) -> float:
        """Covered share of the family's closest template, with as many words around the span as it has pairs."""
        best, low, high = 0.0, *self._limits(begin, end)
        for (f, _), wanted in zip(self.templates, self.wanted, strict=True):
            if f == family:
                a, b = np.searchsorted(self.at, (max(low, begin - len(wanted)), min(high, end + len(wanted)) - 1))
                best = max(best, len(np.intersect1d(self.pair[a:b], wanted)) / len(wanted))
        return best

    def _limits(self, begin: int, end: int) -> tuple[int, int]:
        limit = self.words.line_end if end <= self.words.line_end[begin] else self.words.block_end
        return int(np.searchsorted(limit, limit[begin])), int(limit[begin])

    def verbatim(self, share: float) -> list[tuple[int, int, int, float]]:
        """Family, begin, end and covered share of the places with so much of a template."""
        out = []
        for (family, _), wanted in zip(self.templates, self.wanted, strict=True):
            at, pair = (x[np.isin(self.pair, wanted)] for x in (self.at, self.pair))
            need = int(np.ceil(share * len(wanted)))
            head = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < 1.5 * len(wanted) + 2) if len(at) >= need else ()
            for j in head:
                end = min(int(at[j]) + int(1.5 * len(wanted)) + 2, int(self.words.block_end[at[j]]))
                mine = slice(j, int(np.searchsorted(at, end - 1)))
                covered = len(np.unique(pair[mine])) / len(wanted)
                if covered >= share:
                    out.append((family, int(at[j]), int(at[mine][-1]) + 2, covered))
        return out


def judge(model: Model, column: pa.Array, confirm: float = 0.5, verbatim: float = 0.9) -> list[tuple[int, int, str, float, float]]:
    """row, paragraph, family or unknown, probability, covered share of the closest template.

    One for each line with a notice, and for each notice that only several lines
    together make, at the line where it begins.
    """
    words = words_of(column, len(model.weights) - 1)
    if not len(words.row):
        return []
    begin, end = _windows(model, words)
    cover = _Cover(model, words)
    copies = cover.verbatim(verbatim)
    n = len(begin)
    begin = np.append(begin, np.array([c[1] for c in copies], np.int64))
    end = np.append(end, np.array([c[2] for c in copies], np.int64))
    if not len(begin):
        return []
    p = _softmax(_window_scores(model, words, begin, end))
    best = p.argmax(axis=1)
    head = np.searchsorted(words.line_end, words.line_end[begin])
    crossing = end > words.line_end[begin]
    # by place: the best window of each class, surest first
    order = np.lexsort((end, begin, -p[np.arange(len(p)), best], best))
    places: dict[int, dict] = {}
    wrapped = []
    for i in order.tolist():
        if i >= n or not best[i]:
            continue
        if crossing[i]:
            wrapped.append(i)
        else:
            places.setdefault(int(head[i]), {}).setdefault(int(best[i]), i)

    def ruled(options: dict, exact: list[int]) -> tuple[bool, int, float, float, int]:
        """Sure, class, probability, covered share and window of one place."""
        if exact:
            i = max(exact, key=lambda i: (copies[i - n][3], p[i, copies[i - n][0]], -i))
            return True, copies[i - n][0], float(p[i, copies[i - n][0]]), copies[i - n][3], i
        found = []
        for c, i in options.items():
            covered = cover.of(c, int(begin[i]), int(end[i])) if c > 1 else 0.0
            found.append((c > 1 and p[i, c] >= model.least and covered >= confirm, float(p[i, c]), covered, -c, i))
        sure, mine, covered, c, i = max(found)
        return sure, -c if sure else 1, mine, covered, i

    exact: dict[int, list[int]] = {}
    spread = []
    for i in range(n, len(begin)):
        (spread.append(i) if crossing[i] else exact.setdefault(int(head[i]), []).append(i))
    lines = {h: ruled(places.get(h, {}), exact.get(h, [])) for h in {*places, *exact}}
    out: dict[int, tuple] = {}
    taken = np.zeros(len(words.row), bool)

    def settle(sure: bool) -> None:
        for h, r in lines.items():
            if r[0] >= sure and not taken[h]:
                out[h] = r
                taken[h : words.line_end[h]] = True

    def clusters(windows: list[int]) -> list[list[int]]:
        """Overlapping windows that lie in no line taken so far."""
        groups, reach = [], -1
        for i in sorted(windows, key=lambda i: (begin[i], end[i])):
            if taken[begin[i] : end[i]].any():
                continue
            if begin[i] >= reach:
                groups.append([])
            groups[-1].append(i)
            reach = max(reach, int(end[i]))
        return groups

    def add(group: list[int], only_sure: bool) -> None:
        options: dict[int, int] = {}
        for i in sorted((i for i in group if i < n), key=lambda i: (-p[i, best[i]], begin[i], end[i])):
            options.setdefault(int(best[i]), i)
        r = ruled(options, [i for i in group if i >= n])
        if r[0] or not only_sure:
            i = r[4]
            hits = cover.at[slice(*np.searchsorted(cover.at, (begin[i], end[i])))]
            first = int(hits[0]) if len(hits) else int(begin[i] + end[i]) // 2
            out[int(np.searchsorted(words.line_end, words.line_end[first]))] = r
            taken[begin[i] : end[i]] = True
            for j in range(int(begin[i]), int(end[i])):
                taken[int(np.searchsorted(words.line_end, words.line_end[j])) : words.line_end[j]] = True

    # whole notices first, then what part of one makes sure, then what is unknown; lines before what crosses them
    for h in exact:
        out[h] = lines[h]
        taken[h : words.line_end[h]] = True
    for i in sorted(spread, key=lambda i: (-copies[i - n][3], begin[i], end[i])):
        if not taken[begin[i] : end[i]].any():
            add([i], only_sure=True)
    settle(sure=True)
    for group in clusters(wrapped):
        add(group, only_sure=True)
    settle(sure=False)
    for group in clusters(wrapped):
        add(group, only_sure=False)
    return [(int(words.row[h]), int(words.line[h]), CLASSES[c], mine, covered) for h, (_, c, mine, covered, _) in sorted(out.items())]


def sample_paragraphs(docs: DataFrame, text: str, most: int) -> list[str]:
    """At most so many different paragraphs without the words of a notice, the same for the same table."""
    lines = docs.select(F.explode(F.split(F.col(f"`{text}`").cast("string"), "\n")).alias("line"))
    lines = lines.select(F.substring("line", 1, 2000).alias("line"))
    lines = lines.filter(~F.lower("line").rlike(r"licen[sc]|copyright|rights reserved|\bgnu\b|\bcc0?\b|public domain"))
    lines = lines.filter(F.length("line") >= 5).groupBy(F.xxhash64("line").alias("h")).agg(F.min("line").alias("line"))
    return [r["line"] for r in lines.orderBy("h", "line").limit(most).collect()]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_samples: int = 2000) -> DataFrame:
    """doc_id, paragraph, family, probability, covered: every paragraph that reads like a licence notice.

    Paragraphs are lines, numbered from 0; a notice wrapped over several lines is
    one row at its first line. ``most_samples`` bounds the paragraphs
    that the classifier learns from; all paragraphs of all texts are scanned. Null
    and empty texts have none. Rows are scanned one by one, repeated or not.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(sample_paragraphs(docs, text, most_samples)))
    schema = T.StructType(
        [
            T.StructField("doc", docs.schema[doc_id].dataType),
            T.StructField("paragraph", T.IntegerType()),
            T.StructField("family", T.StringType()),
            T.StructField("probability", T.DoubleType()),
            T.StructField("covered", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.slices(batches, "text"):
            found = judge(model.value, part.column("text"))
            rows, numbers, families, p, covered = zip(*found, strict=True) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc").take(pa.array(rows, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    pa.array(families, pa.string()),
                    pa.array(p, pa.float64()),
                    pa.array(covered, pa.float64()),
                ],
                schema.names,
            )

    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    return chosen.mapInArrow(run, schema).withColumnRenamed("doc", doc_id)
