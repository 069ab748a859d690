"""How far the sources of a language differ in their words, and by which.

Words are counted per (lang, source) and batch inside the task, then summed. A
word counts where at least ``least_docs`` documents of its language hold it.
Every group gives every such word a smoothed share, in whole billionths.

*The words that mark a group* are those whose share most exceeds the language's.
A share grows with the count, so a word is beaten by any other with a count in
the group that is as high, a count in the language that is as low, and an earlier
spelling, whatever the totals. Each task keeps the words that fewer than ``k``
others beat so (a skyband), tasks' skybands are merged, and only what is left is
valued and ranked.

*How far two sources lie apart* is summed word by word: the shares of a word in
all sources of its language meet in one row, tasks add up a strip of the matrix
of sources, and the strips of all tasks are summed.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import texts as X
from tidemark.session import materialize

SCALE = 1_000_000_000
SMOOTHING = 5
#: Words of groups, or rows of a skyband, that a task holds before it passes them on or thins them out.
MAX_COUNTS = 500_000
#: Sources in one strip of the matrix of a language.
STRIP = 256
#: Tasks that merge the skybands of one group.
MERGERS = 8

#: A-Z in lower case; bytes of no word become spaces.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def counted(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each word; a row without a term for every group."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, groups, held = defaultdict(Counter), defaultdict(Counter), set(), 0

        def flush() -> pa.RecordBatch:
            rows = [(*g, term, n, seen[g][term]) for g, c in counts.items() for term, n in c.items()]
            rows += [(*g, None, 0, 0) for g in groups]
            columns = list(zip(*rows, strict=True))
            terms = pa.array([None if t is None else t.decode("utf-8", "replace") for t in columns[2]], pa.string())
            counts.clear()
            seen.clear()
            groups.clear()
            fixed = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string())]
            return pa.RecordBatch.from_arrays(
                [*fixed, terms, pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], ["lang", "source", "term", "n", "docs"]
            )

        for batch in batches:
            for part in X.slices([batch], "text"):
                keys = zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)
                for g, body in zip(keys, part.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                    groups.add(g)
                    own, known = Counter(body.translate(_WORDS).split()), counts[g]
                    held -= len(known)
                    known.update(own)
                    held += len(known)
                    seen[g].update(own.keys())
                if held > MAX_COUNTS:
                    held = 0
                    yield flush()
        if groups:
            yield flush()

    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(value(lang).alias("lang"), value(source).alias("source"), value(text).alias("text"))
    found = rows.mapInArrow(scan, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exact; null without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = wide(total) + wide(terms) * SMOOTHING
    whole = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(n) + SMOOTHING), F.when(over > 0, over))
    return whole.cast("long") + 1


def skyband(rows: Iterable[tuple[int, int, bytes]], k: int) -> list[int]:
    """Indices of the rows (count, lang count, term) that fewer than k others beat.

    Taken by falling count, a row can only be beaten by rows before it, and by k
    of these if by k of those kept. A Fenwick tree over the language counts holds
    in each node the k earliest spellings among the rows kept there.
    """
    rows = list(rows)
    spelling = {t: i for i, t in enumerate(sorted({t for _, _, t in rows}))}
    place = {c: i + 1 for i, c in enumerate(sorted({c for _, c, _ in rows}))}
    tree: list[list[int]] = [[] for _ in range(len(place) + 1)]
    kept = []
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][0], rows[i][1], rows[i][2])):
        own, at = spelling[rows[i][2]], place[rows[i][1]]
        beaten, j = 0, at
        while j and beaten < k:
            beaten += bisect_left(tree[j], own)
            j &= j - 1
        if beaten >= k:
            continue
        kept.append(i)
        while at < len(tree):
            if len(tree[at]) < k or own < tree[at][-1]:
                insort(tree[at], own)
                del tree[at][k:]
            at += at & -at
    return kept


def skybands(terms: DataFrame, k: int) -> DataFrame:
    """The rows (lang, source, term, n, lang_n) of each task that fewer than k others of their group and task beat."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = defaultdict(list)
        limit: dict[tuple, int] = {}

        def cut(g: tuple) -> None:
            held[g] = [held[g][i] for i in skyband(held[g], k)]
            limit[g] = 2 * len(held[g]) + MAX_COUNTS

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "source", "n", "lang_n", "term")]
            for lang, source, n, lang_n, term in zip(*columns, strict=True):
                held[lang, source].append((n, lang_n, term.encode()))
            for g, rows in held.items():
                if len(rows) > limit.get(g, MAX_COUNTS):
                    cut(g)
        for g in list(held):
            cut(g)
            rows = held.pop(g)
            n, lang_n, term = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0]] * len(n)), pa.array([g[1]] * len(n)), pa.array([t.decode() for t in term]), pa.array(n, pa.int64()), pa.array(lang_n, pa.int64())],
                ["lang", "source", "term", "n", "lang_n"],
            )

    return terms.select("lang", "source", "term", "n", "lang_n").mapInArrow(scan, "lang string, source string, term string, n long, lang_n long")


def _apart(words: DataFrame) -> DataFrame:
    """lang, a, b, value: sums over the words of a task, for the sources numbered a of a strip and b of the language.

    ``words``: lang, strip, bases (the share of a word that is not there, by
    source number) and found (source number and share), null for a language's first row.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            found = batch.column("found")
            which, shares = (x.to_numpy(zero_copy_only=False) for x in found.flatten().flatten())
            lengths = np.cumsum([0, *pc.fill_null(pc.list_value_length(found), 0).to_pylist()])
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("strip").to_pylist(), strict=True))
            bases: dict[str, np.ndarray] = {}
            for r, (lang, strip) in enumerate(keys):
                if lang not in bases:
                    bases[lang] = np.array(batch.column("bases")[r].as_py(), np.int64)
                base = bases[lang]
                low, high = strip * STRIP, min((strip + 1) * STRIP, len(base))
                total = sums.setdefault((lang, strip), np.zeros((high - low, len(base)), np.int64))
                if lengths[r] == lengths[r + 1]:
                    continue
                row = base.copy()
                row[which[lengths[r] : lengths[r + 1]]] = shares[lengths[r] : lengths[r + 1]]
                total += np.abs(row[low:high, None] - row[None, :])
        for (lang, strip), total in sums.items():
            for i, line in enumerate(total):
                n = len(line)
                a = np.full(n, strip * STRIP + i, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array(a), pa.array(np.arange(n, dtype=np.int32)), pa.array(line)], ["lang", "a", "b", "value"]
                )

    return words.select("lang", "strip", "bases", "found").mapInArrow(scan, "lang string, a int, b int, value long")


def divergence(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 30, top: int = 50
) -> DataFrame:
    """lang, source, part, item, value, rank: for every group its distance to all other sources and its marking words.

    Null texts, languages and sources count as empty. Groups without a counted
    word appear with their distances, 0 if their language has none. Equal values
    rank by the items' bytes. Repeated rows count as often as they are there. An
    empty table gives an empty table.
    """
    counts = materialize(counted(docs, lang, source, text), "source-words")
    vocabulary = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    vocabulary = materialize(vocabulary.filter(F.col("docs") >= least_docs).drop("docs"), "language-words")
    terms = materialize(counts.filter("term IS NOT NULL").drop("docs").join(vocabulary, ["lang", "term"]), "kept-words")

    langs = vocabulary.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "lang_total", "terms"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = materialize(groups.select("*", number.alias("number")), "source-groups")

    marking = skybands(terms, top).withColumn("merger", F.pmod(F.xxhash64("term"), F.lit(MERGERS)))
    marking = skybands(marking.repartition("lang", "source", "merger"), top)
    marking = marking.join(groups, ["lang", "source"])
    above = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    marking = marking.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), above.alias("value")).filter("value > 0")

    absent = F.coalesce(share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0))
    of_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("number", "source", absent.alias("base")))).alias("all"))
    of_lang = materialize(of_lang.select("lang", F.col("all.base").alias("bases"), F.col("all.source").alias("names")), "language-sources")
    own = terms.join(groups.select("lang", "source", "number", "total", "terms"), ["lang", "source"])
    own = own.withColumn("share", share(F.col("n"), F.col("total"), F.col("terms")))
    words = own.groupBy("lang", "term").agg(F.collect_list(F.struct("number", "share")).alias("found")).drop("term")
    words = words.unionByName(of_lang.select("lang", F.lit(None).cast("array<struct<number:int,share:bigint>>").alias("found")))
    words = words.join(of_lang.select("lang", "bases"), "lang")
    words = words.withColumn("strip", F.explode(F.sequence(F.lit(0), F.floor((F.size("bases") - 1) / STRIP).cast("int"))))
    apart = _apart(words).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).filter("a <> b").join(of_lang.select("lang", "names"), "lang")
    name = lambda c: F.get("names", F.col(c))
    pairs = apart.select("lang", name("a").alias("source"), F.lit("pair").alias("part"), name("b").alias("item"), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = marking.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
