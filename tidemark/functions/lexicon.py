"""Whole-word term matching without a document-by-term join.

A term is a run of words with exact separators between them, bounded by
anything that is not an ASCII letter or digit. So the text is cut into words
once, runs of the right length are built only where a term's first word
occurs, and each is looked up in a hash set of literals. The work per document
is one pass over its words whatever the size of the lexicon, and nothing is
exploded or shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import LEXICON, WEIGHTS, Lexicon, Term, Weights
from tidemark.functions.common import let, stage

WORD = "[A-Za-z0-9]+"


def _words_in(term: str) -> list[str]:
    words = re.findall(WORD, term)
    if not words or not re.fullmatch(rf"{WORD}(?:.*{WORD})?", term, re.S):
        raise ValueError(f"a term must begin and end with a letter or digit: {term!r}")
    return words


def whole_word_hits(text: Column, terms: Iterable[str]) -> Column:
    """Every occurrence of any term, as an array of terms with repeats."""
    by_length: dict[int, list[str]] = {}
    for term in dict.fromkeys(terms):
        by_length.setdefault(len(_words_in(term)), []).append(term)
    if not by_length:
        return F.array().cast("array<string>")
    singles = by_length.pop(1, [])
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    if not by_length:
        return F.filter(words, lambda w: w.isin(*singles))
    spaced = F.regexp_extract_all(text, F.lit(f"({WORD}[^A-Za-z0-9]*)"), F.lit(1))

    def search(cut: Column) -> Column:
        found = [F.filter(cut["words"], lambda w: w.isin(*singles))] if singles else []
        found += [_runs(cut["words"], cut["spaced"], n, group) for n, group in sorted(by_length.items())]
        return F.concat(*found)

    # both cuts are bound once: inside the search they are indexed per position
    return let(F.struct(words.alias("words"), spaced.alias("spaced")), search)


def _runs(words: Column, spaced: Column, n: int, group: list[str]) -> Column:
    firsts = sorted({_words_in(t)[0] for t in group})
    starts = F.filter(
        F.transform(words, lambda w, i: F.when(w.isin(*firsts), i)), lambda i: i.isNotNull() & (i + n <= F.size(words))
    )
    runs = F.transform(
        starts,
        lambda i: F.concat(F.array_join(F.slice(spaced, i + 1, F.lit(n - 1)), ""), F.get(words, i + (n - 1))),
    )
    return F.filter(runs, lambda r: r.isin(*group))


def _weight_map(terms: Iterable[Term], fold: bool) -> Column:
    pairs = {(t.term.lower() if fold else t.term): t.weight for t in terms}
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _counts(hits: Column) -> Column:
    """``array<struct<term, n>>`` of a list of hits: sorted once, counted by where the next term begins."""

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(
            F.transform(ordered, lambda h, i: F.when((i == 0) | (F.get(ordered, i - 1) != h), i)), lambda i: i.isNotNull()
        )
        ends = lambda s: F.transform(s, lambda at, j: F.struct(at.alias("at"), F.coalesce(F.get(s, j + 1), n).alias("end")))
        spans = let(starts, ends)
        return F.transform(spans, lambda x: F.struct(F.get(ordered, x["at"]).alias("term"), (x["end"] - x["at"]).alias("n")))

    return let(F.sort_array(hits), runs)


def _sum_hits(counts: Column, hits: Column, in_title: Column, terms: tuple[Term, ...], fold: bool) -> tuple[Column, Column]:
    """``(points, distinct hits)``: weight x (1 + ln count), doubled for a title hit. ``counts`` are those of ``hits``."""
    names = [t.term.lower() if fold else t.term for t in terms]
    mine = F.filter(F.array_distinct(hits), lambda h: h.isin(*names))
    counted = F.filter(counts, lambda c: c["term"].isin(*names))
    weights = _weight_map(terms, fold)

    def points(c: Column) -> Column:
        twice = F.when(F.array_contains(in_title, c["term"]), 2.0).otherwise(1.0)
        return F.try_element_at(weights, c["term"]) * (1 + F.log(c["n"].cast("double"))) * twice

    # the order of first occurrence, so that sums of doubles do not depend on the sort
    in_order = F.transform(mine, lambda h: F.get(F.filter(counted, lambda c: c["term"] == h), F.lit(0)))
    return F.aggregate(in_order, F.lit(0.0), lambda acc, c: acc + points(c)), mine


def with_term_hits(df, title: str = "title", body: str = "scorable", lexicon: Lexicon = LEXICON, window: int | None = None):
    """Add ``_title_terms``/``_all_terms`` and their case-sensitive twins to a table of texts.

    ``window`` is the number of body characters that count towards the score;
    ``None`` scores the whole body.
    """
    terms = [t.term.lower() for lane in lexicon.lanes for t in lexicon.lane_terms(lane)]
    acronyms = [t.term for t in lexicon.acronyms]
    text = F.col(body) if window is None else F.left(F.col(body), F.lit(window))
    df = df.withColumns(
        {
            "_title_terms": whole_word_hits(F.lower(F.coalesce(F.col(title), F.lit(""))), terms),
            "_body_terms": whole_word_hits(F.lower(F.coalesce(text, F.lit(""))), terms),
            "_title_acronyms": whole_word_hits(F.coalesce(F.col(title), F.lit("")), acronyms),
            "_body_acronyms": whole_word_hits(F.coalesce(text, F.lit("")), acronyms),
        }
    )
    return stage(
        df,
        {
            "_title_terms": F.col("_title_terms"),
            "_title_acronyms": F.col("_title_acronyms"),
            "_all_terms": F.concat("_title_terms", "_body_terms"),
            "_all_acronyms": F.concat("_title_acronyms", "_body_acronyms"),
            "_term_counts": _counts(F.concat("_title_terms", "_body_terms")),
            "_acronym_counts": _counts(F.concat("_title_acronyms", "_body_acronyms")),
        },
    ).drop("_body_terms", "_body_acronyms")


def lane_scores(df, lexicon: Lexicon = LEXICON, weights: Weights = WEIGHTS):
    """Add ``lane_scores``: ``array<struct<lane, raw, hits>>`` in lane order.

    ``raw`` saturates as t / (t + K) so a list of forty terms cannot win by length.
    """
    k = F.lit(weights.lexicon_saturation)
    if lexicon.acronyms:
        acronym_points, acronym_hits = _sum_hits(
            F.col("_acronym_counts"), F.col("_all_acronyms"), F.col("_title_acronyms"), lexicon.acronyms, fold=False
        )
    else:
        acronym_points, acronym_hits = F.lit(0.0), F.array().cast("array<string>")
    df = df.withColumns({"_acronym_points": acronym_points, "_acronym_hits": acronym_hits})

    totals, lanes = {}, []
    for lane in lexicon.lanes:
        terms = lexicon.lane_terms(lane)
        if not terms:
            continue
        points, hits = _sum_hits(F.col("_term_counts"), F.col("_all_terms"), F.col("_title_terms"), terms, fold=True)
        totals[f"_points_{lane}"] = points
        totals[f"_hits_{lane}"] = hits
        lanes.append(lane)
    df = df.withColumns(totals)
    entries = []
    for lane in lexicon.lanes:
        if lane in lanes:
            total = F.col(f"`_points_{lane}`") + F.col("_acronym_points")
            hits = F.concat(F.col(f"`_hits_{lane}`"), F.col("_acronym_hits"))
        else:
            total, hits = F.lit(0.0), F.array().cast("array<string>")
        entries.append(F.struct(F.lit(lane).alias("lane"), (total / (total + k)).alias("raw"), hits.alias("hits")))
    df = stage(df, {"lane_scores": F.array(*entries)})
    scratch = [c for c in df.columns if c.startswith("_points_") or c.startswith("_hits_")]
    return df.drop(*scratch, "_acronym_points", "_acronym_hits")
