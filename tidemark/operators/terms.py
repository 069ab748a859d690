"""Weighted terms held in a table of any size, looked up in whole texts.

Terms are found by their first word: every place of a text whose word begins
some term is joined with the terms that begin so, and the few that go on as the
text does are hits. While the terms are few they are sent to all tasks, and a
row drops the places where none begins before it cuts out what follows them:
texts are read where they lie and only hits are shuffled. With more terms
both sides meet by first word, still without pairing documents with terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import LEXICON, WEIGHTS, Lexicon, Weights
from tidemark.functions.common import let, stage
from tidemark.functions.lexicon import WORD

TERMS = "lane string, term string, weight double, exact_case boolean"
#: So many terms at most go to all tasks, and their first words into the plan.
MOST_SENT = 4096


def term_table(spark: SparkSession, lexicon: Lexicon = LEXICON) -> DataFrame:
    """A configured lexicon as a table. Case-sensitive acronyms count in every lane that has terms."""
    lanes = {lane: lexicon.lane_terms(lane) for lane in lexicon.lanes if lexicon.lane_terms(lane)}
    rows = [(lane, t.term.lower(), float(t.weight), False) for lane, terms in lanes.items() for t in terms]
    rows += [(lane, t.term, float(t.weight), True) for lane in lanes for t in lexicon.acronyms]
    return spark.createDataFrame(rows, TERMS)


def _places(text: Column, longest: int, firsts: list[str] | None) -> Column:
    """``array<struct<word, run>>``: a word, and the text from there on over so many words.

    Of every word, or of those in ``firsts`` alone.
    """
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    begins = lambda w: F.lit(True) if firsts is None else w.isin(*firsts)
    if longest <= 1:
        return F.transform(F.filter(words, begins), lambda w: F.struct(w.alias("word"), w.alias("run")))
    spaced = F.regexp_extract_all(text, F.lit(f"({WORD}[^A-Za-z0-9]*)"), F.lit(1))

    def places(c: Column) -> Column:
        starts = F.filter(F.transform(c["words"], lambda w, i: F.when(begins(w), i)), lambda i: i.isNotNull())
        run = lambda i: F.array_join(F.slice(c["spaced"], i + 1, longest), "")
        return F.transform(starts, lambda i: F.struct(F.get(c["words"], i).alias("word"), run(i).alias("run")))

    # both cuts are bound once: inside they are indexed per place
    return let(F.struct(words.alias("words"), spaced.alias("spaced")), places)


def term_hits(docs: DataFrame, terms: DataFrame, key: str, title: str, body: str, most_sent: int = MOST_SENT) -> DataFrame:
    """``(key, lane, term, weight, n, in_title)``: how often each term stands as whole words in a document.

    ``terms``: lane, term, weight, exact_case; folded terms are in lower case, and
    a term begins and ends with a letter or digit. Repeated terms of a lane count
    once, with the greatest weight. Null texts are empty; ``key`` is one row per document.
    Up to ``most_sent`` terms are sent to all tasks; any number gives the same rows.
    """
    terms = terms.groupBy("lane", "term", "exact_case").agg(F.max("weight").alias("weight"))
    n_words = F.size(F.regexp_extract_all(F.col("term"), F.lit(f"({WORD})"), F.lit(1)))
    longest, n_terms = terms.agg(F.max(n_words), F.count("*")).first()
    longest = longest or 1
    first = F.regexp_extract("term", WORD, 0).alias("word")
    index = terms.select(first, F.col("exact_case").alias("exact"), "lane", "term", "weight")
    kinds = sorted(r[0] for r in terms.select("exact_case").distinct().collect()) or [False]
    firsts: dict[bool, list[str] | None] = dict.fromkeys(kinds)
    if n_terms <= most_sent:
        # a table made in Python has no size that the planner knows
        index = F.broadcast(index)
        found = index.select("exact", "word").distinct().collect()
        firsts = {k: sorted(w for e, w in found if e == k and w is not None) for k in kinds}
    text = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    part = lambda c, exact, titled: F.struct(
        F.lit(exact).alias("exact"), F.lit(titled).alias("titled"), _places(text(c) if exact else F.lower(text(c)), longest, firsts[exact]).alias("places")
    )
    parts = F.array(*[part(c, exact, titled) for exact in kinds for c, titled in ((title, True), (body, False))])
    rows = stage(docs.select(F.col(f"`{key}`").alias("key"), *[F.col(f"`{c}`") for c in dict.fromkeys((title, body))]), {"_parts": parts})
    places = rows.select("key", F.inline("_parts")).select("key", "exact", "titled", F.inline("places"))
    found = places.join(index, ["word", "exact"])
    after = F.substr("run", F.length("term") + 1, F.lit(1))
    found = found.filter(F.startswith("run", "term") & ~after.rlike("[A-Za-z0-9]"))
    return found.groupBy("key", "lane", "term", "exact").agg(
        F.max("weight").alias("weight"), F.count("*").alias("n"), F.bool_or("titled").alias("in_title")
    ).drop("exact")


def lane_points(hits: DataFrame, w: Weights = WEIGHTS) -> DataFrame:
    """``(key, lane, raw, hits)`` for every lane in which a document has a term; ``raw`` saturates as t / (t + K)."""
    points = F.col("weight") * (1 + F.log(F.col("n").cast("double"))) * F.when(F.col("in_title"), 2.0).otherwise(1.0)
    sums = hits.groupBy("key", "lane").agg(F.sum(points).alias("points"), F.sort_array(F.collect_set("term")).alias("hits"))
    return sums.select("key", "lane", (F.col("points") / (F.col("points") + w.lexicon_saturation)).alias("raw"), "hits")
