"""From collected items to ranked news: drop, dedupe, corroborate, strip, classify, score.

Items carry ``item_id, source_id, publisher_group, source_kind, authority,
lane_hints, title, url, canonical_url, body, published_at``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.config import DEFAULT_NEWS_LANE, JOB_LANE, LEXICON, VETO_PATTERNS, WEIGHTS, Lexicon, Weights
from tidemark.functions import scoring as S
from tidemark.functions.common import any_match, blank, case_of, let, stage
from tidemark.functions.lexicon import lane_scores, whole_word_hits, with_term_hits
from tidemark.functions.pubdates import age_hours
from tidemark.functions.text import first_sentences, title_key
from tidemark.operators.boilerplate import (
    MIN_ITEMS,
    MIN_SENTENCE_CHARS,
    REPEAT_FRACTION,
    strip_boilerplate,
    with_sentences,
)
from tidemark.operators.skew import lookup_join

# Text rules.
STRIPPED_FLOOR = 80
THIN_BODY = 200
OFF_TOPIC_BELOW = 0.05
HINT_WEIGHT = 0.15
JOB_GENETICS_SHARE = 0.8
#: Kind, rule, and pieces of text of which a match, in lower case, holds at least one.
EVENT_RULES = (
    ("financing", r"\bseries [a-d]\b|\braises?\s+\$|\bfinancing\b|\bseed round\b", ("series ", "raise", "financing", "seed round")),
    ("ma", r"\bacquires?\b|\bacquisition\b|\bmerger\b|\bto buy\b", ("acquire", "acquisition", "merger", "to buy")),
    ("approval", r"\bapprovals?\b|\bapproved\b|\bFDA clears?\b", ("approval", "approved", "fda clear")),
    ("readout", r"\breadout\b|\btopline\b|\bmet the primary\b|\bmissed the primary\b", ("readout", "topline", "the primary")),
)


def intake_drop(vetoes: tuple[str, ...] = VETO_PATTERNS) -> Column:
    """Why an item never reaches scoring; null when it does."""
    return (
        F.when(blank(F.col("title")), "no-title")
        .when(blank(F.col("canonical_url")), "no-url")
        .when(any_match(F.col("title"), vetoes), "below-threshold")
    )


def source_rule(body_window: int | None = None) -> Column:
    """``excluded`` or ``filtered`` by the item's own source rules; null when kept.

    Patterns arrive with the source columns ``exclude_url``, ``exclude_title``
    and ``require_any``.
    """
    found = lambda name, text: F.exists(
        F.coalesce(F.col(name), F.array().cast("array<string>")), lambda p: F.regexp_like(text, F.concat(F.lit("(?i)"), p))
    )
    body = F.coalesce(F.col("body"), F.lit(""))
    hay = F.concat(F.col("title"), F.lit(" "), body if body_window is None else F.left(body, F.lit(body_window)))
    required = F.coalesce(F.size("require_any"), F.lit(0)) > 0
    return F.when(found("exclude_url", F.col("url")) | found("exclude_title", F.col("title")), "excluded").when(
        required & ~found("require_any", hay), "filtered"
    )


def dedupe_by_url(items: DataFrame) -> DataFrame:
    """The best copy of each address: authority, then body length, then source and URL.

    ``row_number() = 1`` keeps one row per address and task before the shuffle,
    so a heavily syndicated address does not pile up anywhere.
    """
    best = W.partitionBy("item_id").orderBy(
        F.col("authority").desc(), F.length("body").desc(), F.col("source_id"), F.col("url")
    )
    return items.withColumn("_copy", F.row_number().over(best)).filter("_copy = 1").drop("_copy")


def copies(items: DataFrame) -> DataFrame:
    """Copies per address, for the duplicate count."""
    return items.groupBy("item_id").agg(F.count("*").alias("copies"))


def corroboration(items: DataFrame) -> DataFrame:
    """``(title_key, publishers, titles)``: distinct publisher groups behind each headline.

    Rows are first reduced to (headline, publisher) with a partial count, so a
    headline that a third of all items share arrives as one row per publisher
    and task.
    """
    key = F.col("title_key") if "title_key" in items.columns else title_key(F.col("title")).alias("title_key")
    pairs = (
        items.select(key, "publisher_group")
        .groupBy("title_key", "publisher_group")
        .agg(F.count("*").alias("n"))
    )
    return pairs.groupBy("title_key").agg(
        F.count("publisher_group").alias("publishers"), F.sum("n").alias("titles")
    )


def with_publishers(items: DataFrame) -> DataFrame:
    keyed = items if "title_key" in items.columns else items.withColumn("title_key", title_key(F.col("title")))
    return lookup_join(keyed, corroboration(items), ["title_key"], "titles", F.col("item_id"))


def scorable(items: DataFrame, raw_fallback: int | None = None, job_chars: int | None = None) -> DataFrame:
    """Add ``scorable``: what the item itself says.

    ``None`` for a limit means no limit: the whole text is scored.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    text = F.when(F.length("stripped") >= STRIPPED_FLOOR, F.col("stripped")).otherwise(
        body if raw_fallback is None else F.left(body, F.lit(raw_fallback))
    )
    if job_chars is not None:
        text = F.when(F.col("source_kind") == "jobs", F.left(text, F.lit(job_chars))).otherwise(text)
    return items.withColumn("scorable", text)


def classify(items: DataFrame, lexicon: Lexicon = LEXICON) -> DataFrame:
    """Add ``primary_lane``, ``topic_raw`` and ``topic_hits`` from ``lane_scores``.

    The best lane by score plus a share of the source's hint; the default lane
    wins ties, then the declared order. Jobs stay in their own lane.
    """
    hints = F.col("lane_hints")
    hint = lambda lane: F.coalesce(F.try_element_at(hints, lane), F.lit(0.0))
    ranked = F.transform(
        "lane_scores",
        lambda s, i: F.struct(
            (s["raw"] + hint(s["lane"]) * HINT_WEIGHT).alias("adjusted"),
            (s["lane"] == DEFAULT_NEWS_LANE).cast("int").alias("default"),
            (-i).alias("order"),
            s["lane"].alias("lane"),
            s["raw"].alias("raw"),
            s["hits"].alias("hits"),
        ),
    )
    lane_of = lambda name: F.get(F.filter("lane_scores", lambda s: s["lane"] == name), F.lit(0))
    df = items.withColumns({"_best": F.array_max(ranked), "_job": lane_of(JOB_LANE), "_gen": lane_of(DEFAULT_NEWS_LANE)})
    job = F.col("source_kind") == "jobs"
    no_hits = F.array().cast("array<string>")
    job_raw = F.greatest(F.coalesce("_job.raw", F.lit(0.0)), F.coalesce("_gen.raw", F.lit(0.0)) * JOB_GENETICS_SHARE)
    return stage(
        df,
        {
            "primary_lane": F.when(job, JOB_LANE).otherwise(F.col("_best.lane")),
            "topic_raw": F.when(job, job_raw).otherwise(F.col("_best.raw")),
            "topic_hits": F.when(
                job, F.array_union(F.coalesce("_job.hits", no_hits), F.coalesce("_gen.hits", no_hits))
            ).otherwise(F.col("_best.hits")),
        },
    ).drop("_best", "_job", "_gen")


def detect_events(window: int | None = None) -> Column:
    """What kind of news an item is, by its source and its opening words."""
    body = F.coalesce(F.col("body"), F.lit(""))
    text = F.concat(F.col("title"), F.lit(" "), body if window is None else F.left(body, F.lit(window)))
    kind = F.col("source_kind")
    by_kind = [("journal", "major-journal-primary"), ("preprint", "preprint"), ("jobs", "personnel")]

    def by_words(t: Column) -> Column:
        # most texts hold none of a rule's pieces, which is found much faster than that the rule does not match
        may = lambda pieces: reduce(or_, [t["low"].contains(p) for p in pieces])
        return F.array(*[F.when(may(pieces) & t["text"].rlike("(?i)" + rule), name) for name, rule, pieces in EVENT_RULES])

    words = let(F.struct(text.alias("text"), F.lower(text).alias("low")), by_words)
    return F.array_compact(F.concat(F.array(*[F.when(kind == k, name) for k, name in by_kind]), words))


def score_news(items: DataFrame, now: Column, w: Weights = WEIGHTS, events_window: int | None = None) -> DataFrame:
    """Add ``age_hours``, ``events``, ``factors``, ``penalties``, ``score`` for classified items."""
    lane = F.col("primary_lane")
    df = stage(
        items, {"age_hours": age_hours(F.col("published_at"), now), "events": detect_events(events_window)}
    )
    half_life = case_of(lane, w.recency_half_life_hours, w.default_half_life_hours)
    recency = F.pow(F.lit(2.0), -F.col("age_hours") / half_life)
    publishers = F.coalesce(F.col("publishers"), F.lit(1))
    age_text = F.array(F.concat(F.round("age_hours").cast("long").cast("string"), F.lit("h old")))
    factors = F.array_compact(
        F.array(
            S.factor("lexicon", "Topic match", F.col("topic_raw"), w.points["lexicon"], F.col("topic_hits")),
            S.factor("recency", "Recency", recency, w.points["recency"], age_text),
            S.factor("authority", "Source authority", F.col("authority"), w.points["authority"]),
            S.event_factor(F.col("events"), w, with_evidence=False),
            F.when(
                publishers > 1,
                S.factor(
                    "corroboration",
                    "Corroboration",
                    F.least(F.lit(1.0), (publishers - 1) / 2),
                    w.points["corroboration"],
                    F.array(F.concat(publishers.cast("string"), F.lit(" publisher groups"))),
                ),
            ),
        )
    )
    flat = lambda key, label: S.factor(key, label, F.lit(1.0), -w.penalties[key])
    penalties = F.array_compact(
        F.array(
            F.when(F.length(F.coalesce("body", F.lit(""))) < THIN_BODY, flat("thinContent", "Thin content")),
            F.when(F.col("published_at").isNull(), flat("dateMissing", "No date")),
            F.when(F.col("topic_raw") < OFF_TOPIC_BELOW, flat("offTopic", "Off topic")),
        )
    )
    df = stage(df, {"factors": factors, "penalties": penalties})
    return stage(
        df,
        {"score": S.total_score(F.col("factors"), F.col("penalties")), "weights_version": F.lit(w.fingerprint())},
    )


def news_drop(w: Weights = WEIGHTS, lexicon: Lexicon = LEXICON) -> Column:
    """Why a scored item is left out: age, threshold, or a job without one specific term."""
    max_age = case_of(F.col("primary_lane"), w.max_age_days, w.default_max_age_days)
    too_old = F.col("published_at").isNotNull() & (F.col("age_hours") / 24 > max_age)
    strong = lexicon.high_signal()
    terms = [t.term.lower() for ts in lexicon.lanes.values() for t in ts] + [t.term.lower() for t in lexicon.acronyms]
    lowered = F.transform("topic_hits", lambda h: F.lower(h))
    in_title = F.arrays_overlap(whole_word_hits(F.lower("title"), terms), lowered)
    specific = F.exists(lowered, lambda h: h.isin(*strong)) if strong else F.lit(False)
    vague_job = (F.col("source_kind") == "jobs") & ~in_title & ~specific
    return (
        F.when(too_old, "too-old")
        .when(F.col("score") < w.keep_threshold, "below-threshold")
        .when(vague_job, "below-threshold")
    )


def rank_news(
    items: DataFrame,
    now: Column,
    w: Weights = WEIGHTS,
    lexicon: Lexicon = LEXICON,
    fraction: float = REPEAT_FRACTION,
    min_items: int = MIN_ITEMS,
    min_sentence: int = MIN_SENTENCE_CHARS,
    body_window: int | None = None,
    event_window: int | None = None,
    raw_fallback: int | None = None,
    job_chars: int | None = None,
    materialize: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Every distinct item with its score and ``drop_reason``.

    Whole texts are scored. ``body_window`` and ``event_window`` look for terms
    and events in so many first characters only, ``raw_fallback`` and
    ``job_chars`` shorten what stands in for a stripped body and what a job says.
    The deduplicated items feed five steps; ``materialize`` writes them out
    once instead of deduplicating for each, worth it on large inputs.
    """
    survivors = items.filter(intake_drop().isNull())
    # what later steps read again and again is computed once: headline keys, sentences and their digests
    unique = with_sentences(dedupe_by_url(survivors), "body", min_sentence).withColumn("title_key", title_key(F.col("title")))
    if materialize is not None:
        unique = materialize(unique, "unique-items")
    unique = with_publishers(unique)
    stripped = strip_boilerplate(unique, fraction, min_items).drop("sentences")
    hits = with_term_hits(scorable(stripped, raw_fallback, job_chars), lexicon=lexicon, window=body_window)
    classified = classify(lane_scores(hits, lexicon, w), lexicon)
    scored = score_news(classified, now, w, event_window)
    return stage(scored, {"drop_reason": news_drop(w, lexicon)})


def drop_accounting(*parts: DataFrame) -> DataFrame:
    """``(drop_reason, dropped)`` over any number of tables with a ``drop_reason`` column."""
    union = None
    for part in parts:
        reasons = part.filter(F.col("drop_reason").isNotNull()).select("drop_reason")
        union = reasons if union is None else union.unionByName(reasons)
    return union.groupBy("drop_reason").agg(F.count("*").alias("dropped"))


def news_rows(ranked: DataFrame) -> DataFrame:
    """Kept items in the shape shared with obligations."""
    return ranked.filter(F.col("drop_reason").isNull()).select(
        F.lit("news").alias("kind"),
        "item_id",
        "title",
        "url",
        "canonical_url",
        "source_id",
        "source_kind",
        "publisher_group",
        "primary_lane",
        "score",
        "factors",
        "penalties",
        "weights_version",
        "events",
        "published_at",
        first_sentences(F.coalesce("body", F.lit("")), 2).alias("digest"),
    )


def is_stale(kind: Column, deadline_kind: Column, days: Column, lane: Column, published: Column, now: Column, w: Weights = WEIGHTS) -> Column:
    """An obligation retires only past its grace window; news retires by age."""
    dated = ~deadline_kind.isin("rolling", "unknown") & days.isNotNull()
    age_days = (F.unix_micros(now) - F.unix_micros(published)) / F.lit(86_400_000_000.0)
    too_old = age_days > case_of(lane, w.max_age_days, w.default_max_age_days)
    return F.when(kind == "opportunity", F.coalesce(dated & (days < -w.grace_days), F.lit(False))).otherwise(
        F.coalesce(too_old, F.lit(False))
    )
