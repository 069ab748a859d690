"""Registered queries over collected items: intake, dedupe, boilerplate, lanes, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import LANES, LEXICON, Lexicon, Term
from tidemark.functions.common import stage
from tidemark.functions.ids import item_id
from tidemark.functions.lexicon import lane_scores, with_term_hits
from tidemark.functions.urls import canonical_url
from tidemark.operators import boilerplate as B
from tidemark.operators import lanes as L
from tidemark.operators import news as N
from tidemark.operators import terms as T
from tidemark.plans import fixtures as X
from tidemark.plans.text_queries import ITEMS, KEY, SENTENCE_KEY, SENTENCES
from tidemark.session import materialize
from tidemark.sources.dims import lane_from_hints

# documents share few sentences, so a low share counts as boilerplate here
FRACTION = 0.04
# words that occur in the driver's documents, one list per lane
FIXTURE_LEXICON = Lexicon(
    lanes={
        "deadlines": (),
        "fellowships": (Term("that", 2.0), Term("with", 1.5), Term("of the", 2.5)),
        "mstp-labs": (Term("dans", 2.0), Term("avec", 1.5)),
        "venture-founder": (Term("from", 3.0), Term("this", 1.0)),
        "conferences": (),
        "causal-genetics": (Term("which", 2.0), Term("eine", 2.5), Term("para", 1.0)),
        "tools-platforms": (Term("auch", 2.0), Term("como", 1.5), Term("in the", 3.0)),
    },
    acronyms=(Term("The", 1.0), Term("De", 0.5)),
)


def _items(spark, sf):
    df = X.items(spark, sf).withColumn("canonical_url", canonical_url(F.col("url")))
    return df.withColumn("item_id", item_id(F.col("canonical_url")))


def _copies(spark, sf):
    """Every item, its tracked copy, and for even documents a copy from another source."""
    df = X.items(spark, sf)
    other = F.concat(F.col("url"), F.lit("/?utm_campaign=x"))
    variants = F.array(
        F.struct(F.col("url").alias("url"), F.col("source_id").alias("source_id"), F.col("authority").alias("authority")),
        F.struct(other.alias("url"), F.col("source_id").alias("source_id"), F.col("authority").alias("authority")),
        F.struct(
            F.col("url").alias("url"), F.lit("wire").alias("source_id"),
            F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.1).alias("authority"),
        ),
    )
    keep = [c for c in df.columns if c not in ("url", "source_id", "authority")]
    df = df.select(*keep, F.inline(variants))
    df = df.withColumn("canonical_url", canonical_url(F.col("url")))
    return df.withColumn("item_id", item_id(F.col("canonical_url")))


def url_dedupe(spark, sf):
    copies = _copies(spark, sf)
    best = N.dedupe_by_url(copies).select("item_id", "doc_id", "source_id", "url", "authority")
    return best.join(N.copies(copies), "item_id")


def corroboration(spark, sf):
    df = N.with_publishers(_items(spark, sf))
    return df.select("doc_id", "title_key", "publishers")


def boilerplate_sentences(spark, sf):
    df = B.with_sentences(_items(spark, sf).select("source_id", "item_id", "body"))
    return B.boilerplate_sentences(df, FRACTION)


def _with_sentences(spark, sf):
    """Items with their sentences, written once: several steps read them."""
    return materialize(B.with_sentences(_items(spark, sf).select("doc_id", "source_id", "item_id", "body")), "sentences")


def boilerplate_size(spark, sf):
    df = _with_sentences(spark, sf)
    return B.boilerplate_size(B.find_boilerplate(df, FRACTION))


def strip_boilerplate(spark, sf):
    df = _with_sentences(spark, sf)
    out = B.strip_boilerplate(df, FRACTION)
    return out.select("doc_id", F.length("stripped").cast("long").alias("chars"), F.left(F.sha2("stripped", 256), F.lit(16)).alias("digest"))


def _hits(spark, sf):
    df = _items(spark, sf).withColumn("scorable", F.col("body"))
    return with_term_hits(df, lexicon=FIXTURE_LEXICON, window=None)


def lexicon_scores(spark, sf):
    df = lane_scores(_hits(spark, sf), FIXTURE_LEXICON)
    rows = df.select("doc_id", F.inline("lane_scores"))
    return rows.filter("raw > 0").select(
        "doc_id", "lane", F.round("raw", 6).alias("raw"), F.array_join(F.array_sort("hits"), ",").alias("hits")
    )


#: Every term of the full word lists, to be planted by key.
_WORD_LISTS = list(dict.fromkeys([t.term for lane in LEXICON.lanes for t in LEXICON.lane_terms(lane)] + [t.term for t in LEXICON.acronyms]))


def reference_lexicon(spark, sf):
    """The full word lists, as a table, over whole documents with a term planted in each: how many items each lane can claim."""
    planted = F.element_at(F.array(*[F.lit(t) for t in _WORD_LISTS]), (F.col("doc_id") % len(_WORD_LISTS) + 1).cast("int"))
    planted = F.when(F.col("doc_id") % 2 == 0, F.upper(planted)).otherwise(planted)
    items = _items(spark, sf).withColumn("body", F.concat("body", F.lit(" ("), planted, F.lit(")")))
    hits = T.term_hits(items, T.term_table(spark), "doc_id", "title", "body")
    return T.lane_points(hits).groupBy("lane").agg(F.count("*").alias("matched"), F.sum(F.size("hits")).alias("terms"))


def term_scores(spark, sf):
    """``lexicon_scores`` from terms in a table: the same lists, the same scores."""
    hits = T.term_hits(_items(spark, sf), T.term_table(spark, FIXTURE_LEXICON), "doc_id", "title", "body")
    rows = T.lane_points(hits)
    return rows.select(F.col("key").alias("doc_id"), "lane", F.round("raw", 6).alias("raw"), F.array_join(F.array_sort("hits"), ",").alias("hits"))


def lane_argmax(spark, sf):
    df = N.classify(lane_scores(_hits(spark, sf), FIXTURE_LEXICON), FIXTURE_LEXICON)
    return df.select("doc_id", "source_kind", "primary_lane", F.round("topic_raw", 6).alias("topic"))


def event_detection(spark, sf):
    """Business words planted by key in front of each body."""
    phrase = F.element_at(
        F.array(*[F.lit(p) for p in ("raises $20m in a series b", "merger to close", "FDA clears device", "topline readout", "nothing of note")]),
        (F.col("doc_id") % 5 + 1).cast("int"),
    )
    df = X.items(spark, sf).withColumn("body", F.concat(phrase, F.lit(" "), F.col("body")))
    return df.select("doc_id", F.array_join(N.detect_events(window=None), ",").alias("events"))


RULES = (
    "array('/src1/') AS exclude_url",
    "array('^the ') AS exclude_title",
    "CASE WHEN doc_id % 2 = 0 THEN array('\\\\bwhich\\\\b.{0,30}\\\\bthe\\\\b', '\\\\bdans\\\\b') ELSE array() END AS require_any",
)


def source_filters(spark, sf):
    df = X.items(spark, sf).selectExpr("*", *RULES)
    outcome = F.coalesce(N.source_rule(body_window=None), F.lit("kept"))
    return df.groupBy("source_id", outcome.alias("outcome")).agg(F.count("*").alias("items"))


def intake_drops(spark, sf):
    """Titles made to hit each rule by key."""
    k = F.col("doc_id") % 11
    title = F.when(k == 0, "").when(k == 1, "Author Correction: a study").when(k == 2, F.lit(None)).when(
        k == 3, "Book review of the year"
    ).otherwise(F.col("title"))
    df = X.items(spark, sf).withColumn("title", title.cast("string"))
    df = df.withColumn("canonical_url", F.when(k == 4, "").otherwise(canonical_url(F.col("url"))))
    return df.groupBy(F.coalesce(N.intake_drop(), F.lit("kept")).alias("outcome")).agg(F.count("*").alias("items"))


def rank(items):
    return N.rank_news(items, X.CLOCK.at, lexicon=FIXTURE_LEXICON, fraction=FRACTION, materialize=materialize)


def _ranked(spark, sf):
    return rank(_items(spark, sf))


def news_ranked(spark, sf):
    return _ranked(spark, sf).select(
        "doc_id", "primary_lane", "score", F.coalesce("drop_reason", F.lit("kept")).alias("outcome"),
        F.array_join(F.transform("penalties", lambda p: p["key"]), ",").alias("penalties"),
    )


def news_drop_accounting(spark, sf):
    return N.drop_accounting(_ranked(spark, sf))


def topk_per_lane(spark, sf):
    rows = N.news_rows(_ranked(spark, sf))
    return L.top_per_lane(rows).select(
        "item_id", "primary_lane", "score", F.coalesce("rank", F.lit(0)).cast("long").alias("rank")
    )


def over_cap(spark, sf):
    return L.over_cap(N.news_rows(_ranked(spark, sf)))


def news_daily_cap(spark, sf):
    """The best forty-two of the day: a report's own limit."""
    rows = N.news_rows(_ranked(spark, sf))
    return rows.orderBy(F.col("score").desc(), "item_id").limit(42).select("item_id", "score", "primary_lane")


def hint_lanes(spark, sf):
    hints = F.when(F.col("doc_id") % 3 == 0, F.expr("map('tools-platforms', 0.4D, 'fellowships', 0.4D)")).when(
        F.col("doc_id") % 3 == 1, F.expr("map('conferences', 0.9D, 'fellowships', 0.4D)")
    )
    df = X.items(spark, sf).select(lane_from_hints(hints).alias("lane"))
    return df.groupBy("lane").agg(F.count("*").alias("items"))


QUERIES = {
    f.__name__: f
    for f in (
        url_dedupe, corroboration, boilerplate_sentences, boilerplate_size, strip_boilerplate, lexicon_scores,
        reference_lexicon, term_scores, lane_argmax, event_detection, source_filters, intake_drops, news_ranked,
        news_drop_accounting, topk_per_lane, over_cap, news_daily_cap, hint_lanes,
    )
}

# Whole-word counts without look-around: separators are doubled, so that every
# occurrence has one of its own on either side.
_DOUBLED = lambda c: f"' ' || regexp_replace({c}, '([^A-Za-z0-9])', '\\1\\1', 'g') || ' '"


def _count(text: str, term: str) -> str:
    doubled = term.replace(" ", "  ")
    return f"length(regexp_extract_all({text}, '[^A-Za-z0-9]{doubled}[^A-Za-z0-9]'))"


def _term_values() -> str:
    rows = [
        (lane, t.term.lower(), t.weight) for lane in FIXTURE_LEXICON.lanes for t in FIXTURE_LEXICON.lane_terms(lane)
    ]
    return ", ".join(f"('{lane}', '{term}', {weight})" for lane, term, weight in rows)


def _each(text: str, terms: list[str]) -> str:
    return "[" + ", ".join(_count(text, t) for t in terms) + "]"


_TERMS = [t.term.lower() for lane in FIXTURE_LEXICON.lanes for t in FIXTURE_LEXICON.lane_terms(lane)]
_ACRO = [t.term for t in FIXTURE_LEXICON.acronyms]
_LIST = lambda xs: "['" + "', '".join(xs) + "']"


def _lexicon_sql(body: str) -> str:
    """Lane scores in long form, from an ``items`` relation with a ``title`` and the given body column."""
    return f"""
texts AS (
  SELECT doc_id, {_DOUBLED("lower(title)")} AS tl, {_DOUBLED(f"lower({body})")} AS bl,
         {_DOUBLED("title")} AS tc, {_DOUBLED(body)} AS bc FROM {{source}}
),
term_counts AS (
  SELECT doc_id, unnest({_LIST(_TERMS)}) AS term, unnest({_each("tl", _TERMS)}) AS nt, unnest({_each("bl", _TERMS)}) AS nb FROM texts
),
acro_counts AS (
  SELECT doc_id, unnest({_LIST(_ACRO)}) AS term, unnest({_each("tc", _ACRO)}) AS nt, unnest({_each("bc", _ACRO)}) AS nb FROM texts
),
lexicon(lane, term, weight) AS (VALUES {_term_values()}),
lane_list AS (SELECT DISTINCT lane FROM lexicon),
term_hits AS (
  SELECT doc_id, lane, term, weight * (1 + ln(nt + nb)) * CASE WHEN nt > 0 THEN 2 ELSE 1 END AS pts
  FROM term_counts JOIN lexicon USING (term) WHERE nt + nb > 0
  UNION ALL
  SELECT doc_id, lane, term, CASE term WHEN 'The' THEN 1.0 ELSE 0.5 END * (1 + ln(nt + nb)) * CASE WHEN nt > 0 THEN 2 ELSE 1 END
  FROM acro_counts, lane_list WHERE nt + nb > 0
),
lane_points AS (
  SELECT doc_id, lane, sum(pts) / (sum(pts) + 8) AS raw, list(term) AS hits FROM term_hits GROUP BY doc_id, lane
)"""


_LANE_RANK = "CASE lane " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(LANES)) + " END"
_CLASSIFY = f"""
all_lanes AS (
  SELECT doc_id, source_kind, lane, coalesce(raw, 0) AS raw, coalesce(hits, []) AS hits, {_LANE_RANK} AS pos,
         CASE lane WHEN 'tools-platforms' THEN 0.2 WHEN 'causal-genetics' THEN 0.1 ELSE 0 END * 0.15 AS prior
  FROM {{source}} CROSS JOIN (SELECT unnest({_LIST(LANES)}) AS lane) LEFT JOIN lane_points USING (doc_id, lane)
),
classified AS (
  SELECT doc_id, any_value(source_kind) AS source_kind,
    CASE WHEN any_value(source_kind) = 'jobs' THEN 'venture-founder'
         ELSE arg_max(lane, (raw + prior, CASE WHEN lane = 'causal-genetics' THEN 1 ELSE 0 END, -pos)) END AS primary_lane,
    CASE WHEN any_value(source_kind) = 'jobs' THEN greatest(max(raw) FILTER (WHERE lane = 'venture-founder'), 0.8 * max(raw) FILTER (WHERE lane = 'causal-genetics'))
         ELSE arg_max(raw, (raw + prior, CASE WHEN lane = 'causal-genetics' THEN 1 ELSE 0 END, -pos)) END AS topic,
    list_distinct(list_concat(flatten(list(hits) FILTER (WHERE lane = 'venture-founder')), flatten(list(hits) FILTER (WHERE lane = 'causal-genetics')))) AS job_hits
  FROM all_lanes GROUP BY doc_id
)"""

_SENT = (
    ITEMS
    + f""",
sents AS (SELECT doc_id, source_id, unnest({SENTENCES}) AS s, generate_subscripts({SENTENCES}, 1) AS pos FROM items),
keyed AS (SELECT *, {SENTENCE_KEY("s")} AS key FROM sents),
sizes AS (SELECT source_id, count(*) AS n_items FROM items GROUP BY source_id),
boiler AS (
  SELECT source_id, key, count(DISTINCT doc_id) AS n FROM keyed JOIN sizes USING (source_id)
  WHERE n_items >= 4 GROUP BY source_id, key, n_items HAVING count(DISTINCT doc_id) >= greatest(2, ceil(n_items * {FRACTION}))
),
kept AS (
  SELECT doc_id, string_agg(s, ' ' ORDER BY pos) AS t FROM keyed k
  WHERE NOT EXISTS (SELECT 1 FROM boiler b WHERE b.source_id = k.source_id AND b.key = k.key) GROUP BY doc_id
),
stripped AS (
  SELECT i.doc_id, CASE WHEN i.source_id IN (SELECT source_id FROM boiler) THEN trim(coalesce(t, '')) ELSE i.body END AS stripped
  FROM items i LEFT JOIN kept USING (doc_id)
)"""
)
_RANK = (
    _SENT
    + f""",
scorable AS (
  SELECT i.*, CASE WHEN length(stripped) >= 80 THEN stripped ELSE body END AS scorable FROM items i JOIN stripped USING (doc_id)
),{_lexicon_sql("scorable").replace("{source}", "scorable")},{_CLASSIFY.replace("{source}", "scorable")},
keys AS (SELECT doc_id, publisher_group, {KEY} AS k FROM items),
pubs AS (SELECT k, count(DISTINCT publisher_group) AS publishers FROM keys GROUP BY k),
ages AS (
  SELECT s.*, primary_lane, topic, job_hits, publishers,
    coalesce((epoch(TIMESTAMP '{X.AS_OF}') - epoch(published_at)) / 3600, 720) AS age
  FROM scorable s JOIN classified USING (doc_id) JOIN keys USING (doc_id) JOIN pubs USING (k)
),
flags AS (
  SELECT *, CASE primary_lane WHEN 'deadlines' THEN 999999 WHEN 'venture-founder' THEN 168 WHEN 'causal-genetics' THEN 96
      WHEN 'tools-platforms' THEN 48 ELSE 336 END AS half,
    CASE primary_lane WHEN 'mstp-labs' THEN 120 WHEN 'venture-founder' THEN 45 WHEN 'causal-genetics' THEN 21
      WHEN 'tools-platforms' THEN 10 ELSE 3650 END AS max_age,
    title || ' ' || body AS words
  FROM ages
),
boosts AS (
  SELECT *, greatest(CASE source_kind WHEN 'journal' THEN 0.7 WHEN 'preprint' THEN 0.3 WHEN 'jobs' THEN 0.25 ELSE 0 END,
    CASE WHEN regexp_matches(words, '(?i)\\bseries [a-d]\\b|\\braises?\\s+\\$|\\bfinancing\\b|\\bseed round\\b') THEN 0.35 ELSE 0 END,
    CASE WHEN regexp_matches(words, '(?i)\\bacquires?\\b|\\bacquisition\\b|\\bmerger\\b|\\bto buy\\b') THEN 0.5 ELSE 0 END,
    CASE WHEN regexp_matches(words, '(?i)\\bapprovals?\\b|\\bapproved\\b|\\bFDA clears?\\b') THEN 0.6 ELSE 0 END,
    CASE WHEN regexp_matches(words, '(?i)\\breadout\\b|\\btopline\\b') THEN 0.5 ELSE 0 END) AS boost
  FROM flags
),
final0 AS (
  SELECT *, floor(greatest(0, 22 * topic + 8 * power(2, -age / half) + 10 * authority + 14 * boost
      + CASE WHEN publishers > 1 THEN 5 * least(1, (publishers - 1) / 2) ELSE 0 END
      - CASE WHEN length(body) < 200 THEN 6 ELSE 0 END - CASE WHEN published_at IS NULL THEN 5 ELSE 0 END
      - CASE WHEN topic < 0.05 THEN 8 ELSE 0 END) * 100 + 0.5) / 100 AS score,
    concat_ws(',', CASE WHEN length(body) < 200 THEN 'thinContent' END, CASE WHEN published_at IS NULL THEN 'dateMissing' END,
      CASE WHEN topic < 0.05 THEN 'offTopic' END) AS penalties
  FROM boosts
),
title_terms AS (
  SELECT doc_id, bool_or(nt > 0) AS any_title FROM (
    SELECT t.doc_id, nt FROM term_counts t JOIN classified c USING (doc_id) WHERE list_contains(job_hits, term)
    UNION ALL
    SELECT t.doc_id, length(regexp_extract_all(tl, '[^A-Za-z0-9]' || lower(term) || '[^A-Za-z0-9]')) AS nt
    FROM acro_counts t JOIN classified c USING (doc_id) JOIN texts USING (doc_id) WHERE list_contains(job_hits, term))
  GROUP BY doc_id
),
final AS (
  SELECT f.*, left(sha256(url), 16) AS item_id,
    CASE WHEN published_at IS NOT NULL AND age / 24 > max_age THEN 'too-old' WHEN score < 22 THEN 'below-threshold'
         WHEN source_kind = 'jobs' AND NOT coalesce(any_title, FALSE) AND NOT list_has_any(job_hits, ['from', 'in the']) THEN 'below-threshold' END AS drop_reason
  FROM final0 f LEFT JOIN title_terms USING (doc_id)
)"""
)

_SCORED = [lane for lane in LEXICON.lanes if LEXICON.lane_terms(lane)]

ORACLES = {
    "url_dedupe": ITEMS
    + """, c AS (
      SELECT left(sha256(url), 16) AS item_id, doc_id, source_id, url, authority FROM items
      UNION ALL SELECT left(sha256(url), 16), doc_id, source_id, url || '/?utm_campaign=x', authority FROM items
      UNION ALL SELECT left(sha256(url), 16), doc_id, 'wire', url, CASE WHEN doc_id % 2 = 0 THEN 0.9 ELSE 0.1 END FROM items)
      SELECT *, count(*) OVER (PARTITION BY item_id) AS copies FROM c
      QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY authority DESC, source_id, url) = 1""",
    "corroboration": ITEMS
    + f""", k AS (SELECT doc_id, publisher_group, {KEY} AS title_key FROM items),
      n AS (SELECT title_key, count(DISTINCT publisher_group) AS publishers FROM k GROUP BY title_key)
      SELECT doc_id, title_key, publishers FROM k JOIN n USING (title_key)""",
    "boilerplate_sentences": _SENT + " SELECT source_id, key, n FROM boiler",
    "boilerplate_size": _SENT + " SELECT source_id, count(*) AS stripped FROM boiler GROUP BY source_id",
    "strip_boilerplate": _SENT
    + " SELECT doc_id, length(stripped) AS chars, left(sha256(stripped), 16) AS digest FROM stripped",
    "lexicon_scores": ITEMS
    + ","
    + _lexicon_sql("body").replace("{source}", "items")
    + " SELECT doc_id, lane, round(raw, 6) AS raw, array_to_string(list_sort(hits), ',') AS hits FROM lane_points",
    "term_scores": ITEMS
    + ","
    + _lexicon_sql("body").replace("{source}", "items")
    + " SELECT doc_id, lane, round(raw, 6) AS raw, array_to_string(list_sort(hits), ',') AS hits FROM lane_points",
    "reference_lexicon": ITEMS
    + f""", t AS (SELECT unnest({_LIST([x for lane in _SCORED for x in [lane] * (len(LEXICON.lane_terms(lane)) + len(LEXICON.acronyms))])}) AS lane,
        unnest({_LIST([x for lane in _SCORED for x in [*(t.term.lower() for t in LEXICON.lane_terms(lane)), *(t.term for t in LEXICON.acronyms)]])}) AS term,
        unnest([{", ".join(str(x) for lane in _SCORED for x in [*[False] * len(LEXICON.lane_terms(lane)), *[True] * len(LEXICON.acronyms)])}]) AS exact),
      p AS (SELECT *, {_LIST(_WORD_LISTS)}[doc_id % {len(_WORD_LISTS)} + 1] AS planted FROM items),
      w AS (SELECT doc_id, ' ' || title || ' | ' || body || ' (' || CASE WHEN doc_id % 2 = 0 THEN upper(planted) ELSE planted END || ')' AS cased FROM p),
      d AS (SELECT *, lower(cased) AS folded FROM w),
      h AS (SELECT DISTINCT doc_id, lane, term FROM d JOIN t ON contains(CASE WHEN exact THEN cased ELSE folded END, term)
        AND regexp_matches(CASE WHEN exact THEN cased ELSE folded END, '[^A-Za-z0-9]' || regexp_escape(term) || '[^A-Za-z0-9]'))
      SELECT lane, count(DISTINCT doc_id) AS matched, count(*) AS terms FROM h GROUP BY lane""",
    "lane_argmax": ITEMS
    + ","
    + _lexicon_sql("body").replace("{source}", "items")
    + ","
    + _CLASSIFY.replace("{source}", "items")
    + " SELECT doc_id, source_kind, primary_lane, round(topic, 6) AS topic FROM classified",
    "event_detection": """WITH t AS (SELECT doc_id, doc_id % 5 AS m, split_part(text, chr(10), 1) || ' ' ||
        ['raises $20m in a series b', 'merger to close', 'FDA clears device', 'topline readout', 'nothing of note'][doc_id % 5 + 1] || ' ' || text AS words FROM documents)
      SELECT doc_id, concat_ws(',', CASE m WHEN 1 THEN 'major-journal-primary' WHEN 2 THEN 'preprint' WHEN 0 THEN 'personnel' END,
        CASE WHEN regexp_matches(words, '(?i)\\bseries [a-d]\\b|\\braises?\\s+\\$|\\bfinancing\\b|\\bseed round\\b') THEN 'financing' END,
        CASE WHEN regexp_matches(words, '(?i)\\bacquires?\\b|\\bacquisition\\b|\\bmerger\\b|\\bto buy\\b') THEN 'ma' END,
        CASE WHEN regexp_matches(words, '(?i)\\bapprovals?\\b|\\bapproved\\b|\\bFDA clears?\\b') THEN 'approval' END,
        CASE WHEN regexp_matches(words, '(?i)\\breadout\\b|\\btopline\\b|\\bmet the primary\\b|\\bmissed the primary\\b') THEN 'readout' END) AS events FROM t""",
    "source_filters": ITEMS
    + """ SELECT source_id, CASE WHEN contains(url, '/src1/') OR regexp_matches(title, '(?i)^the ') THEN 'excluded'
        WHEN doc_id % 2 = 0 AND NOT regexp_matches(title || ' ' || body, '(?i)\\bwhich\\b.{0,30}\\bthe\\b')
         AND NOT regexp_matches(title || ' ' || body, '(?i)\\bdans\\b') THEN 'filtered' ELSE 'kept' END AS outcome, count(*) AS items
      FROM items GROUP BY ALL""",
    "intake_drops": ITEMS
    + """ SELECT CASE WHEN doc_id % 11 IN (0, 2) OR (trim(title) = '' AND doc_id % 11 NOT IN (1, 3)) THEN 'no-title' WHEN doc_id % 11 = 4 THEN 'no-url'
        WHEN doc_id % 11 IN (1, 3) THEN 'below-threshold'
        WHEN regexp_matches(title, '(?i)\\b(correction|erratum|retraction|book review|obituary|correspondence)\\b') THEN 'below-threshold'
        ELSE 'kept' END AS outcome, count(*) AS items FROM items GROUP BY ALL""",
    "news_ranked": _RANK
    + " SELECT doc_id, primary_lane, score, coalesce(drop_reason, 'kept') AS outcome, penalties FROM final",
    "news_drop_accounting": _RANK
    + " SELECT drop_reason, count(*) AS dropped FROM final WHERE drop_reason IS NOT NULL GROUP BY drop_reason",
    "topk_per_lane": _RANK
    + """ SELECT item_id, primary_lane, score, CASE WHEN primary_lane = 'deadlines' THEN 0 ELSE
        row_number() OVER (PARTITION BY primary_lane ORDER BY score DESC, item_id) END AS rank
      FROM final WHERE drop_reason IS NULL QUALIFY rank <= 6""",
    "over_cap": _RANK
    + """ SELECT primary_lane, count(*) AS items, CASE WHEN primary_lane = 'deadlines' THEN 0 ELSE greatest(0, count(*) - 6) END AS over_cap
      FROM final WHERE drop_reason IS NULL GROUP BY primary_lane""",
    "news_daily_cap": _RANK
    + """ SELECT item_id, score, primary_lane FROM final WHERE drop_reason IS NULL ORDER BY score DESC, item_id LIMIT 42""",
    "hint_lanes": """SELECT CASE doc_id % 3 WHEN 0 THEN 'fellowships' WHEN 1 THEN 'conferences' ELSE 'causal-genetics' END AS lane,
        count(*) AS items FROM documents GROUP BY ALL""",
}
