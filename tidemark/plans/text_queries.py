"""Registered queries over text: addresses, markup, dates, keys, sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import NAMED_ENTITIES, TOKEN_STOPWORDS
from tidemark.functions import pubdates as P
from tidemark.functions import text as T
from tidemark.functions.common import instant, stage
from tidemark.functions.html import clean_title, html_to_text, is_boilerplate_line, normalize_page, strip_journal_prefix
from tidemark.functions.ids import cluster_id, item_id, short_hash
from tidemark.functions.urls import canonical_url, extract_doi, extract_trial_ids, host_of
from tidemark.operators.similarity import near_duplicates
from tidemark.plans import fixtures as X

VARIANTS = (
    "array(url, concat(url, CASE WHEN instr(url, '?') > 0 THEN '&' ELSE '?' END, 'utm_source=rss&b=2&a=1'), "
    "concat(split_part(url, '#', 1), '#frag'))"
)


def url_variants(spark, sf):
    return X.table(spark, sf, "pages").selectExpr("page_id", f"posexplode({VARIANTS}) AS (variant, url)")


def canonical_urls(spark, sf):
    df = url_variants(spark, sf)
    return df.select(
        "page_id", F.col("variant").cast("long").alias("variant"), canonical_url(F.col("url")).alias("canonical"),
        host_of(F.col("url")).alias("host"),
    )


def item_ids(spark, sf):
    df = url_variants(spark, sf).select("page_id", "variant", canonical_url(F.col("url")).alias("c"))
    ids = df.select("page_id", item_id(F.col("c")).alias("item_id"))
    return ids.groupBy("item_id").agg(F.count("*").alias("copies"), F.min("page_id").alias("page_id"))


def cluster_ids(spark, sf):
    df = url_variants(spark, sf).select("page_id", item_id(F.col("url")).alias("i"))
    return df.groupBy("page_id").agg(cluster_id(F.collect_set("i")).alias("cluster"))


def html_text(spark, sf):
    p = X.table(spark, sf, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))
    return p.select("page_id", F.length("text").cast("long").alias("chars"), short_hash(F.col("text"), 16).alias("digest"))


def page_titles(spark, sf):
    raw = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return X.table(spark, sf, "pages").select("page_id", clean_title(raw).alias("title"))


def page_hash(spark, sf):
    p = X.table(spark, sf, "pages").select("page_id", normalize_page(F.col("html")).alias("t"))
    return p.select("page_id", short_hash(F.col("t"), 16).alias("hash"), F.length("t").cast("long").alias("length"))


def title_keys(spark, sf):
    return X.items(spark, sf).select("doc_id", T.title_key(F.col("title")).alias("title_key"))


def headlines(spark, sf):
    """Titles dressed as outlets dress them, and back again."""
    title = F.concat(F.lit("STAT+: "), F.col("title"), F.lit(" & more - Outlet "), F.col("source_id"))
    df = X.items(spark, sf).select("doc_id", title.alias("t"))
    return df.select("doc_id", T.normalize_title(F.col("t")).alias("headline"), T.paywall_prefix(F.col("t")).alias("paywalled"))


def sentence_split(spark, sf):
    df = stage(X.items(spark, sf).select("doc_id", "body"), {"s": T.sentences(F.col("body"))})
    keys = F.transform("s", T.sentence_key)
    return df.select(
        "doc_id", F.size("s").cast("long").alias("sentences"), short_hash(F.array_join("s", "|"), 16).alias("digest"),
        short_hash(F.array_join(keys, "|"), 16).alias("keys"),
    )


def first_sentences(spark, sf):
    df = X.items(spark, sf).select("doc_id", T.first_sentences(F.col("body"), 2).alias("s"))
    return df.select("doc_id", F.array_join("s", " | ").alias("digest"))


def content_tokens(spark, sf):
    df = X.items(spark, sf).select("doc_id", T.tokens(F.col("body")).alias("t"))
    return df.select("doc_id", F.size("t").cast("long").alias("tokens"), short_hash(F.array_join("t", " "), 16).alias("digest"))


def truncated(spark, sf):
    return X.items(spark, sf).select("doc_id", T.truncate_words(F.col("body"), 100).alias("short"))


def journal_text(spark, sf):
    """Abstracts as journals wrap them."""
    k = F.col("doc_id")
    wrapped = F.when(
        k % 3 == 0, F.concat(F.lit("Nature Aging, Published online: 03 August 2026; doi:10.1038/s"), k.cast("string"), F.lit("-x "), F.col("body"))
    ).otherwise(F.concat(F.lit("doi: 10.1016/j.cell."), k.cast("string"), F.lit(" "), F.col("body")))
    df = X.items(spark, sf).select("doc_id", wrapped.alias("w"))
    return df.select(
        "doc_id", extract_doi(F.col("w")).alias("doi"), short_hash(strip_journal_prefix(F.col("w")), 16).alias("digest"),
        F.array_join(extract_trial_ids(F.concat(F.lit("nct0"), F.lpad(k.cast("string"), 7, "0"), F.lit(" and NCT01234567, "), F.col("w"))), ",").alias("trials"),
    )


LAYOUTS = (
    "CASE event_id % 6 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") WHEN 1 THEN date_format(ts, 'yyyy-MM-dd') "
    "WHEN 2 THEN concat(date_format(ts, 'E, d MMM yyyy HH:mm:ss'), ' +0200') WHEN 3 THEN date_format(ts, 'MMM d, yyyy h:mma') "
    "WHEN 4 THEN date_format(ts, 'd MMMM yyyy') ELSE concat('around ', date_format(ts, 'yyyy')) END"
)
FEED_NOW = "2024-01-20 00:00:00"


def publication_dates(spark, sf):
    e = X.table(spark, sf, "events").selectExpr("event_id", f"{LAYOUTS} AS raw")
    df = stage(e, {"d": P.parse_feed_date(F.col("raw"), instant(FEED_NOW), F.lit("America/New_York"))})
    return df.select(
        "event_id", F.date_format("d.at", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("d.precision").alias("precision"),
        F.col("d.confident").alias("confident"),
        F.coalesce(F.split_part("d.warning", F.lit(":"), F.lit(1)), F.lit("")).alias("warning"),
    )


def iso_weeks(spark, sf):
    e = X.table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("t"))
    return e.groupBy(P.iso_week(F.col("t")).alias("week"), P.iso_week_start(F.col("t")).cast("string").alias("starts")).agg(
        F.count("*").alias("orders"), F.min(P.iso_day(F.col("t"), F.lit("Asia/Tokyo"))).alias("first_day")
    )


def item_age(spark, sf):
    return X.items(spark, sf).select(
        "doc_id", F.round(P.age_hours(F.col("published_at"), X.CLOCK.at), 4).alias("age_hours")
    )


def boilerplate_lines(spark, sf):
    line = F.explode(F.split(F.concat(F.lit("Subscribe now\n"), F.col("body")), "\n"))
    df = X.items(spark, sf).select("source_id", line.alias("line"))
    return df.groupBy("source_id").agg(F.count_if(is_boilerplate_line(F.col("line"))).alias("lines"))


def shingle_overlap(spark, sf):
    df = near_duplicates(X.items(spark, sf).select("doc_id", "title"), row_id="doc_id")
    return df.select(
        "doc_id", "representative", "members", F.round("jaccard", 6).alias("jaccard"), F.round("dice", 6).alias("dice")
    )


QUERIES = {
    f.__name__: f
    for f in (
        canonical_urls, item_ids, cluster_ids, html_text, page_titles, page_hash, title_keys, headlines, sentence_split,
        first_sentences, content_tokens, truncated, journal_text, publication_dates, iso_weeks, item_age,
        boilerplate_lines, shingle_overlap,
    )
}

WS = r"[\s\x{00a0}]+"
SPACE = " \n\r\t"
SQUISH = lambda e: f"trim(regexp_replace({e}, '{WS}', ' ', 'g'))"

SQL_VARIANTS = """
variants AS (
  SELECT page_id, variant, CASE variant WHEN 0 THEN url
    WHEN 1 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=rss&b=2&a=1'
    ELSE split_part(url, '#', 1) || '#frag' END AS url
  FROM pages, (VALUES (0), (1), (2)) v(variant)
),
parts AS (
  SELECT *, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme,
    lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host,
    regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
    regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query
  FROM variants
),
canon AS (
  SELECT page_id, variant, host, url,
    scheme || '://' || host || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END
    || coalesce('?' || nullif(array_to_string(list_transform(list_sort(list_transform(
         list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1),
           '^(utm_\\w+|ref|ref_src|source|campaign|rss|feed|fbclid|gclid|partner)$', 'i')),
         lambda p, i: {'k': split_part(p, '=', 1), 'i': i, 'p': CASE WHEN contains(p, '=') THEN p ELSE p || '=' END})),
       lambda s: s.p), '&'), ''), '') AS canonical
  FROM parts
)
"""


def _drop(expr: str, names: tuple[str, ...]) -> str:
    for n in names:
        expr = f"regexp_replace({expr}, '(?is)<{n}\\b[^>]*>.*?</{n}>', ' ', 'g')"
    return expr


def _decode(expr: str) -> str:
    """One pass over the entities; the ampersand last, so that a pass does not decode twice."""
    names = [n for n in NAMED_ENTITIES if n != "amp"] + ["amp"]
    for name in names:
        char = NAMED_ENTITIES[name].replace("'", "''")
        expr = f"replace({expr}, '&{name};', '{char}')"
    return expr


def _html_text(expr: str) -> str:
    text = f"CASE WHEN contains({expr}, '&lt;') OR contains({expr}, '&gt;') THEN {_decode(_decode(expr))} ELSE {expr} END"
    text = _drop(text, ("script", "style", "noscript", "iframe", "figure", "form", "svg"))
    text = f"regexp_replace({text}, '(?i)<(img|source|track|input|link|meta)\\b[^>]*/?>', ' ', 'g')"
    blocks = "p|div|br|li|ul|ol|h[1-6]|table|tr|td|th|section|article|figure|figcaption|blockquote|pre|hr|header|footer|aside|nav"
    text = f"regexp_replace({text}, '(?i)</?({blocks})\\b[^>]*>', ' ', 'g')"
    text = f"regexp_replace({text}, '<[^>]+>', '', 'g')"
    return SQUISH(_decode(_decode(text)))


_PAGE_TEXT = _drop("html", ("script", "style", "noscript", "svg", "nav", "footer", "header"))
_PAGE_TEXT = f"regexp_replace(regexp_replace({_PAGE_TEXT}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_PAGE_TEXT = f"regexp_replace(replace(replace({_PAGE_TEXT}, '&nbsp;', ' '), '&amp;', '&'), '&#\\d+;', ' ', 'g')"
_PAGE_TEXT = f"regexp_replace({_PAGE_TEXT}, '(?i)\\b\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?\\s*(am|pm)?\\b', ' ', 'g')"
PAGE_TEXT = f"lower({SQUISH(_PAGE_TEXT)})"

ITEMS = "WITH " + X.SQL_ITEMS
KEY = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), '\\s+'), lambda t: t <> '')[1:8], ' ')"
# a sentence ends at white space after ., ! or ?, or at a line break
SENTENCES = (
    "list_filter(list_transform(string_split(regexp_replace(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), "
    f"'\\n+', chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: length(s) >= 40)"
)
SENTENCE_KEY = lambda s: f"trim(regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g'))"
STOP = "['" + "', '".join(TOKEN_STOPWORDS) + "']"
TOKENS = lambda c: (
    f"list_filter(string_split(regexp_replace(strip_accents(lower({c})), '[^a-z0-9]+', ' ', 'g'), ' '), "
    f"lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"
)
_HEAD = "'STAT+: ' || title || ' & more - Outlet ' || source_id"

ORACLES = {
    "canonical_urls": "WITH " + SQL_VARIANTS + " SELECT page_id, variant, canonical, host FROM canon",
    "item_ids": "WITH "
    + SQL_VARIANTS
    + " SELECT left(sha256(canonical), 16) AS item_id, count(*) AS copies, min(page_id) AS page_id FROM canon GROUP BY canonical",
    "cluster_ids": "WITH "
    + SQL_VARIANTS
    + """ SELECT page_id, 'c_' || left(sha256(array_to_string(list_sort(list_distinct(list(left(sha256(canonical), 16)))), '|')), 10) AS cluster
      FROM (SELECT page_id, url AS canonical FROM variants) GROUP BY page_id""",
    "html_text": f"SELECT page_id, length(t) AS chars, left(sha256(t), 16) AS digest FROM (SELECT page_id, {_html_text('html')} AS t FROM pages)",
    "page_titles": f"""SELECT page_id, CASE WHEN regexp_matches(raw, '(?i)</?[a-z][^>]*>|&(lt|gt|amp|quot|apos|nbsp|#\\d+);')
        THEN {_html_text('raw')} ELSE raw END AS title
      FROM (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS raw FROM pages)""",
    "page_hash": f"SELECT page_id, left(sha256(t), 16) AS hash, length(t) AS length FROM (SELECT page_id, {PAGE_TEXT} AS t FROM pages)",
    "title_keys": ITEMS + f" SELECT doc_id, {KEY} AS title_key FROM items",
    "headlines": ITEMS
    + f""" SELECT doc_id, {SQUISH("replace(regexp_replace(regexp_replace(t, '^STAT[+]: ', ''), '\\s+[-–|]\\s+[^-–|]{2,40}$', ''), '&', ' and ')")} AS headline,
        TRUE AS paywalled FROM (SELECT doc_id, {_HEAD} AS t FROM items)""",
    "sentence_split": ITEMS
    + f""" SELECT doc_id, length(s) AS sentences, left(sha256(array_to_string(s, '|')), 16) AS digest,
        left(sha256(array_to_string(list_transform(s, lambda x: {SENTENCE_KEY("x")}), '|')), 16) AS keys
      FROM (SELECT doc_id, {SENTENCES} AS s FROM items)""",
    "first_sentences": ITEMS
    + """, found AS (
      SELECT doc_id, body, list_filter(list_transform(string_split(
          regexp_replace(body || ' ', '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
        lambda s: trim(regexp_extract(s, '[^.!?]+[.!?]+$', 0), ' ' || chr(10) || chr(13) || chr(9))), lambda s: length(s) >= 40) AS s FROM items)
      SELECT doc_id, CASE WHEN length(s) > 0 THEN array_to_string(s[1:2], ' | ')
        ELSE left(trim(body, ' ' || chr(10) || chr(13) || chr(9)), 240) END AS digest FROM found""",
    "content_tokens": ITEMS
    + f" SELECT doc_id, length(t) AS tokens, left(sha256(array_to_string(t, ' ')), 16) AS digest FROM (SELECT doc_id, {TOKENS('body')} AS t FROM items)",
    "truncated": ITEMS
    + """, heads AS (SELECT doc_id, body, left(body, 100) AS h FROM items),
      cut AS (SELECT *, CASE WHEN contains(h, ' ') THEN length(h) - length(regexp_extract(h, '([^ ]*)$', 1)) - 1 ELSE -1 END AS at FROM heads)
      SELECT doc_id, CASE WHEN length(body) <= 100 THEN body ELSE
        regexp_replace(CASE WHEN at > 60 THEN left(h, at) ELSE h END, '[\\s,;:.\\-–—]+$', '') || '…' END AS short FROM cut""".replace(
        " AS at ", " AS pos "
    ).replace("at > 60", "pos > 60").replace("left(h, at)", "left(h, pos)"),
    "journal_text": ITEMS
    + f""" SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '10.1038/s' || CAST(doc_id AS VARCHAR) || '-x' ELSE '10.1016/j.cell.' || CAST(doc_id AS VARCHAR) END AS doi,
        left(sha256({SQUISH("body")}), 16) AS digest,
        'NCT0' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || ',NCT01234567' AS trials FROM items""",
    "publication_dates": f"""
      WITH e AS (SELECT event_id, event_id % 6 AS m, ts FROM events),
      d AS (SELECT event_id, m, CASE m
          WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) + INTERVAL 12 HOUR
          WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 3 THEN date_trunc('minute', ts) + INTERVAL 5 HOUR
          WHEN 4 THEN date_trunc('day', ts) + INTERVAL 17 HOUR END AS t FROM e)
      SELECT event_id, strftime(CASE WHEN t > TIMESTAMP '{FEED_NOW}' + INTERVAL 36 HOUR THEN TIMESTAMP '{FEED_NOW}' + INTERVAL 36 HOUR ELSE t END, '%Y-%m-%d %H:%M:%S') AS at,
        CASE m WHEN 0 THEN 'second' WHEN 1 THEN 'day' WHEN 2 THEN 'second' WHEN 3 THEN 'minute' WHEN 4 THEN 'day' ELSE 'unknown' END AS precision,
        m < 5 AND t <= TIMESTAMP '{FEED_NOW}' + INTERVAL 36 HOUR AND t IS NOT NULL AS confident,
        CASE WHEN m = 5 THEN 'unparseable-date' WHEN t > TIMESTAMP '{FEED_NOW}' + INTERVAL 36 HOUR THEN 'future-date-clamped' ELSE '' END AS warning
      FROM d""".replace(" AS at,", " AS \"at\",").replace("m < 5 AND t <= TIMESTAMP", "m < 5 AND coalesce(t, TIMESTAMP '9999-01-01') <= TIMESTAMP"),
    "iso_weeks": """SELECT CAST(isoyear(o_orderdate) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS week,
        CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS starts, count(*) AS orders,
        strftime(min(o_orderdate + INTERVAL 9 HOUR), '%Y-%m-%d') AS first_day FROM orders GROUP BY ALL""",
    "item_age": ITEMS
    + f" SELECT doc_id, coalesce(round((epoch(TIMESTAMP '{X.AS_OF}') - epoch(published_at)) / 3600, 4), 720) AS age_hours FROM items",
    "boilerplate_lines": ITEMS
    + """ SELECT source_id, count(*) FILTER (WHERE regexp_matches(trim(line), '^(sign up|subscribe|read more|continue reading|follow us|share this|editor''?s note|this article|photo|image|credit|advertisement|©|all rights reserved|get the latest|listen to|watch:)', 'i')) AS lines
      FROM (SELECT source_id, unnest(string_split('Subscribe now' || chr(10) || body, chr(10))) AS line FROM items) GROUP BY source_id""",
    "shingle_overlap": ITEMS
    + f""", keyed AS (SELECT doc_id, title, {KEY} AS k FROM items),
      reps AS (SELECT k, min(doc_id) AS representative, arg_min(title, doc_id) AS rep, count(*) AS members FROM keyed GROUP BY k),
      norm AS (SELECT doc_id, representative, members,
          {SQUISH("replace(regexp_replace(title, '\\s+[-–|]\\s+[^-–|]{2,40}$', ''), '&', ' and ')")} AS a,
          {SQUISH("replace(regexp_replace(rep, '\\s+[-–|]\\s+[^-–|]{2,40}$', ''), '&', ' and ')")} AS b FROM keyed JOIN reps USING (k)),
      flat AS (SELECT doc_id, representative, members, array_to_string({TOKENS("a")}, ' ') AS a, array_to_string({TOKENS("b")}, ' ') AS b FROM norm),
      grams AS (SELECT doc_id, representative, members,
          list_distinct(list_transform(range(1, length(a) - 1), lambda i: substring(a, i, 3))) AS a,
          list_distinct(list_transform(range(1, length(b) - 1), lambda i: substring(b, i, 3))) AS b FROM flat),
      sized AS (SELECT *, length(a) AS na, length(b) AS nb, length(list_intersect(a, b)) AS n FROM grams)
      SELECT doc_id, representative, members,
        CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE round(n / (na + nb - n), 6) END AS jaccard,
        CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE round(2 * n / (na + nb), 6) END AS dice FROM sized""",
}
