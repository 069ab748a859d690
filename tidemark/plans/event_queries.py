"""Registered queries over dated events, the calendar table and raw bodies in vendor layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.common import instant
from tidemark.functions.pubdates import parse_press_date
from tidemark.operators import calendar as C
from tidemark.operators import events as E
from tidemark.operators.ranking import ranked
from tidemark.plans import fixtures as X
from tidemark.plans.text_queries import SQUISH
from tidemark.session import materialize
from tidemark.sources.boards import parse_boards
from tidemark.sources.calendars import parse_calendars
from tidemark.sources.collect import collected_items as collected
from tidemark.sources.dims import sources
from tidemark.sources.feeds import parse_feeds

TICKERS = "array('VRTX', 'A', 'FDA', 'ILMN', 'abc', 'ZZZZ', 'NTRA', 'BRK.B')"
PHRASES = "array(' PDUFA', ' AdComm', ' advisory committee', ' FDA PDUFA', '')"
ENTRY = (
    "o_orderkey AS key",
    "concat('ev', CAST(o_orderkey AS STRING)) AS uid",
    f"CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE concat(element_at({TICKERS}, CAST(o_orderkey % 8 + 1 AS INT)), ' ', p_name, "
    f"element_at({PHRASES}, CAST(o_orderkey % 5 + 1 AS INT))) END AS summary",
    "CASE WHEN o_orderkey % 23 = 0 THEN 'soon' WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') "
    "WHEN o_orderkey % 3 = 1 THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T02:00:00Z') "
    "ELSE concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T09:30:00') END AS dtstart",
    "o_orderkey % 3 = 0 AS all_day",
    "CASE WHEN o_orderkey % 17 = 0 THEN 'CANCELLED' ELSE 'CONFIRMED' END AS status",
)


def _entries(spark, sf):
    """One entry per order, in one feed or in both."""
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = X.table(spark, sf, "part").select("p_partkey", "p_name")
    df = o.join(p, F.col("o_custkey") == F.col("p_partkey")).selectExpr(*ENTRY)
    feeds = (
        "inline(CASE WHEN key % 4 = 0 THEN array(named_struct('feed_id', 'pdufa', 'feed_rank', 0), named_struct('feed_id', 'adcomm', 'feed_rank', 1)) "
        "WHEN key % 2 = 0 THEN array(named_struct('feed_id', 'pdufa', 'feed_rank', 0)) "
        "ELSE array(named_struct('feed_id', 'adcomm', 'feed_rank', 1)) END)"
    )
    df = df.selectExpr("*", feeds)
    return df.withColumns({"feed_kind": F.col("feed_id"), "feed_name": F.concat(F.lit("Calendar "), "feed_id")})


def _resolved(spark, sf):
    return E.resolve_events(_entries(spark, sf), X.CLOCK.at)


def _upcoming(spark, sf):
    return E.dedupe_events(_resolved(spark, sf).filter("drop_reason IS NULL"))


def event_horizon(spark, sf):
    rows = _resolved(spark, sf).filter("drop_reason IS NULL")
    return rows.select(
        "feed_id", "uid", F.col("day").cast("string").alias("day"), F.coalesce("ticker", F.lit("")).alias("ticker"),
        F.coalesce("company", F.lit("")).alias("company"), "label", "kind", "watched", F.col("days_until").cast("long").alias("days_until"),
    )


def event_dedupe(spark, sf):
    return _upcoming(spark, sf).select("uid", "feed_id", F.col("day").cast("string").alias("day"), "kind", "label")


def watched_first(spark, sf):
    return E.shown_events(_upcoming(spark, sf)).select("watched", F.col("rank").cast("long").alias("rank"), "uid", "label")


def hidden_events(spark, sf):
    return E.hidden_events(_upcoming(spark, sf)).select("watched", "total", "hidden")


def event_lines(spark, sf):
    rows = _upcoming(spark, sf)
    return rows.select(
        "uid", E.event_title(F.col("ticker"), F.col("company"), F.col("label")).alias("title"),
        E.event_detail(F.col("day"), F.col("kind"), F.col("ticker"), F.col("company"), F.col("label")).alias("detail"),
    )


def feed_status(spark, sf):
    return E.feed_status(_resolved(spark, sf))


def unless_broken(spark, sf):
    """Events by month and feed; one feed was broken every third month, which hides the month's whole section."""
    rows = _resolved(spark, sf).withColumn("month", F.date_format("day", "yyyy-MM")).filter("drop_reason IS NULL")
    feeds = rows.select("month", "feed_id").distinct()
    broken = (F.col("feed_id") == "adcomm") & (F.right("month", F.lit(2)).cast("int") % 3 == 0)
    shown = E.unless_broken(rows, feeds.withColumn("status", F.when(broken, "failed").otherwise("ok")), ["month"])
    return shown.groupBy("month", "feed_id").agg(F.count("*").alias("events"))


def event_sources(spark, sf):
    rows = _upcoming(spark, sf)
    return E.provenance(rows.select("feed_name").distinct(), rows)


def calendar_events(spark, sf):
    rows = C.calendar_events(X.programs(spark, sf), X.CLOCK)
    return rows.select(
        "program_id", F.col("cycle_year").cast("long").alias("cycle_year"), F.coalesce("step_id", F.lit("deadline")).alias("step"),
        "summary", "precision", "placement", "event_status", "alarm", "gating", F.coalesce(F.col("end_day").cast("string"), F.lit("")).alias("end_day"),
        "description",
    )


def calendar_problems(spark, sf):
    return C.calendar_problems(C.calendar_events(X.programs(spark, sf), X.CLOCK))


def calendar_order(spark, sf):
    """Every row of the calendar with its place: by placement, then uid.

    What names an event and what orders it is written once: dealing out by ranges
    reads the rows twice, and would make every event twice.
    """
    events = C.calendar_events(X.programs(spark, sf), X.CLOCK).select("program_id", "cycle_year", "step_id", "placement", "uid")
    rows = ranked(materialize(events, "calendar"), [F.col("placement"), F.col("uid")])
    return rows.select("program_id", F.col("cycle_year").cast("long").alias("cycle_year"), F.coalesce("step_id", F.lit("deadline")).alias("step"), "rank")


def event_order(spark, sf):
    """Every upcoming event with its place: watched ones first, then by day, ticker and label."""
    return ranked(_upcoming(spark, sf), E.event_order()).select("uid", "feed_id", "rank")


ICS = (
    "concat('BEGIN:VCALENDAR\\r\\nVERSION:2.0\\r\\n', "
    "'BEGIN:VEVENT\\r\\nUID:a', k, '\\r\\nDTSTART;VALUE=DATE:', ymd, '\\r\\nSUMMARY:First\\\\, ', nm, '\\r\\n  folded\\r\\n"
    "BEGIN:VALARM\\r\\nACTION:DISPLAY\\r\\nDESCRIPTION:no\\r\\nSUMMARY:alarm\\r\\nEND:VALARM\\r\\nEND:VEVENT\\r\\n', "
    "'BEGIN:VEVENT\\nUID:b', k, '\\nDTSTART;TZID=Europe/London:', ymd, 'T120000\\nSUMMARY:Second ', nm, '\\nSTATUS:cancelled\\nEND:VEVENT\\n', "
    "'BEGIN:VEVENT\\nUID:c', k, '\\nDTSTART:', ymd, 'T233000Z\\nSUMMARY:Third\\nEND:VEVENT\\n', "
    "'BEGIN:VEVENT\\nUID:d', k, '\\nDTSTART:19980231\\nSUMMARY:Impossible\\nEND:VEVENT\\n', "
    "'BEGIN:VEVENT\\nUID:e', k, '\\nDTSTART:', ymd, 'T080000\\nSUMMARY:Floating\\nEND:VEVENT\\nEND:VCALENDAR\\n') AS body"
)


def calendar_bodies(spark, sf):
    """Five entries per order as calendar text: folded, zoned, in UTC, impossible, floating."""
    o = X.table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS k", "date_format(o_orderdate, 'yyyyMMdd') AS ymd", "o_orderpriority AS nm"
    )
    rows = parse_calendars(o.selectExpr("k", ICS), ["k"])
    return rows.select("k", "uid", "summary", "dtstart", "all_day", F.coalesce("status", F.lit("")).alias("status"))


BOARD = (
    "doc_id", "source AS source_id",
    "element_at(array('greenhouse', 'lever', 'ashby'), CAST(doc_id % 3 + 1 AS INT)) AS vendor", "'Acme' AS company", "200 AS max_items",
    """CASE WHEN doc_id % 31 = 30 THEN 'not json' WHEN doc_id % 3 = 0 THEN to_json(named_struct('jobs', array(named_struct('id', doc_id,
        'title', concat(' Role  ', CAST(doc_id AS STRING)), 'absolute_url', concat('https://jobs.example.org/', CAST(doc_id AS STRING), '/?utm_source=x'),
        'content', concat('&lt;p&gt;', replace(replace(replace(text, '&', '&amp;amp;'), '<', '&amp;lt;'), '>', '&amp;gt;'), '&lt;/p&gt;'),
        'updated_at', '2024-03-01T10:00:00Z', 'location', named_struct('name', concat('City ', lang))))))
      WHEN doc_id % 3 = 1 THEN to_json(array(named_struct('id', CAST(doc_id AS STRING), 'text', concat('Role ', CAST(doc_id AS STRING)),
        'hostedUrl', concat('https://jobs.example.org/', CAST(doc_id AS STRING)), 'createdAt', CASE WHEN doc_id % 2 = 0 THEN 0D ELSE 1709287200000D END,
        'descriptionPlain', text, 'categories', named_struct('team', CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Lab' END, 'location', lang))))
      ELSE to_json(named_struct('jobs', array(named_struct('id', CAST(doc_id AS STRING), 'title', concat('Role ', CAST(doc_id AS STRING)),
        'jobUrl', concat('https://jobs.example.org/', CAST(doc_id AS STRING)), 'location', lang, 'publishedAt', '2024-03-01T10:00:00.000Z',
        'descriptionPlain', text, 'isListed', doc_id % 2 = 0)))) END AS body""",
)


def board_items(spark, sf):
    """A board response per document, in three layouts; whole bodies."""
    bodies = X.table(spark, sf, "documents").selectExpr(*BOARD)
    rows = parse_boards(bodies, body_cap=None)
    return rows.select(
        "vendor", "outcome", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("canonical_url", F.lit("")).alias("url"),
        F.coalesce("company", F.lit("")).alias("company"), F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("published"),
        F.length(F.coalesce("body", F.lit(""))).cast("long").alias("chars"), F.left(F.sha2(F.coalesce("body", F.lit("")), 256), F.lit(16)).alias("digest"),
    )


# as HTML, and that as XML
_HTML = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ESCAPED = f"replace(replace(replace({_HTML}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
FEED_XML = (
    "doc_id", "source AS source_id", "'news' AS source_kind", "false AS paywalled",
    "CASE WHEN doc_id % 2 = 0 THEN 'fierce' END AS date_style", "'UTC' AS time_zone", "40 AS max_items",
    f"""CASE WHEN doc_id % 37 = 36 THEN 'no markup here' ELSE concat('<?xml version="1.0"?><rss><channel><title>c</title><item>',
      '<title>', CASE WHEN doc_id % 3 = 0 THEN 'STAT+: ' ELSE '' END, '&lt;b&gt;Story&lt;/b&gt; ', CAST(doc_id AS STRING), '</title>',
      '<link>https://feed.example.org/', CAST(doc_id AS STRING), '/?rss=1</link><guid>g', CAST(doc_id AS STRING), '</guid>',
      '<pubDate>', CASE WHEN doc_id % 2 = 0 THEN 'Jan 15, 2024 8:30am' ELSE 'Mon, 15 Jan 2024 08:30:00 GMT' END, '</pubDate>',
      '<description>', {ESCAPED}, '</description></item></channel></rss>') END AS body""",
)


def feed_items(spark, sf):
    """A feed response per document; whole bodies."""
    bodies = X.table(spark, sf, "documents").selectExpr(*FEED_XML)
    rows = parse_feeds(bodies, instant("2024-02-01 00:00:00"), body_cap=None)
    return rows.select(
        "outcome", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("canonical_url", F.lit("")).alias("url"),
        F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("published"),
        F.coalesce("paywalled", F.lit(False)).alias("paywalled"), F.coalesce("body_provenance", F.lit("none")).alias("provenance"),
        F.left(F.sha2(F.coalesce("body", F.lit("")), 256), F.lit(16)).alias("digest"),
    )


_N = "CAST(doc_id AS STRING)"
# three layouts in turn, three entries each: whole, with markup and another choice of fields, and incomplete
FEED_KINDS = (
    "doc_id", "source AS source_id", "'news' AS source_kind", "false AS paywalled", "CAST(NULL AS STRING) AS date_style", "'UTC' AS time_zone",
    "CAST(NULL AS INT) AS max_items",
    f"""CASE doc_id % 3 WHEN 0 THEN concat('<?xml version="1.0"?><!-- a --><feed xmlns="http://www.w3.org/2005/Atom"><title>c</title>',
        '<entry><title type="html">&lt;b&gt;Story&lt;/b&gt; ', {_N}, '</title><link rel="self" href="https://feed.example.org/self/', {_N},
        '"/><link rel="alternate" href="https://feed.example.org/', {_N}, '/?rss=1"/><id>tag:', {_N}, '</id><published>2024-01-15T08:30:00Z</published>',
        '<updated>2024-01-16T08:30:00Z</updated><author><name>Ann ', {_N}, '</name></author><author><name>Bo</name></author><category term="alpha"/>',
        '<category term="beta"/><content type="html">', {ESCAPED}, '</content></entry><entry><title>Mine: <a href="x">linked</a> ', {_N},
        '</title><link rel="related" href="https://feed.example.org/b/', {_N}, '"/><updated>2024-01-17T10:00:00Z</updated><summary>Short</summary></entry>',
        '<entry><title>Nowhere</title></entry></feed>')
      WHEN 1 THEN concat('<rdf:RDF xmlns:rdf="r"><channel rdf:about="c"><title>c</title></channel><item rdf:about="i"><title>Story ', {_N},
        '</title><link>https://feed.example.org/', {_N}, '</link><dc:date>2024-01-15T08:30:00Z</dc:date><dc:creator><a href="y">Cy ', {_N},
        '</a></dc:creator><prism:doi>10.1000/x', {_N}, '</prism:doi><description>', {ESCAPED}, '</description></item><item><title>Mine: <a href="x">linked</a> ',
        {_N}, '</title><link>https://feed.example.org/b/', {_N}, '</link><prism:publicationDate>2024-01-17T10:00:00Z</prism:publicationDate>',
        '<description>Short</description></item><item><link>https://feed.example.org/c</link></item></rdf:RDF>')
      ELSE CASE WHEN doc_id % 4 = 0 THEN '<rss><channel><title>c</title></channel></rss>' WHEN doc_id % 4 = 1 THEN '<html><body>gone</body></html>'
        ELSE concat('<rss><channel><item><title>Story ', {_N}, '</title><link>https://feed.example.org/', {_N}, '</link><guid>g', {_N},
        '</guid><pubDate>Mon, 15 Jan 2024 08:30:00 GMT</pubDate><dc:creator>Di</dc:creator><category>alpha</category><category></category><category>beta</category>',
        '<description>', {ESCAPED}, '</description></item><item><title>Mine: <a href="x">linked</a> ', {_N}, '</title><link>https://feed.example.org/b/', {_N},
        '</link><dc:date>2024-01-17T10:00:00Z</dc:date><description>Short</description></item><item/></channel></rss>') END END AS body""",
)


def feed_kinds(spark, sf):
    """Atom, RDF and RSS bodies of several entries, all fields; whole bodies."""
    rows = parse_feeds(X.table(spark, sf, "documents").selectExpr(*FEED_KINDS), instant("2024-02-01 00:00:00"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.groupBy(
        "outcome", text("title").alias("title"), text("canonical_url").alias("url"), text("guid").alias("guid"),
        text(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")).alias("published"), text("body_provenance").alias("provenance"),
        F.left(F.sha2(text("body"), 256), F.lit(16)).alias("digest"), text(F.array_join("categories", "|")).alias("categories"),
        text(F.array_join("authors", "|")).alias("authors"), text("doi").alias("doi"),
    ).agg(F.count("*").alias("entries"))


# four documents to a body, feeds and boards in turn; the fourth entry is over the cap
COLLECTED = """
WITH g AS (
  SELECT div(doc_id, 4) AS b, array_sort(collect_list(struct(doc_id, text))) AS d FROM documents GROUP BY div(doc_id, 4)
)
SELECT CASE WHEN b % 2 = 0 THEN concat('feed', b % 7) ELSE concat('board', b % 5) END AS source_id, 'news' AS source_kind,
  false AS paywalled, CAST(NULL AS STRING) AS date_style, 'UTC' AS time_zone, 3 AS max_items, b % 2 = 0 AS feed, 'lever' AS vendor, 'Acme' AS company,
  CASE WHEN b % 2 = 0 THEN concat('<rss><channel><title>c</title>', array_join(transform(d, x -> concat('<item><title>Item ', x.doc_id,
      '</title><link>https://feed.example.org/', x.doc_id, '</link><pubDate>Mon, 15 Jan 2024 08:30:00 GMT</pubDate><description>',
      {escaped}, '</description></item>')), ''), '</channel></rss>')
    ELSE to_json(transform(d, x -> named_struct('id', CAST(x.doc_id AS STRING), 'text', concat('Item ', x.doc_id), 'hostedUrl',
      concat('https://jobs.example.org/', x.doc_id), 'createdAt', 1709287200000D, 'descriptionPlain', x.text))) END AS body
FROM g"""


def collected_items(spark, sf):
    """Bodies of several entries each, through parsing, caps and the join with their sources."""
    X.table(spark, sf, "documents").createOrReplaceTempView("collected_documents")
    query = COLLECTED.replace("{escaped}", ESCAPED.replace("(text,", "(x.text,")).replace("FROM documents", "FROM collected_documents")
    bodies = spark.sql(query)
    rows = [{"source_id": f"feed{i}", "authority": 0.1 * i, "publisher_group": f"p{i % 3}"} for i in range(6)]
    rows += [{"source_id": f"board{i}", "authority": 0.6, "publisher_group": "jobs"} for i in range(4)]
    feeds = parse_feeds(bodies.filter("feed"), instant("2024-02-01 00:00:00"))
    items = collected(feeds, parse_boards(bodies.filter("NOT feed")), sources(spark, rows))
    return items.select(
        "source_id", F.col("pos").cast("long").alias("pos"), "title", F.col("canonical_url").alias("url"), "outcome",
        F.coalesce("publisher_group", F.lit("")).alias("publisher_group"), F.coalesce("authority", F.lit(-1.0)).alias("authority"),
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), F.left(F.sha2("body", 256), F.lit(16)).alias("digest"),
    )


def press_dates(spark, sf):
    e = X.table(spark, sf, "events").selectExpr("event_id", "date_format(ts, 'MMMM d, yyyy h:mma') AS raw")
    at = parse_press_date(F.lower("raw"), F.lit("America/New_York"))
    return e.select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at_utc"))


QUERIES = {
    f.__name__: f
    for f in (
        event_horizon, event_dedupe, watched_first, hidden_events, event_lines, feed_status, unless_broken, event_sources,
        calendar_events, calendar_problems, calendar_order, event_order, calendar_bodies, board_items, feed_items, feed_kinds, collected_items, press_dates,
    )
}

_TODAY_NY = "DATE '1998-06-15'"
_ENTRIES = f"""
WITH base AS (
  SELECT o_orderkey AS key, 'ev' || CAST(o_orderkey AS VARCHAR) AS uid, CAST(o_orderdate AS DATE) AS od, p_name,
    ['VRTX', 'A', 'FDA', 'ILMN', 'abc', 'ZZZZ', 'NTRA', 'BRK.B'][o_orderkey % 8 + 1] AS tk,
    [' PDUFA', ' AdComm', ' advisory committee', ' FDA PDUFA', ''][o_orderkey % 5 + 1] AS phrase
  FROM orders JOIN part ON o_custkey = p_partkey
),
fed AS (
  SELECT *, 'pdufa' AS feed_id, 0 AS feed_rank FROM base WHERE key % 2 = 0
  UNION ALL SELECT *, 'adcomm', 1 FROM base WHERE key % 4 = 0 OR key % 2 = 1
),
r AS (
  SELECT *, CASE WHEN key % 3 = 1 THEN od - 1 ELSE od END AS day,
    CASE WHEN tk IN ('VRTX', 'ILMN', 'ZZZZ', 'NTRA', 'BRK.B') THEN tk END AS ticker,
    CASE WHEN tk IN ('VRTX', 'ILMN', 'ZZZZ', 'NTRA', 'BRK.B') THEN p_name ELSE tk || ' ' || p_name END AS company,
    CASE WHEN tk IN ('VRTX', 'ILMN', 'ZZZZ', 'NTRA', 'BRK.B') THEN p_name || phrase ELSE tk || ' ' || p_name || phrase END AS label,
    CASE WHEN key % 5 IN (1, 2) THEN 'adcomm' WHEN key % 5 IN (0, 3) THEN 'pdufa' ELSE feed_id END AS kind,
    tk IN ('VRTX', 'ILMN', 'NTRA') AS watched
  FROM fed
),
resolved AS (
  SELECT *, date_diff('day', {_TODAY_NY}, day) AS days_until,
    CASE WHEN key % 17 = 0 THEN 'cancelled' WHEN key % 19 = 0 THEN 'untitled' WHEN key % 23 = 0 THEN 'undated'
         WHEN date_diff('day', {_TODAY_NY}, day) NOT BETWEEN 0 AND 365 THEN 'outside-horizon' END AS drop_reason
  FROM r
),
upcoming AS (
  SELECT * FROM resolved WHERE drop_reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY day, kind, coalesce(ticker, label) ORDER BY feed_rank, label, uid) = 1
)"""
_QUOTED = lambda text: text.replace("'", "''")
_CAL = (
    "WITH "
    + X.SQL_OBLIGATIONS
    + ","
    + X.SQL_STEPS
    + f""",
live AS (
  SELECT * FROM obligations WHERE status <> 'ruled-out'
    AND NOT (status = 'watch' AND CAST(timezone(time_zone, TIMESTAMPTZ '{X.AS_OF}+00') AS DATE) < watch_from)
),
cyc AS (
  SELECT l.*, CAST(due + INTERVAL (shift) MONTH AS DATE) AS cdue FROM live l, (VALUES (-12), (0), (12)) s(shift)
),
gate AS (
  SELECT c.*, pos, s.done, cdue - 7 * pos AS sdue FROM cyc c JOIN steps s USING (key) WHERE gating AND NOT (pos = 1 AND key % 5 = 0)
),
rows AS (
  SELECT program_id, year(cdue) AS cycle_year, 's' || CAST(pos AS VARCHAR) AS step, label || ' — Step ' || CAST(pos AS VARCHAR) AS base,
    sdue AS d, 'day' AS precision, NOT done AS alarm, TRUE AS gating, kind IS NULL AND NOT confirmed AS projected, time_zone, NULL AS tod,
    CASE WHEN kind IS NULL AND NOT confirmed THEN cdue - 60 END AS again, url FROM gate
  UNION ALL
  SELECT program_id, year(cdue), 'deadline', label || ' — deadline', cdue,
    CASE WHEN precision = 'month' THEN 'month' WHEN time_of_day IS NULL THEN 'day' ELSE 'minute' END, TRUE, FALSE, NOT confirmed, time_zone, time_of_day,
    CASE WHEN NOT confirmed THEN cdue - 60 END, url
  FROM cyc WHERE kind IS NULL
),
timed AS (
  SELECT *, timezone(time_zone, CAST(d AS TIMESTAMP) + CASE WHEN tod IS NULL THEN INTERVAL '23 hours 59 minutes' ELSE INTERVAL '17 hours' END) AS inst FROM rows
),
offsets AS (
  SELECT *, timezone(time_zone, inst) AS here, timezone('America/New_York', inst) AS there,
    (epoch(timezone(time_zone, inst)) - epoch(timezone('UTC', inst))) / 60 AS off,
    (epoch(timezone('America/New_York', inst)) - epoch(timezone('UTC', inst))) / 60 AS noff FROM timed
),
named AS (
  SELECT *, CASE WHEN time_zone = 'America/New_York' THEN CASE WHEN off = -240 THEN 'EDT' ELSE 'EST' END
      WHEN time_zone = 'Europe/London' THEN CASE WHEN off = 60 THEN 'BST' ELSE 'GMT' END
      WHEN time_zone = 'Asia/Tokyo' THEN 'GMT+9' WHEN time_zone = 'Asia/Kolkata' THEN 'GMT+5:30' ELSE 'GMT+3' END AS z,
    CASE WHEN noff = -240 THEN 'EDT' ELSE 'EST' END AS nz FROM offsets
),
shown AS (
  SELECT program_id, cycle_year, step,
    CASE WHEN projected THEN '[projected] ' ELSE '' END || base || CASE WHEN precision = 'month' THEN ' (day unknown — verify)' ELSE '' END AS summary,
    precision, CASE precision WHEN 'minute' THEN strftime(timezone('UTC', inst), '%Y%m%dT%H%M%SZ')
      WHEN 'month' THEN strftime(date_trunc('month', d), '%Y%m%d') ELSE strftime(d, '%Y%m%d') END AS placement,
    CASE WHEN projected OR precision = 'month' THEN 'TENTATIVE' ELSE 'CONFIRMED' END AS event_status, alarm, gating,
    CASE precision WHEN 'minute' THEN '' WHEN 'month' THEN CAST(CAST(date_trunc('month', d) AS DATE) + 1 AS VARCHAR) ELSE CAST(d + 1 AS VARCHAR) END AS end_day,
    concat_ws(chr(10) || chr(10),
      'Closes ' || CASE WHEN precision = 'month' THEN strftime(here, '%B %Y') || ' (day unknown)'
        WHEN precision = 'day' AND time_zone = 'America/New_York' THEN strftime(here, '%-d %b %Y')
        WHEN precision = 'day' THEN strftime(here, '%-d %b %Y') || ' (' || replace(split_part(time_zone, '/', 2), '_', ' ') || ' time)'
        WHEN time_zone = 'America/New_York' THEN strftime(here, '%-d %b %Y, %H:%M') || ' ' || z
        ELSE strftime(here, '%-d %b %Y, %H:%M') || ' ' || z || ' (' || strftime(there, '%H:%M') || ' ' || nz || ')' END,
      CASE WHEN precision = 'month' THEN '{_QUOTED(C.DAY_UNKNOWN)}' WHEN projected THEN '{_QUOTED(C.PROJECTED)}' END,
      'Cycle ' || CAST(cycle_year AS VARCHAR), 'Re-confirm by ' || CAST(again AS VARCHAR), url,
      'From the registry (' || program_id || ') — the registry is the source of truth.') AS description
  FROM named
)"""
)
_DISPLAY = "days_until, day, coalesce(ticker, label), label, uid"

ORACLES = {
    "event_horizon": _ENTRIES
    + """ SELECT feed_id, uid, CAST(day AS VARCHAR) AS day, coalesce(ticker, '') AS ticker, company, label, kind, watched, days_until
      FROM resolved WHERE drop_reason IS NULL""",
    "event_dedupe": _ENTRIES + " SELECT uid, feed_id, CAST(day AS VARCHAR) AS day, kind, label FROM upcoming",
    "watched_first": _ENTRIES
    + f""" SELECT watched, row_number() OVER (PARTITION BY watched ORDER BY {_DISPLAY}) AS rank, uid, label FROM upcoming
      QUALIFY rank <= CASE WHEN watched THEN 12 ELSE 8 END""",
    "hidden_events": _ENTRIES
    + """ SELECT watched, count(*) AS total, greatest(0, count(*) - CASE WHEN watched THEN 12 ELSE 8 END) AS hidden
      FROM upcoming GROUP BY watched""",
    "event_lines": _ENTRIES
    + """ SELECT uid, concat_ws(' — ', ticker, company) AS title,
        concat_ws(' · ', CAST(day AS VARCHAR), CASE kind WHEN 'pdufa' THEN 'PDUFA' ELSE 'AdCom' END,
          CASE WHEN NOT contains(lower(concat_ws(' ', ticker, company)), lower(label)) AND NOT contains(lower(label), lower(concat_ws(' ', ticker, company))) THEN label END) AS detail
      FROM upcoming""",
    "feed_status": _ENTRIES
    + """ SELECT feed_id, count(*) AS parsed, count(*) FILTER (WHERE drop_reason IS NULL) AS kept,
        count(*) FILTER (WHERE drop_reason = 'cancelled') AS cancelled, count(*) FILTER (WHERE drop_reason = 'untitled') AS untitled,
        count(*) FILTER (WHERE drop_reason = 'undated') AS undated, 'ok' AS status FROM resolved GROUP BY feed_id""",
    "unless_broken": _ENTRIES
    + """, m AS (SELECT strftime(day, '%Y-%m') AS month, feed_id, count(*) AS events FROM resolved WHERE drop_reason IS NULL GROUP BY ALL)
      SELECT * FROM m WHERE month NOT IN (SELECT month FROM m WHERE feed_id = 'adcomm' AND CAST(right(month, 2) AS INTEGER) % 3 = 0)""",
    "event_sources": "SELECT 'Calendar adcomm + Calendar pdufa' AS sources FROM orders LIMIT 1",
    "calendar_events": _CAL + " SELECT * FROM shown",
    "calendar_problems": _CAL
    + """ SELECT 'duplicate-uid' AS rule, program_id AS key, CAST(count(*) AS VARCHAR) AS detail FROM shown
      GROUP BY program_id, cycle_year, step HAVING count(*) > 1""",
    "calendar_order": _CAL
    + """ SELECT program_id, cycle_year, step, row_number() OVER (ORDER BY placement, program_id || '-' || CAST(cycle_year AS VARCHAR) || '-' || step || '-'
        || left(sha256(program_id || '|' || CAST(cycle_year AS VARCHAR) || '|' || CASE WHEN step = 'deadline' THEN '' ELSE step END), 8) || '@tidemark') AS rank FROM shown""",
    "event_order": _ENTRIES
    + " SELECT uid, feed_id, row_number() OVER (ORDER BY watched DESC, day, coalesce(ticker, ''), label, uid, feed_id) AS rank FROM upcoming",
    "calendar_bodies": """
      WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS nm FROM orders)
      SELECT k, 'a' || k AS uid, 'First, ' || nm || ' folded' AS summary, CAST(d AS VARCHAR) AS dtstart, TRUE AS all_day, '' AS status FROM o
      UNION ALL SELECT k, 'b' || k, 'Second ' || nm, strftime(timezone('UTC', timezone('Europe/London', CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR)), '%Y-%m-%dT%H:%M:%SZ'), FALSE, 'CANCELLED' FROM o
      UNION ALL SELECT k, 'c' || k, 'Third', CAST(d AS VARCHAR) || 'T23:30:00Z', FALSE, '' FROM o
      UNION ALL SELECT k, 'e' || k, 'Floating', CAST(d AS VARCHAR) || 'T08:00:00', FALSE, '' FROM o""",
    "board_items": f"""
      WITH d AS (SELECT doc_id, lang, doc_id % 3 AS m, ['greenhouse', 'lever', 'ashby'][doc_id % 3 + 1] AS vendor, doc_id % 31 = 30 AS bad, CAST(doc_id AS VARCHAR) AS k,
          CASE WHEN doc_id % 31 = 30 THEN '' WHEN doc_id % 3 = 0 THEN {SQUISH("text")}
               WHEN doc_id % 3 = 1 THEN text ELSE {SQUISH("text")} END AS body FROM documents)
      SELECT vendor, CASE WHEN bad THEN 'unparseable' WHEN m = 2 AND doc_id % 2 = 1 THEN 'unlisted' ELSE 'kept' END AS outcome,
        CASE WHEN bad THEN '' ELSE 'Role ' || k END AS title, CASE WHEN bad THEN '' ELSE 'https://jobs.example.org/' || k END AS url,
        CASE WHEN bad THEN '' WHEN m = 1 AND doc_id % 4 <> 0 THEN 'Lab' ELSE 'Acme' END AS company,
        CASE WHEN bad THEN '' WHEN m = 0 THEN 'City ' || lang ELSE lang END AS location,
        CASE WHEN bad THEN '' WHEN m = 1 AND doc_id % 2 = 0 THEN '' ELSE '2024-03-01 10:00:00' END AS published,
        length(body) AS chars, left(sha256(body), 16) AS digest FROM d""",
    "feed_items": f"""
      WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, doc_id % 37 = 36 AS bad,
          CASE WHEN doc_id % 37 = 36 THEN '' ELSE {SQUISH("text")} END AS body FROM documents)
      SELECT CASE WHEN bad THEN 'unparseable' ELSE 'kept' END AS outcome, CASE WHEN bad THEN '' ELSE 'Story ' || k END AS title,
        CASE WHEN bad THEN '' ELSE 'https://feed.example.org/' || k END AS url,
        CASE WHEN bad THEN '' WHEN doc_id % 2 = 0 THEN '2024-01-15 13:30:00' ELSE '2024-01-15 08:30:00' END AS published,
        NOT bad AND doc_id % 3 = 0 AS paywalled,
        CASE WHEN length(body) = 0 THEN 'none' WHEN length(body) >= 400 THEN 'description' ELSE 'dek' END AS provenance,
        left(sha256(body), 16) AS digest FROM d""",
    "feed_kinds": f"""
      WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, doc_id % 3 AS m, {SQUISH("text")} AS body,
          CASE WHEN doc_id % 3 < 2 OR doc_id % 4 > 1 THEN 'kept' WHEN doc_id % 4 = 0 THEN 'empty' ELSE 'unparseable' END AS outcome FROM documents),
      e AS (
        SELECT outcome, 'Story ' || k AS title, 'https://feed.example.org/' || k AS url, CASE m WHEN 0 THEN 'tag:' || k WHEN 1 THEN '' ELSE 'g' || k END AS guid,
          '2024-01-15 08:30:00' AS published, body, CASE m WHEN 1 THEN '' ELSE 'alpha|beta' END AS categories,
          CASE m WHEN 0 THEN 'Ann ' || k || '|Bo' WHEN 1 THEN 'Cy ' || k ELSE 'Di' END AS authors, CASE m WHEN 1 THEN '10.1000/x' || k ELSE '' END AS doi
        FROM d WHERE outcome = 'kept'
        UNION ALL SELECT outcome, 'Mine: linked ' || k, 'https://feed.example.org/b/' || k, '', '2024-01-17 10:00:00', 'Short', '', '', '' FROM d WHERE outcome = 'kept'
        UNION ALL SELECT 'incomplete', CASE m WHEN 0 THEN 'Nowhere' ELSE '' END, CASE m WHEN 1 THEN 'https://feed.example.org/c' ELSE '' END, '', '', '', '', '', '' FROM d WHERE outcome = 'kept'
        UNION ALL SELECT outcome, '', '', '', '', '', '', '', '' FROM d WHERE outcome <> 'kept')
      SELECT outcome, title, url, guid, published, CASE WHEN length(body) = 0 THEN 'none' WHEN length(body) >= 400 THEN 'description' ELSE 'dek' END AS provenance,
        left(sha256(body), 16) AS digest, categories, authors, doi, count(*) AS entries FROM e GROUP BY ALL""",
    "collected_items": f"""
      WITH d AS (SELECT doc_id, doc_id // 4 AS b, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) - 1 AS pos, text FROM documents),
      s AS (SELECT *, b % 2 = 0 AS feed, CASE WHEN b % 2 = 0 THEN b % 7 ELSE b % 5 END AS k FROM d)
      SELECT CASE WHEN feed THEN 'feed' ELSE 'board' END || k AS source_id, pos, 'Item ' || doc_id AS title,
        CASE WHEN feed THEN 'https://feed.example.org/' ELSE 'https://jobs.example.org/' END || doc_id AS url,
        CASE WHEN pos >= 3 THEN 'over-cap' WHEN (feed AND k = 6) OR (NOT feed AND k = 4) THEN 'unknown-source' ELSE 'kept' END AS outcome,
        CASE WHEN (feed AND k = 6) OR (NOT feed AND k = 4) THEN '' WHEN feed THEN 'p' || (k % 3) ELSE 'jobs' END AS publisher_group,
        CASE WHEN (feed AND k = 6) OR (NOT feed AND k = 4) THEN -1.0::DOUBLE WHEN feed THEN 0.1::DOUBLE * k ELSE 0.6::DOUBLE END AS authority,
        CASE WHEN feed THEN '2024-01-15 08:30:00' ELSE '2024-03-01 10:00:00' END AS published,
        left(sha256(CASE WHEN feed THEN {SQUISH("text")} ELSE text END), 16) AS digest FROM s""",
    "press_dates": """SELECT event_id, strftime(timezone('UTC', timezone('America/New_York', date_trunc('minute', ts))), '%Y-%m-%d %H:%M:%S') AS at_utc FROM events""",
}
