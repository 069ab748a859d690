"""Registered queries over sources, pages and raw bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.common import day
from tidemark.operators import ledgers as L
from tidemark.operators import monitoring as M
from tidemark.operators import reports as R
from tidemark.plans import fixtures as X
from tidemark.plans.text_queries import PAGE_TEXT


def _today():
    return day(X.TODAY)


def _pages(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", "url", "html")


def _current(spark, sf):
    """Every page: some did not load, some are a bot wall."""
    df = _pages(spark, sf).selectExpr(
        "CAST(page_id AS STRING) AS program_id", "url",
        "CASE WHEN page_id % 13 = 5 THEN NULL WHEN page_id % 17 = 3 THEN concat('<title>Just a moment...</title>', html) ELSE html END AS body",
        "CAST(CASE WHEN page_id % 13 = 5 THEN 503 ELSE 200 END AS INT) AS http_status", "CAST(NULL AS STRING) AS error",
    )
    return M.hash_pages(df)


def _previous(spark, sf):
    """Stored records of earlier pages: some long since gone, some shorter, some with a word more."""
    old = _pages(spark, sf).selectExpr(
        "CAST(CASE WHEN page_id % 10 = 9 THEN page_id + 1000000 ELSE page_id END AS STRING) AS program_id", "page_id",
        "CASE WHEN page_id % 11 = 0 THEN concat(html, html, html) WHEN page_id % 6 = 0 THEN concat(html, ' extra') ELSE html END AS body",
    )
    return M.hash_pages(old).select(
        "program_id", F.col("text_hash").alias("hash"), F.lit("1998-01-01").cast("date").alias("first_seen"),
        F.lit("1998-03-01").cast("date").alias("last_changed"), F.col("text_length").alias("length"),
        F.lit(200).alias("last_status"), F.lit(None).cast("string").alias("last_error"),
    )


def _compared(spark, sf):
    return M.compare_pages(_current(spark, sf), _previous(spark, sf), _today())


def page_changes(spark, sf):
    return _compared(spark, sf).filter("change IS NOT NULL").select("program_id", "change", "detail")


def page_state(spark, sf):
    return M.next_page_hashes(_compared(spark, sf)).select(
        "program_id", "hash", F.col("first_seen").cast("string").alias("first_seen"),
        F.col("last_changed").cast("string").alias("last_changed"), F.col("length").cast("long").alias("length"),
        F.coalesce("last_error", F.lit("")).alias("last_error"),
    )


def page_verify_rows(spark, sf):
    programs = X.obligations(spark, sf).select("program_id", "label")
    return M.page_verify_rows(_compared(spark, sf), programs).select("program_id", "label", "reason", "url")


def page_history(spark, sf):
    """Three dated observations of every page; some were not fetched."""
    obs = _pages(spark, sf).selectExpr(
        "CAST(page_id AS STRING) AS program_id",
        "inline(array(named_struct('date', DATE '1998-06-13', 'body', html), named_struct('date', DATE '1998-06-14', 'body', "
        "CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 2 = 0 THEN concat(html, ' more') ELSE html END), named_struct('date', DATE '1998-06-15', 'body', "
        "CASE WHEN page_id % 3 = 0 THEN 'gone' ELSE html END)))",
    )
    out = M.page_history(M.hash_pages(obs))
    return out.groupBy("date", F.coalesce("change", F.lit("none")).alias("change")).agg(F.count("*").alias("pages")).select(
        F.col("date").cast("string").alias("date"), "change", "pages"
    )


def bad_bodies(spark, sf):
    df = _pages(spark, sf).selectExpr(
        "page_id",
        "CASE page_id % 9 WHEN 0 THEN '{\"a\": 1}' WHEN 1 THEN concat('<title>403</title>', html) WHEN 2 THEN '' "
        "WHEN 3 THEN 'plain words' WHEN 4 THEN 'BEGIN:VCALENDAR' ELSE html END AS body",
        "element_at(array('xml', 'json', 'html', 'csv', 'ics'), CAST(page_id % 5 + 1 AS INT)) AS expect",
    )
    reason = F.coalesce(M.wrong_shape(F.col("body"), F.col("expect")), F.lit("ok"))
    return df.groupBy("expect", reason.alias("reason")).agg(F.count("*").alias("bodies"))


def _days(spark, sf):
    """Daily counts per event type; every ninth day of a month collapses, every seventh is not modified."""
    e = X.table(spark, sf, "events").select("event_type", F.to_date("ts").alias("date"))
    daily = e.groupBy("event_type", "date").agg(F.count("*").alias("n"))
    dom = F.dayofmonth("date")
    return daily.select(
        F.col("event_type").alias("source_id"), "date", F.col("n").alias("parsed"),
        F.when(dom % 9 == 0, F.floor(F.col("n") / 5)).when(dom % 11 == 0, F.lit(0)).otherwise(F.col("n")).cast("long").alias("kept"),
        F.when(dom % 22 == 0, F.col("n")).otherwise(F.lit(0)).cast("long").alias("filtered"),
        (dom % 7 == 0).alias("not_modified"), F.when(dom % 13 == 0, "timeout").alias("error"),
    )


def volume_collapse(spark, sf):
    out = M.volume_status(_days(spark, sf), history=10)
    return out.select(
        "source_id", F.col("date").cast("string").alias("date"), "kept", F.coalesce("median_before", F.lit(-1.0)).alias("median_before"), "status"
    )


def failure_streaks(spark, sf):
    out = M.failure_streaks(M.volume_status(_days(spark, sf), history=10))
    return out.select(
        "source_id", F.col("date").cast("string").alias("date"), "status", F.col("streak").cast("long").alias("streak"),
        F.coalesce(F.col("last_success").cast("string"), F.lit("")).alias("last_success"),
    )


def stored_counts(spark, sf):
    out = M.stored_counts(_days(spark, sf), history=10)
    return out.select("source_id", F.array_join(F.col("recent_counts").cast("array<string>"), ",").alias("recent"))


def _sources(spark, sf):
    d = X.table(spark, sf, "documents").select(F.col("source").alias("source_id")).distinct()
    return d.select("source_id", F.concat(F.lit("Source "), "source_id").alias("source_name"), F.lit(True).alias("optional"))


def _health(spark, sf):
    """Documents as parsed entries, judged against a history that fits some sources and not others."""
    n = F.regexp_extract("source_id", "([0-9]+)", 1).cast("int")
    parsed = X.table(spark, sf, "documents").selectExpr(
        "source AS source_id", "CASE WHEN lang = 'en' THEN 'kept' WHEN lang = 'fr' THEN 'filtered' ELSE 'dropped' END AS outcome",
        "CASE WHEN n_chars < 100 THEN concat('short:', lang) END AS warning",
    )
    sources = _sources(spark, sf)
    history = sources.select(
        "source_id", F.lit("1998-06-01").cast("date").alias("last_success"), (n % 4).alias("streak"),
        F.when(n % 3 == 0, F.array(F.lit(100000), F.lit(200000), F.lit(4))).when(n % 3 == 1, F.array(F.lit(6), F.lit(8))).otherwise(F.array().cast("array<int>")).alias("recent_counts"),
    )
    return M.source_health(parsed, sources, history, _today())


def source_health(spark, sf):
    return _health(spark, sf).select(
        "source_id", "status", "items_parsed", "items_kept", "items_filtered", "warnings",
        F.coalesce("error", F.lit("")).alias("error"), F.col("last_success").cast("string").alias("last_success"),
        F.col("consecutive_failures").cast("long").alias("consecutive_failures"),
    )


def heartbeat(spark, sf):
    n = F.regexp_extract("source_id", "([0-9]+)", 1).cast("int")
    status = F.element_at(F.array(F.lit("ok"), F.lit("not-modified"), F.lit("degraded"), F.lit("failed")), n % 4 + 1)
    return R.heartbeat(_sources(spark, sf).withColumn("status", status))


def sample_titles(spark, sf):
    items = X.items(spark, sf).select("source_id", F.col("doc_id").alias("item_id"), "title")
    return M.sample_titles(items).select("source_id", "item_id", "title", F.col("rank").cast("long").alias("rank"))


def board_identity(spark, sf):
    docs = X.table(spark, sf, "documents").select(
        F.col("source").alias("source_id"), F.concat(F.lit("City "), F.col("lang"), F.lit(" "), (F.col("doc_id") % 5).cast("string")).alias("location")
    )
    n = F.regexp_extract("source_id", "([0-9]+)", 1).cast("int")
    sources = _sources(spark, sf).select(
        "source_id", F.concat(F.lit("Company "), "source_id").alias("company"),
        F.when(n % 2 == 0, "^City en").otherwise("^Town").alias("expect_location"),
    )
    return M.board_identity(docs, sources)


def first_seen(spark, sf):
    e = X.table(spark, sf, "events").select("user_id", "ts")
    return L.earliest_seen(e, "user_id", "ts").select("user_id", F.col("first_seen").cast("string").alias("first_seen"))


def first_seen_ledger(spark, sf):
    """Today is mid-month: the ledger holds the users of the days before it, the run everyone after."""
    e = X.table(spark, sf, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("item_id"), "ts")
    ledger = L.earliest_seen(e.filter(F.col("ts") < "2024-01-03"), "item_id", "ts")
    run = e.filter(F.col("ts") >= "2024-01-03")
    out = L.first_seen(run, ledger, day("2024-01-15"))
    return out.select("item_id", F.col("first_seen").cast("string").alias("first_seen"), "is_new")


QUERIES = {
    f.__name__: f
    for f in (
        page_changes, page_state, page_verify_rows, page_history, bad_bodies, volume_collapse, failure_streaks,
        stored_counts, source_health, heartbeat, sample_titles, board_identity, first_seen, first_seen_ledger,
    )
}

_TEXT = lambda e: PAGE_TEXT.replace("html", e)
_HEAD = "CASE WHEN page_id % 13 = 5 THEN NULL WHEN page_id % 17 = 3 THEN '<title>Just a moment...</title>' || html ELSE html END"
_PAGES = f"""
WITH cur AS (
  SELECT CAST(page_id AS VARCHAR) AS program_id, page_id, url, {_HEAD} AS body FROM pages
),
prv AS (
  SELECT CAST(CASE WHEN page_id % 10 = 9 THEN page_id + 1000000 ELSE page_id END AS VARCHAR) AS program_id,
    CASE WHEN page_id % 11 = 0 THEN html || html || html WHEN page_id % 6 = 0 THEN html || ' extra' ELSE html END AS body FROM pages
),
c AS (SELECT program_id, page_id, url, left(sha256(t), 16) AS h, length(t) AS n,
        regexp_matches(body, '(?i)just a moment|attention required|checking your browser|access denied|request blocked') AS wall
      FROM (SELECT *, {_TEXT("body")} AS t FROM cur)),
p AS (SELECT program_id, left(sha256(t), 16) AS ph, length(t) AS pn FROM (SELECT *, {_TEXT("body")} AS t FROM prv)),
j AS (
  SELECT coalesce(c.program_id, p.program_id) AS program_id, url, h, n, ph, pn, c.program_id IS NOT NULL AS watched,
    CASE WHEN c.program_id IS NULL THEN NULL WHEN h IS NULL OR wall THEN 'failed' WHEN ph IS NULL THEN 'new' WHEN h = ph THEN NULL
         WHEN pn > 2000 AND n / pn < 0.4 THEN 'suspicious' ELSE 'changed' END AS change,
    CASE WHEN h IS NULL THEN 'fetch failed (HTTP 503)' WHEN wall THEN 'got a Cloudflare challenge page' END AS failure
  FROM c FULL JOIN p ON c.program_id = p.program_id
),
d AS (
  SELECT *, CASE change WHEN 'failed' THEN failure WHEN 'new' THEN 'no earlier copy to compare with'
    WHEN 'suspicious' THEN 'text fell from ' || CAST(pn AS VARCHAR) || ' to ' || CAST(n AS VARCHAR) || ' characters'
    WHEN 'changed' THEN 'text differs from that of 1998-03-01' END AS detail FROM j
)"""
_DAYS = """
WITH n AS (SELECT event_type AS source_id, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY ALL),
days AS (
  SELECT source_id, date, n AS parsed,
    CASE WHEN day(date) % 9 = 0 THEN n // 5 WHEN day(date) % 11 = 0 THEN 0 ELSE n END AS kept,
    CASE WHEN day(date) % 22 = 0 THEN n ELSE 0 END AS filtered,
    day(date) % 7 = 0 AS not_modified, CASE WHEN day(date) % 13 = 0 THEN 'timeout' END AS error FROM n
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id, not_modified ORDER BY date) AS rn FROM days),
meds AS (
  SELECT a.source_id, a.date, median(b.kept) AS med FROM ranked a JOIN ranked b
    ON a.source_id = b.source_id AND a.not_modified = b.not_modified AND b.rn BETWEEN a.rn - 10 AND a.rn - 1 GROUP BY ALL
),
status AS (
  SELECT d.*, med, CASE WHEN error IS NOT NULL THEN 'failed' WHEN not_modified THEN 'not-modified' WHEN parsed = 0 THEN 'degraded'
      WHEN kept = 0 AND filtered >= parsed THEN 'ok' WHEN kept = 0 THEN 'degraded'
      WHEN med >= 5 AND kept < 0.3 * med THEN 'degraded' ELSE 'ok' END AS status
  FROM days d LEFT JOIN meds USING (source_id, date)
)"""
_N = "CAST(regexp_extract(source_id, '([0-9]+)', 1) AS INTEGER)"
_SRC = "WITH s AS (SELECT DISTINCT source AS source_id FROM documents)"

ORACLES = {
    "page_changes": _PAGES + " SELECT program_id, change, detail FROM d WHERE change IS NOT NULL",
    "page_state": _PAGES
    + f""" SELECT program_id, CASE WHEN change IN ('new', 'changed', 'suspicious') THEN h ELSE coalesce(ph, h) END AS hash,
        CASE WHEN ph IS NULL THEN '{X.TODAY}' ELSE '1998-01-01' END AS first_seen,
        CASE WHEN change IN ('new', 'changed', 'suspicious') THEN '{X.TODAY}' ELSE '1998-03-01' END AS last_changed,
        CASE WHEN watched AND failure IS NULL THEN n ELSE pn END AS length,
        CASE WHEN failure = 'got a Cloudflare challenge page' THEN 'Cloudflare challenge page' ELSE '' END AS last_error
      FROM d WHERE ph IS NOT NULL OR (watched AND failure IS NULL)""",
    "page_verify_rows": _PAGES
    + ", "
    + X.SQL_OBLIGATIONS
    + """ SELECT d.program_id, coalesce(label, d.program_id) AS label,
        CASE change WHEN 'changed' THEN 'the page differs: check the date (' || detail || ')'
          WHEN 'suspicious' THEN 'the page seems broken: ' || detail ELSE 'the page did not load: ' || detail END AS reason, d.url
      FROM d LEFT JOIN obligations o ON o.program_id = d.program_id WHERE change IN ('changed', 'suspicious', 'failed')""",
    "page_history": f"""
      WITH o AS (
        SELECT page_id, d, CASE WHEN d = 1 AND page_id % 7 = 0 THEN NULL WHEN d = 1 AND page_id % 2 = 0 THEN html || ' more' WHEN d = 2 AND page_id % 3 = 0 THEN 'gone' ELSE html END AS body
        FROM pages, (VALUES (0), (1), (2)) v(d)),
      h AS (SELECT page_id, d, t, length(t) AS n, last_value(t IGNORE NULLS) OVER w AS pt, length(last_value(t IGNORE NULLS) OVER w) AS pn
        FROM (SELECT *, {_TEXT("body")} AS t FROM o) WINDOW w AS (PARTITION BY page_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT CAST(DATE '1998-06-13' + CAST(d AS INTEGER) AS VARCHAR) AS date, CASE WHEN t IS NULL THEN 'failed' WHEN pt IS NULL THEN 'new' WHEN pt = t THEN 'none'
        WHEN pn > 2000 AND n / pn < 0.4 THEN 'suspicious' ELSE 'changed' END AS change, count(*) AS pages FROM h GROUP BY ALL""",
    "bad_bodies": """
      WITH b AS (SELECT page_id % 9 AS m, ['xml', 'json', 'html', 'csv', 'ics'][page_id % 5 + 1] AS expect FROM pages),
      f AS (SELECT m, expect, CASE m WHEN 0 THEN 'JSON' WHEN 1 THEN 'error page challenge page' WHEN 2 THEN 'nothing' WHEN 3 THEN 'plain text'
          WHEN 4 THEN 'a calendar' ELSE 'an HTML page' END AS found FROM b)
      SELECT expect, CASE WHEN (expect = 'html' AND found = 'an HTML page') OR (expect = 'json' AND found = 'JSON') OR (expect = 'ics' AND found = 'a calendar')
        THEN 'ok' ELSE 'expected ' || expect || ', found ' || found END AS reason, count(*) AS bodies FROM f GROUP BY ALL""",
    "volume_collapse": _DAYS
    + " SELECT source_id, CAST(date AS VARCHAR) AS date, kept, coalesce(med, -1) AS median_before, status FROM status",
    "failure_streaks": _DAYS
    + """, marks AS (SELECT *, status IN ('ok', 'not-modified') AS good FROM status),
      spans AS (SELECT *, max(CASE WHEN good THEN date END) OVER (PARTITION BY source_id ORDER BY date) AS last_good,
          row_number() OVER (PARTITION BY source_id ORDER BY date) AS rn FROM marks)
      SELECT a.source_id, CAST(a.date AS VARCHAR) AS date, a.status, a.rn - coalesce(b.rn, 0) AS streak,
        coalesce(CAST(a.last_good AS VARCHAR), '') AS last_success
      FROM spans a LEFT JOIN spans b ON a.source_id = b.source_id AND a.last_good = b.date""",
    "stored_counts": _DAYS
    + """, latest AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY date DESC) AS rn FROM days WHERE NOT not_modified)
      SELECT source_id, string_agg(CAST(kept AS VARCHAR), ',' ORDER BY date) AS recent FROM latest WHERE rn <= 10 GROUP BY source_id""",
    "source_health": f"""
      WITH p AS (SELECT source AS source_id, count(*) AS items_parsed, count(*) FILTER (WHERE lang = 'en') AS items_kept,
          count(*) FILTER (WHERE lang = 'fr') AS items_filtered, count(*) FILTER (WHERE n_chars < 100) AS warnings,
          min(CASE WHEN n_chars < 100 THEN 'short:' || lang END) AS w FROM documents GROUP BY source),
      m AS (SELECT *, CASE {_N} % 3 WHEN 0 THEN 100000 WHEN 1 THEN 7 ELSE 0 END AS med FROM p),
      s AS (SELECT *, CASE WHEN items_kept = 0 AND items_filtered >= items_parsed THEN 'ok' WHEN items_kept = 0 THEN 'degraded'
          WHEN med >= 5 AND items_kept < med * 0.3 THEN 'degraded' ELSE 'ok' END AS status FROM m)
      SELECT source_id, status, items_parsed, items_kept, items_filtered, warnings,
        CASE WHEN status = 'ok' THEN '' ELSE coalesce(w, 'parsed nothing usable') END AS error,
        CASE WHEN status = 'ok' THEN '{X.TODAY}' ELSE '1998-06-01' END AS last_success,
        CASE WHEN status = 'ok' THEN 0 ELSE {_N} % 4 + 1 END AS consecutive_failures FROM s""",
    "heartbeat": _SRC
    + f""" SELECT count(*) FILTER (WHERE {_N} % 4 < 2) AS ok, count(*) AS total,
        coalesce(string_agg('Source ' || source_id, ', ' ORDER BY source_id) FILTER (WHERE {_N} % 4 >= 2), '') AS degraded FROM s""",
    "sample_titles": """SELECT source AS source_id, doc_id AS item_id, split_part(text, chr(10), 1) AS title,
        row_number() OVER (PARTITION BY source ORDER BY split_part(text, chr(10), 1), doc_id) AS rank FROM documents QUALIFY rank <= 2""",
    "board_identity": f"""
      WITH d AS (SELECT source AS source_id, 'City ' || lang || ' ' || CAST(doc_id % 5 AS VARCHAR) AS location FROM documents),
      l AS (SELECT DISTINCT source_id, location, regexp_matches(location, CASE WHEN {_N} % 2 = 0 THEN '^City en' ELSE '^Town' END) AS hit FROM d),
      bad AS (SELECT source_id FROM l GROUP BY source_id HAVING NOT bool_or(hit)),
      few AS (SELECT source_id, location FROM l WHERE source_id IN (SELECT source_id FROM bad)
        QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY location) <= 3)
      SELECT source_id, 'Company ' || source_id AS company, string_agg(location, ', ' ORDER BY location) AS seen FROM few GROUP BY source_id""",
    "first_seen": "SELECT user_id, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first_seen FROM events GROUP BY user_id",
    "first_seen_ledger": """
      WITH e AS (SELECT CAST(user_id AS VARCHAR) || '/' || event_type AS item_id, ts FROM events),
      old AS (SELECT item_id, min(CAST(ts AS DATE)) AS f FROM e WHERE ts < TIMESTAMP '2024-01-03' GROUP BY item_id)
      SELECT DISTINCT item_id, CAST(coalesce(f, DATE '2024-01-15') AS VARCHAR) AS first_seen, f IS NULL AS is_new
      FROM e LEFT JOIN old USING (item_id) WHERE ts >= TIMESTAMP '2024-01-03'""",
}
