"""Registered queries over the assembled and delivered day."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.plans import daily as D
from tidemark.plans import event_queries, monitoring_queries, news_queries, obligation_queries
from tidemark.plans import fixtures as X
from tidemark.session import checkpoint_root
from tidemark.sources import digests


def _collected(spark, sf):
    """Every item, and beside them poorer copies, entries without a title and entries without an address."""
    items = news_queries._items(spark, sf)
    copy = items.filter("doc_id % 4 = 0").withColumn("authority", F.col("authority") - 0.5)
    untitled = items.filter("doc_id % 9 = 0").withColumn("title", F.lit(" "))
    nowhere = items.filter("doc_id % 10 = 0").withColumn("canonical_url", F.lit(""))
    return items.unionByName(copy).unionByName(untitled).unionByName(nowhere)


def _obligations(spark, sf):
    return D.obligation_half(X.programs(spark, sf), X.CLOCK, *obligation_queries._ledgers(spark, sf))


def _day(spark, sf):
    news = D.news_half(_collected(spark, sf), news_queries.rank)
    return D.assemble(spark, _obligations(spark, sf), news, X.CLOCK)


def digest_stats(spark, sf):
    """``fetched`` is what is kept and what is dropped, whatever the reason."""
    stats = _day(spark, sf).parts["stats"]
    dropped = F.aggregate(F.map_values("dropped"), F.lit(0).cast("long"), lambda a, n: a + n)
    return stats.select("fetched", "kept", dropped.alias("dropped"), "deadlines_tracked", "verified_last_7d", "median_score")


def digest_drops(spark, sf):
    return _day(spark, sf).parts["stats"].select(F.explode("dropped").alias("drop_reason", "dropped"))


def digest_lanes(spark, sf):
    lanes = _day(spark, sf).parts["lane_items"]
    return lanes.groupBy("lane").agg(F.count("*").alias("items"), F.min("item_id").alias("first_id"))


def digest_verify(spark, sf):
    """Obligations to verify beside pages that changed, broke or did not load."""
    built, _ = _obligations(spark, sf)
    programs = X.obligations(spark, sf).select("program_id", "label")
    rows = D.verify_part(built, monitoring_queries._compared(spark, sf), programs)
    return rows.select("program_id", "label", "reason", F.coalesce("stale_days", F.lit(0)).alias("stale"), F.coalesce("url", F.lit("")).alias("url"))


def digest_health(spark, sf):
    """The registry, the sources and the event feeds, one row each."""
    _, counts = _obligations(spark, sf)
    feeds = E.feed_status(event_queries._resolved(spark, sf))
    return D.health_part(spark, counts["rows"], counts["kept"], monitoring_queries._health(spark, sf), feeds)


def _planted(day):
    """The day with faults planted by key into what it delivers."""
    items, strip, lanes = day.parts["items"], day.parts["countdown"], day.parts["lane_items"]
    k = F.col("program_id").cast("long")
    named = lambda f: f.withField("key", F.concat(F.lit("llm."), f["key"]))
    wrong = F.col("deadline").withField(
        "date", F.when(F.col("deadline.date").isNotNull() & (k % 47 == 0), "1998-02-31").otherwise(F.col("deadline.date"))
    ).withField("provenance", F.when(k % 53 == 0, "").otherwise(F.col("deadline.provenance")))
    items = items.withColumns(
        {
            "title": F.when(k % 61 == 0, "").otherwise(F.col("title")),
            "weights_version": F.when(k % 59 != 0, F.col("weights_version")).when(k.isNull(), F.col("weights_version")),
            "deadline": wrong,
            "factors": F.when(k % 71 == 0, F.transform("factors", named)).otherwise(F.col("factors")),
        }
    )
    twice = F.explode(F.when(k % 67 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    day.parts["items"] = items.select("*", twice.alias("_copy")).drop("_copy")
    day.parts["countdown"] = strip.withColumn("deadline_date", F.when(k % 43 == 0, "soon").otherwise(F.col("deadline_date")))
    day.parts["lane_items"] = lanes.withColumn("item_id", F.when(F.col("rank") == 1, "gone").otherwise(F.col("item_id")))
    return day


def _ruled_out(spark, sf):
    """The programmes that the registry rules out, and some that it should have."""
    return X.obligations(spark, sf).filter("status = 'ruled-out' OR key % 73 = 0").select("program_id")


def digest_problems(spark, sf):
    """A delivered day against every delivery rule: counted by the writes of its parts."""
    root = f"{checkpoint_root(spark)}/digests-{uuid.uuid4().hex}"
    return D.deliver(spark, _planted(_day(spark, sf)), _ruled_out(spark, sf), root, X.TODAY, uuid.uuid4().hex)


def _archive(spark, sf):
    """The obligation half of a day, its pages, sources and feeds, delivered twice by the same run."""
    root, run = f"{checkpoint_root(spark)}/digests-{uuid.uuid4().hex}", uuid.uuid4().hex
    built = _obligations(spark, sf)
    none = built[0].sparkSession.createDataFrame([], news_queries._ranked(spark, sf).schema)
    for _ in range(2):
        day = D.assemble(
            spark, built, (none, {"rows": 0, "kept": 0}), X.CLOCK,
            sources=monitoring_queries._health(spark, sf), entries=event_queries._entries(spark, sf),
        )
        D.deliver(spark, day, _ruled_out(spark, sf), root, X.TODAY, run).count()
    return root


def run_status(spark, sf):
    """The history of runs after a run that was repeated: one row."""
    rows = digests.read_run_status(spark, f"{_archive(spark, sf)}/run_status")
    return rows.select(F.col("date").cast("string").alias("date"), "outcome", "sources_ok", "sources_total", "items_kept", "deadlines_tracked")


def digest_events(spark, sf):
    """Events as delivered, read back from the archive: none is shown twice, and none were a feed broken."""
    rows = digests.read_part(spark, _archive(spark, sf), "events", X.TODAY)
    return rows.select("uid", F.col("day").cast("string").alias("day"), "kind", "label", "watched")


QUERIES = {
    f.__name__: f
    for f in (digest_stats, digest_drops, digest_lanes, digest_verify, digest_health, digest_problems, run_status, digest_events)
}

_BUILT, _RANK, _STRIP = obligation_queries._BUILT, news_queries._RANK, obligation_queries._STRIP
_EXTRA = "(SELECT count(*) FILTER (WHERE doc_id % 4 = 0) AS copies, count(*) FILTER (WHERE doc_id % 9 = 0) AS untitled, count(*) FILTER (WHERE doc_id % 10 = 0) AS nowhere, count(*) AS docs FROM documents)"
#: Obligations kept, and the day's best news, in the columns that the parts share.
_KEPT = f"""
WITH o AS MATERIALIZED ({_BUILT} SELECT * FROM decided),
n AS MATERIALIZED ({_RANK} SELECT doc_id, item_id, primary_lane, score, drop_reason FROM final),
best AS (SELECT * FROM n WHERE drop_reason IS NULL ORDER BY score DESC, item_id LIMIT 42),
opp AS (
  SELECT *, left(sha256(program_id || '#' || CAST(cycle_year AS VARCHAR)), 16) AS item_id, coalesce(lane, 'fellowships') AS primary_lane
  FROM o WHERE drop_reason IS NULL
),
items AS (
  SELECT item_id, primary_lane, score, key, program_id, tdate, inst FROM opp
  UNION ALL SELECT item_id, primary_lane, score, NULL, NULL, NULL, NULL FROM best
),
lanes AS (
  SELECT *, CASE WHEN primary_lane <> 'deadlines' THEN row_number() OVER (PARTITION BY primary_lane ORDER BY score DESC, item_id) END AS rank
  FROM items QUALIFY rank IS NULL OR rank <= 6
),
gate AS (WITH {X.SQL_OBLIGATIONS} SELECT CASE WHEN status = 'ruled-out' THEN 'ruled-out'
    WHEN status = 'watch' AND DATE '{X.TODAY}' < watch_from THEN 'not-yet-watched' WHEN status = 'closed' THEN 'closed' END AS drop_reason FROM obligations),
drops AS (
  SELECT drop_reason, count(*) AS dropped FROM (
    SELECT drop_reason FROM gate UNION ALL SELECT drop_reason FROM o UNION ALL SELECT drop_reason FROM n
    UNION ALL SELECT 'over-cap' FROM n WHERE drop_reason IS NULL AND item_id NOT IN (SELECT item_id FROM best)
    UNION ALL SELECT 'duplicate' FROM documents WHERE doc_id % 4 = 0
    UNION ALL SELECT 'no-title' FROM documents WHERE doc_id % 9 = 0
    UNION ALL SELECT 'no-url' FROM documents WHERE doc_id % 10 = 0)
  WHERE drop_reason IS NOT NULL GROUP BY drop_reason
)"""
_FEEDS = event_queries.ORACLES["feed_status"]

ORACLES = {
    "digest_stats": _KEPT
    + f""" SELECT (SELECT count(*) FROM gate) + docs + copies + untitled + nowhere AS fetched, (SELECT count(*) FROM items) AS kept,
        (SELECT CAST(sum(dropped) AS BIGINT) FROM drops) AS dropped,
        (SELECT count(*) FROM o WHERE dkind NOT IN ('rolling', 'unknown')) AS deadlines_tracked,
        (SELECT count(*) FROM o WHERE stale_days <= 7) AS verified_last_7d, (SELECT median(score) FROM opp) AS median_score FROM {_EXTRA}""",
    "digest_drops": _KEPT + " SELECT drop_reason, dropped FROM drops",
    "digest_lanes": _KEPT + " SELECT primary_lane AS lane, count(*) AS items, min(item_id) AS first_id FROM lanes GROUP BY primary_lane",
    "digest_verify": f"""
      SELECT program_id, label, reason, stale, coalesce(url, '') AS url FROM ({obligation_queries.ORACLES["verify_queue"]})
      UNION ALL SELECT program_id, label, reason, 0, coalesce(url, '') FROM ({monitoring_queries.ORACLES["page_verify_rows"]})""",
    "digest_health": f"""
      SELECT 'registry' AS section, 'registry' AS source_id, 'ok' AS status, (SELECT count(*) FROM orders) AS items_parsed, count(*) AS items_kept
      FROM ({_BUILT} SELECT * FROM decided) WHERE drop_reason IS NULL
      UNION ALL SELECT 'source', source_id, status, items_parsed, items_kept FROM ({monitoring_queries.ORACLES["source_health"]})
      UNION ALL SELECT 'feed', feed_id, status, parsed, kept FROM ({_FEEDS})""",
    "digest_problems": _KEPT
    + f""", strip AS ({_STRIP} SELECT * FROM strip),
      twice AS (SELECT * FROM items UNION ALL SELECT * FROM items WHERE key % 67 = 0),
      found AS (
        SELECT 'item-title' AS rule FROM twice WHERE key % 61 = 0
        UNION ALL SELECT 'item-weights' FROM twice WHERE key % 59 = 0
        UNION ALL SELECT 'item-provenance' FROM twice WHERE key % 53 = 0
        UNION ALL SELECT 'item-date' FROM twice WHERE key % 47 = 0 AND inst IS NOT NULL
        UNION ALL SELECT 'factor-key' FROM twice WHERE key % 71 = 0
        UNION ALL SELECT 'item-duplicate' FROM items WHERE key % 67 = 0
        UNION ALL SELECT 'ruled-out' FROM twice WHERE key % 73 = 0
        UNION ALL SELECT 'ruled-out' FROM strip WHERE key % 73 = 0
        UNION ALL SELECT 'strip-date' FROM strip WHERE key % 43 = 0
        UNION ALL SELECT 'missing item' FROM lanes WHERE rank = 1)
      SELECT rule, count(*) AS problems FROM found GROUP BY rule""",
    "run_status": f"""
      WITH o AS ({_BUILT} SELECT * FROM decided), s AS ({monitoring_queries.ORACLES["source_health"]}), f AS ({_FEEDS})
      SELECT '{X.TODAY}' AS date, 'ok' AS outcome, 1 + (SELECT count(*) FROM s WHERE status = 'ok') + (SELECT count(*) FROM f WHERE status = 'ok') AS sources_ok,
        1 + (SELECT count(*) FROM s) + (SELECT count(*) FROM f) AS sources_total, count(*) FILTER (WHERE drop_reason IS NULL) AS items_kept,
        count(*) FILTER (WHERE dkind NOT IN ('rolling', 'unknown')) AS deadlines_tracked FROM o""",
    "digest_events": event_queries._ENTRIES + " SELECT uid, CAST(day AS VARCHAR) AS day, kind, label, watched FROM upcoming",
}
