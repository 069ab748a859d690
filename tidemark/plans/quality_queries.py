"""Registered queries over quotes, generated text, validation rules and the assembled digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import CAPITALISED_STOPWORDS
from tidemark.functions.common import day, instant, stage
from tidemark.functions.grounding import strange_names
from tidemark.functions.reader import quote_appears_in, read_deadline
from tidemark.operators import grounding as G
from tidemark.operators import lanes as L
from tidemark.operators import obligations as O
from tidemark.operators import proposals as P
from tidemark.operators import quality as Q
from tidemark.operators import reports as R
from tidemark.operators.asof import as_of, last_of
from tidemark.operators.ranking import ranked
from tidemark.plans import fixtures as X
from tidemark.sources.digests import previous_rows

READER_NOW = "2009-01-01 00:00:00"

# A sentence per order around its date, shifted into the years a reader accepts.
SHIFTED = "add_months(CAST(o_orderdate AS DATE), 120)"
SENTENCE = f"""CASE o_orderkey % 12
  WHEN 0 THEN concat('Applications close on ', date_format({SHIFTED}, 'd MMMM yyyy'), '.')
  WHEN 1 THEN concat('The deadline is ', date_format({SHIFTED}, 'MMMM d'), 'th, ', year({SHIFTED}), ' at noon.')
  WHEN 2 THEN concat('Submit by ', CAST({SHIFTED} AS STRING), ' without fail')
  WHEN 3 THEN concat('Winners were announced on ', date_format({SHIFTED}, 'd MMMM yyyy'), ', before the deadline.')
  WHEN 4 THEN concat('The call closed on ', date_format({SHIFTED}, 'd MMM yyyy'))
  WHEN 5 THEN concat('Copyright ', year({SHIFTED}), ' deadline office')
  WHEN 6 THEN concat('Join the webinar on ', date_format({SHIFTED}, 'd MMMM yyyy'), ' about closing dates')
  WHEN 7 THEN concat('Published ', date_format({SHIFTED}, 'd MMMM yyyy'))
  WHEN 8 THEN concat('Applications are due ', date_format({SHIFTED}, 'd MMMM'))
  WHEN 9 THEN concat('The deadline falls in ', date_format({SHIFTED}, 'MMMM yyyy'))
  WHEN 10 THEN concat('Due 31 February ', year({SHIFTED}))
  ELSE concat('Our office is closed; the deadline of ', date_format({SHIFTED}, 'd MMMM yyyy'), ' stands') END"""


def _sentences(spark, sf):
    return X.table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS program_id", "o_orderkey AS key", f"{SENTENCE} AS quote",
        f"CAST(year({SHIFTED}) + o_orderkey % 3 AS INT) AS cycle_year", f"{SHIFTED} AS d",
    )


def deadline_reader(spark, sf):
    read = read_deadline(F.col("quote"), F.lit("Europe/London"), instant(READER_NOW), F.col("cycle_year"))
    df = stage(_sentences(spark, sf), {"r": read})
    return df.select("program_id", F.col("r.ok").alias("ok"), F.coalesce("r.date", F.lit("")).alias("date"), F.coalesce("r.reason", F.lit("")).alias("reason"))


def deadline_proposals(spark, sf):
    """Quotes against pages that hold them, hold something else, or are too short; and against the registry."""
    s = _sentences(spark, sf)
    padding = F.repeat(F.lit("Some words of the page. "), 12)
    text = F.when(F.col("key") % 5 == 0, "short").when(F.col("key") % 7 == 0, padding).otherwise(
        F.concat(padding, F.upper("quote"), F.lit("  More."))
    )
    pages = s.select("program_id", text.alias("page_text"))
    current = F.when(F.col("key") % 2 == 0, F.col("d").cast("string")).otherwise("2001-01-01")
    registry = s.select(
        "program_id", F.concat(F.lit("Program "), "program_id").alias("label"), F.lit("Europe/London").alias("time_zone"), "cycle_year",
        current.alias("current_date"), F.lit("confirmed").alias("current_kind"), F.lit("day").alias("current_precision"),
    )
    return P.propose(s.select("program_id", "quote"), pages, registry, instant(READER_NOW))


def proposal_outcomes(spark, sf):
    rows = deadline_proposals(spark, sf)
    return rows.select(
        "program_id", F.coalesce("proposed_date", F.lit("")).alias("proposed"), F.coalesce("refused", F.lit("")).alias("refused"),
        F.coalesce("agrees", F.lit(False)).alias("agrees"),
    )


def proposal_report(spark, sf):
    return P.proposal_report(deadline_proposals(spark, sf))


def quote_containment(spark, sf):
    """Each benchmark passage looked for in a page assembled around it, quoted and spaced as pages do."""
    b = X.table(spark, sf, "benchmark").select("item_id", "text")
    page = F.when(F.col("item_id") % 3 == 0, F.reverse("text")).otherwise(
        F.concat(F.lit("“Intro” – "), F.regexp_replace("text", "([ \n])", "$1 "), F.lit("\nend"))
    )
    quote = F.when(F.col("item_id") % 4 == 1, "tiny").otherwise(F.regexp_replace("text", " ", "   "))
    return b.select("item_id", quote_appears_in(quote, page).alias("found"))


def _turns(spark, sf):
    """Each assistant turn, and all turns that may come before one; every third turn of a conversation says nothing."""
    c = X.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    reply = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("candidate"))
    before = c.filter((F.col("conv_id") + F.col("turn")) % 3 != 0).select("conv_id", F.col("turn").alias("said"), F.col("text").alias("block"))
    return reply, before


def _answered(reply, before):
    """Replies beside the latest turn before them that says something, however many turns ago."""
    return as_of(reply, before, ["conv_id"], "turn", "said", ["block"], width=64, strict=True)


def number_grounding(spark, sf):
    """Whole replies with numbers planted by key: in the input, spelled out, and foreign."""
    reply, before = _turns(spark, sf)
    extra = F.element_at(
        F.array(F.lit(" See 12 items."), F.lit(" In seven days."), F.lit(" Only 99 left."), F.lit(" Visit www.example.org now."), F.lit("")),
        ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"),
    )
    reply = reply.withColumn("candidate", F.concat("candidate", extra))
    before = before.withColumn("block", F.concat(F.lit("12 items. "), "block"))
    out = G.verdicts(_answered(reply, before))
    kind = F.regexp_extract("reason", "^(no-input|empty|over|contains a URL|contains the number|says|names)", 1)
    return out.select("conv_id", "turn", F.coalesce(kind, F.lit("grounded")).alias("verdict"))


def name_grounding(spark, sf):
    """A name that is in the input for even conversations only."""
    reply, before = _turns(spark, sf)
    reply = reply.withColumn("candidate", F.lit("However, Rhodes and Marshall remain open."))
    before = X.table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("block"))
    before = before.withColumn("block", F.concat(F.when(F.col("conv_id") % 2 == 0, "rhodes, marshall: ").otherwise("rhodes only: "), F.regexp_replace(F.lower("block"), "marshall", "")))
    out = G.check(reply, before, ["conv_id", "turn"])
    return out.groupBy(F.coalesce("reason", F.lit("grounded")).alias("verdict")).agg(F.count("*").alias("replies"))


def reply_name_grounding(spark, sf):
    """The names in each whole reply, and in a planted sentence after it, that its input lacks."""
    reply, before = _turns(spark, sf)
    reply = reply.withColumn("candidate", F.concat("candidate", F.lit(" However, Rhodes and Marshall remain open.")))
    before = before.withColumn("block", F.concat(F.when(F.col("conv_id") % 2 == 0, "rhodes, marshall: ").otherwise("rhodes only: "), "block"))
    names = strange_names(F.col("candidate"), F.col("block"))
    return _answered(reply, before).select("conv_id", "turn", F.when(F.col("block").isNull(), "no-input").otherwise(F.array_join(names, "|")).alias("names"))


def input_blocks(spark, sf):
    """One block per order date: its twelve dearest orders."""
    o = X.table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").cast("string").alias("item_id"), F.col("o_orderstatus").alias("lane"),
        F.col("o_totalprice").alias("score"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("o_orderpriority").alias("fact"), (F.col("o_orderkey") % 9).alias("days_until"),
    )
    out = G.input_blocks(o)
    return out.select(F.col("date").cast("string").alias("date"), F.left(F.sha2("block", 256), F.lit(16)).alias("digest"))


def _faulty(spark, sf):
    """The registry with faults planted by key."""
    df = X.programs(spark, sf)
    k = F.col("program_id").cast("long")
    df = df.withColumns(
        {
            "time_zone": F.when(k % 97 == 0, "Mars/Olympus").otherwise(F.col("time_zone")),
            "label": F.when(k % 89 == 0, "").otherwise(F.col("label")),
            "lane": F.when(k % 83 == 0, "nowhere").otherwise(F.col("lane")),
            "program_id": F.when(k % 101 == 1, (k - 1).cast("string")).otherwise(F.col("program_id")),
        }
    )
    return df.withColumn("key", k)


def registry_problems(spark, sf):
    """Programme, cycle and step rules over a registry with planted faults, unknown zones among them."""
    return Q.registry_problems(_faulty(spark, sf), X.CLOCK.at).groupBy("rule").agg(F.count("*").alias("problems"))


def resolve_bad_zones(spark, sf):
    """A programme in an unknown zone is dropped with its reason; all others are resolved."""
    df = _faulty(spark, sf)
    dropped = O.status_gate(df, X.CLOCK).filter("drop_reason IS NOT NULL").select(F.col("drop_reason").alias("outcome"))
    done = O.resolve(df, X.CLOCK).select(F.lit("resolved").alias("outcome"))
    return dropped.unionByName(done).groupBy("outcome").agg(F.count("*").alias("programs"))


def cycle_problems(spark, sf):
    df = X.programs(spark, sf)
    k = F.col("program_id").cast("long")
    bad = lambda c: (
        c.withField("kind", F.when((k % 10 == 0) & (k % 20 == 0), "maybe").when(k % 11 == 5, F.lit("rolling")).otherwise(c["kind"]))
        .withField("deadline", F.when(k % 13 == 4, "2026-02-31").otherwise(c["deadline"]))
    )
    df = df.withColumn("cycles", F.transform("cycles", bad))
    return Q.cycle_problems(df, X.CLOCK.at).groupBy("rule").agg(F.count("*").alias("problems"))


def step_problems(spark, sf):
    return Q.step_problems(X.programs(spark, sf)).groupBy("rule").agg(F.count("*").alias("problems"))


def move_problems(spark, sf):
    """Price per quantity against a mean, as a daily move."""
    li = X.table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"),
        F.when(F.col("l_quantity") == 13, float("inf")).otherwise((F.col("l_extendedprice") - 50000) / 700).alias("change_pct"),
    )
    return Q.move_problems(li).groupBy("rule").agg(F.count("*").alias("problems"))


def lane_references(spark, sf):
    """Lane lists by order date, some pointing at items that are not there, some twice."""
    o = X.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("k"))
    lane = F.element_at(F.array(*[F.lit(x) for x in ("deadlines", "fellowships", "conferences", "elsewhere")]), (F.col("k") % 4 + 1).cast("int"))
    refs = o.select(
        "date", lane.alias("lane"),
        F.explode(F.when(F.col("k") % 50 == 0, F.array((F.col("k") + 10**9), F.col("k"))).when(F.col("k") % 50 == 1, F.array("k", "k")).otherwise(F.array("k"))).alias("item_id"),
    )
    items = o.select("date", F.col("k").alias("item_id"))
    return L.reference_problems(refs, items).groupBy("problem", "lane").agg(F.count("*").alias("references"))


def lane_order(spark, sf):
    """Lane lists of each order date resolved to their items, in order: pinned lane first, then as declared."""
    o = X.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("item_id"), "o_totalprice")
    k = F.col("item_id")
    lane = F.element_at(F.array(*[F.lit(x) for x in ("conferences", "deadlines", "mstp-labs", "elsewhere")]), (k % 4 + 1).cast("int"))
    refs = o.select("date", lane.alias("lane"), F.when(k % 50 == 0, k + 10**9).otherwise(k).alias("item_id"))
    found = L.lane_entries(refs, o.select("date", "item_id", F.col("o_totalprice").alias("score")))
    placed = ranked(found, [F.col("lane_rank"), F.col("score").desc(), F.col("item_id")], ["date"])
    return placed.select(F.col("date").cast("string").alias("date"), "lane", "item_id", "rank")


def previous_openers(spark, sf):
    """The last three openers of an archive before each of its dates; on every fifth day none was written."""
    o = X.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("archive"), F.to_date("o_orderdate").alias("date")).distinct()
    o = o.withColumn("day", F.unix_date("date"))
    opener = F.concat(F.col("archive"), F.lit(" opens "), F.col("date").cast("string")).alias("opener")
    written = o.filter(F.col("day") % 5 != 0).select("archive", "day", opener)
    out = last_of(o, written, ["archive"], "day", "day", "opener", width=90, n=3)
    return out.select("archive", F.col("date").cast("string").alias("date"), *[F.coalesce(f"opener_{i}", F.lit("")).alias(f"opener_{i}") for i in (1, 2, 3)])


def ledger_as_of(spark, sf):
    """What each user's ledger of purchases held when they did anything else: the latest purchase at or before that second."""
    e = X.table(spark, sf, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_type", "value")
    bought = e.filter("event_type = 'purchase'").groupBy("user_id", F.col("at").alias("bought_at")).agg(F.max("value").alias("paid"))
    rows = as_of(e.filter("event_type <> 'purchase'"), bought, ["user_id"], "at", "bought_at", ["paid"], width=86_400, matched_at="bought")
    return rows.select("event_id", F.coalesce("paid", F.lit(-1.0)).alias("paid"), F.coalesce("bought", F.lit(-1)).cast("long").alias("bought"))


def silence_guard(spark, sf):
    """Days with orders and no urgent one: tracked, and an empty strip."""
    o = X.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderpriority")
    stats = o.groupBy("date").agg(F.count("*").alias("deadlines_tracked"))
    strip = o.filter("o_orderpriority = '1-URGENT'").select("date")
    return R.silence_guard(stats, strip).select(F.col("date").cast("string").alias("date"), "deadlines_tracked")


def previous_digests(spark, sf):
    """The three newest order dates strictly before the fixture day."""
    o = X.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    return previous_rows(o, day(X.TODAY), 3).select(F.col("date").cast("string").alias("date"))


def faulty_items(spark, sf):
    """Delivered rows with faults planted by key, against the delivery rules."""
    o = X.obligations(spark, sf).withColumn("k", F.col("key"))
    k = F.col("k")
    key_name = F.when(k % 71 == 0, "llm.rank").when(k % 73 == 0, "ClaudeScore").otherwise("fit")
    items = o.select(
        F.lit(X.TODAY).cast("date").alias("date"), F.col("program_id").alias("item_id"), "program_id", "status",
        F.when(k % 61 == 0, "").otherwise(F.col("label")).alias("title"),
        F.when(k % 67 == 0, "advert").otherwise("opportunity").alias("kind"),
        F.when(k % 59 == 0, F.lit(None)).otherwise("w1").cast("string").alias("weights_version"),
        F.struct(
            F.when(k % 53 == 0, "").otherwise("yaml").alias("provenance"),
            F.when(F.col("kind").isNull(), F.when(k % 47 == 0, "1998-02-31").when(k % 43 != 0, F.col("due").cast("string"))).alias("date"),
            F.coalesce("kind", F.lit("confirmed")).alias("kind"),
        ).alias("deadline"),
        F.array(F.struct(key_name.alias("key"))).alias("factors"), F.array(F.struct(F.lit("x").alias("key"))).alias("penalties"),
    )
    ruled_out = o.filter("status = 'ruled-out'").select("program_id")
    return Q.item_problems(items, ruled_out).groupBy("rule").agg(F.count("*").alias("problems"))


QUERIES = {
    f.__name__: f
    for f in (
        deadline_reader, proposal_outcomes, proposal_report, quote_containment, number_grounding, name_grounding, reply_name_grounding,
        input_blocks, registry_problems, resolve_bad_zones, cycle_problems, step_problems, move_problems, lane_references, lane_order, previous_openers, ledger_as_of, silence_guard,
        previous_digests, faulty_items,
    )
}

_S = """
WITH s AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS program_id, o_orderkey AS key, o_orderkey % 12 AS m,
    CAST(CAST(o_orderdate AS DATE) + INTERVAL 120 MONTH AS DATE) AS d FROM orders
),
r AS (
  SELECT *, year(d) AS y, year(d) + key % 3 AS cy,
    CASE m WHEN 3 THEN 'announcement' WHEN 4 THEN 'closed-cycle' WHEN 5 THEN 'page-metadata'
      WHEN 6 THEN 'event' WHEN 7 THEN 'no-cue'
      WHEN 8 THEN 'no-year' WHEN 9 THEN 'no-date'
      WHEN 10 THEN 'no-such-day' WHEN 11 THEN 'office-closed' END AS why FROM s
),
read AS (
  SELECT *, coalesce(why, CASE WHEN key % 3 = 2 THEN 'other-cycle' END) AS reason FROM r
)"""
_PROP = (
    _S
    + """, p AS (
  SELECT *, CASE WHEN key % 5 = 0 THEN 'page too short' WHEN key % 7 = 0 THEN 'quote not on page' ELSE reason END AS refused,
    CASE WHEN key % 2 = 0 THEN CAST(d AS VARCHAR) ELSE '2001-01-01' END AS cur FROM read
)"""
)
_ALL = X.SQL_OBLIGATIONS
_BAD = (
    "WITH "
    + _ALL
    + """, f AS (
  SELECT CASE WHEN key % 101 = 1 THEN CAST(key - 1 AS VARCHAR) ELSE program_id END AS program_id, key,
    CASE WHEN key % 97 = 0 THEN 'Mars/Olympus' ELSE time_zone END AS time_zone, CASE WHEN key % 89 = 0 THEN '' ELSE label END AS label,
    CASE WHEN key % 83 = 0 THEN 'nowhere' ELSE lane END AS lane, status FROM obligations
)"""
)
_CYC = f"""WITH {_ALL}, c AS (
  SELECT key, CAST(due + INTERVAL (shift) MONTH AS DATE) AS cdue, due,
    CASE WHEN key % 20 = 0 THEN 'maybe' WHEN key % 11 = 5 THEN 'rolling' ELSE kind END AS kind,
    CASE WHEN key % 13 = 4 THEN '2026-02-31' WHEN kind IS NULL THEN CAST(CAST(due + INTERVAL (shift) MONTH AS DATE) AS VARCHAR) END AS deadline,
    CASE WHEN key % 3 = 0 THEN due + CAST(key % 500 - 50 AS INTEGER) END AS ev
  FROM obligations, (VALUES (-12), (0), (12)) s(shift)
)"""

_PROGRAM_RULES = _BAD + """ SELECT rule, count(*) AS problems FROM (
        SELECT 'unknown-zone' AS rule FROM f WHERE time_zone = 'Mars/Olympus' UNION ALL SELECT 'missing-label' FROM f WHERE label = ''
        UNION ALL SELECT 'unknown-lane' FROM f WHERE lane = 'nowhere'
        UNION ALL SELECT 'ruled-out-without-reason' FROM f WHERE status = 'ruled-out' AND key % 2 = 1
        UNION ALL SELECT 'duplicate-id' FROM f GROUP BY program_id HAVING count(*) > 1) GROUP BY rule"""
_CYCLE_RULES = """ SELECT rule, count(*) AS problems FROM (
        SELECT 'cycle-year' AS rule FROM c WHERE year(cdue) NOT BETWEEN 2024 AND 2045
        UNION ALL SELECT 'unknown-kind' FROM c WHERE kind = 'maybe'
        UNION ALL SELECT 'unparseable-deadline' FROM c WHERE deadline = '2026-02-31'
        UNION ALL SELECT 'rolling-with-deadline' FROM c WHERE kind = 'rolling' AND deadline IS NOT NULL
        UNION ALL SELECT 'unknown-with-deadline' FROM c WHERE kind = 'unknown' AND deadline IS NOT NULL
        UNION ALL SELECT 'no-deadline-no-kind' FROM c WHERE kind IS NULL AND deadline IS NULL
        UNION ALL SELECT 'deadline-after-event' FROM c WHERE TRY_CAST(deadline AS DATE) > ev
        UNION ALL SELECT 'deadline-too-early' FROM c WHERE ev - TRY_CAST(deadline AS DATE) > 400) GROUP BY rule"""
_STEP_RULES = """
      WITH s AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      SELECT 'step-precondition-unknown' AS rule, 3 * count(*) AS problems FROM s a
      WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.k = a.k AND b.n = a.n - 1)"""
_CYC_AS_THEY_ARE = _CYC.replace("CASE WHEN key % 20 = 0 THEN 'maybe' WHEN key % 11 = 5 THEN 'rolling' ELSE kind END", "kind").replace(
    "CASE WHEN key % 13 = 4 THEN '2026-02-31' WHEN", "CASE WHEN"
)

#: Replies beside the latest turn before them that says something.
_PAIRS = """pairs AS (
        SELECT a.conv_id, a.turn, a.text, b.text AS said FROM (SELECT * FROM conversations WHERE role = 'assistant') a
        ASOF LEFT JOIN (SELECT * FROM conversations WHERE (conv_id + turn) % 3 <> 0) b ON a.conv_id = b.conv_id AND a.turn > b.turn)"""
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(CAPITALISED_STOPWORDS))
_NAMES = (
    r"list_filter(list_transform(regexp_extract_all({text}, '\b[A-Z][A-Za-z0-9''’&.-]+\b'), lambda x: regexp_replace(x, '[.''’&-]+$', '')), "
    "lambda x: length(x) >= 2 AND NOT list_contains([" + _STOP.replace("{", "{{") + "], lower(x)))"
)

ORACLES = {
    "previous_digests": f"""SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders
      WHERE CAST(o_orderdate AS DATE) < DATE '{X.TODAY}' ORDER BY 1 DESC LIMIT 3""",
    "faulty_items": f"""WITH {_ALL} SELECT rule, count(*) AS problems FROM (
        SELECT 'item-title' AS rule FROM obligations WHERE key % 61 = 0
        UNION ALL SELECT 'item-kind' FROM obligations WHERE key % 67 = 0
        UNION ALL SELECT 'item-weights' FROM obligations WHERE key % 59 = 0
        UNION ALL SELECT 'item-status' FROM obligations WHERE status = 'ruled-out' AND key % 67 <> 0
        UNION ALL SELECT 'ruled-out' FROM obligations WHERE status = 'ruled-out'
        UNION ALL SELECT 'item-provenance' FROM obligations WHERE key % 53 = 0 AND key % 67 <> 0
        UNION ALL SELECT 'item-date' FROM obligations WHERE key % 47 = 0 AND kind IS NULL AND key % 67 <> 0
        UNION ALL SELECT 'item-undated' FROM obligations WHERE key % 43 = 0 AND key % 47 <> 0 AND kind IS NULL AND key % 67 <> 0
        UNION ALL SELECT 'factor-key' FROM obligations WHERE key % 71 = 0 OR key % 73 = 0) GROUP BY rule""",
    "deadline_reader": _S
    + """ SELECT program_id, reason IS NULL AS ok, CASE WHEN reason IS NULL THEN CAST(d AS VARCHAR) ELSE '' END AS date,
        coalesce(reason, '') AS reason FROM read""",
    "proposal_outcomes": _PROP
    + """ SELECT program_id, CASE WHEN refused IS NULL THEN CAST(d AS VARCHAR) ELSE '' END AS proposed, coalesce(refused, '') AS refused,
        refused IS NULL AND cur = CAST(d AS VARCHAR) AS agrees FROM p""",
    "proposal_report": _PROP
    + " SELECT cur = CAST(d AS VARCHAR) AS agrees, count(*) AS proposals FROM p WHERE refused IS NULL GROUP BY ALL",
    "quote_containment": "SELECT item_id, item_id % 3 <> 0 AND item_id % 4 <> 1 AS found FROM benchmark",
    "number_grounding": f"""
      WITH {_PAIRS}, c AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS m, text, '12 items. ' || said AS block FROM pairs),
      x AS (SELECT *, text || [' See 12 items.', ' In seven days.', ' Only 99 left.', ' Visit www.example.org now.', ''][m + 1] AS "full" FROM c),
      y AS (SELECT *, list_transform(regexp_extract_all("full", '\\d+'), lambda n: CAST(n AS HUGEINT)) AS nums,
          list_transform(regexp_extract_all(block, '\\d+'), lambda n: CAST(n AS HUGEINT)) AS allowed, {_NAMES.format(text='"full"')} AS found FROM x)
      SELECT conv_id, turn, CASE WHEN block IS NULL THEN 'no-input' WHEN length(trim("full", ' ' || chr(10))) > 700 THEN 'over'
        WHEN regexp_matches("full", '(?i)(https?://|www\\.|\\b[a-z0-9-]{{2,}}\\.(com|org|net|edu|gov|io|ai|co)\\b)') THEN 'contains a URL'
        WHEN length(list_filter(nums, lambda n: NOT list_contains(allowed, n))) > 0 THEN 'contains the number'
        WHEN m = 1 AND NOT list_contains(allowed, 7) THEN 'says'
        WHEN length(list_filter(found, lambda x: NOT contains(lower(block), lower(x)))) > 0 THEN 'names' ELSE 'grounded' END AS verdict FROM y""",
    "name_grounding": """
      SELECT CASE WHEN a.conv_id % 2 = 0 THEN 'grounded' ELSE 'names "Marshall", which is not in the input' END AS verdict, count(*) AS replies
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant' GROUP BY ALL""",
    "reply_name_grounding": f"""
      WITH {_PAIRS}, c AS (SELECT conv_id, turn, text || ' However, Rhodes and Marshall remain open.' AS t,
          lower(CASE WHEN conv_id % 2 = 0 THEN 'rhodes, marshall: ' ELSE 'rhodes only: ' END || said) AS block FROM pairs)
      SELECT conv_id, turn, CASE WHEN block IS NULL THEN 'no-input'
        ELSE array_to_string(list_filter({_NAMES.format(text="t")}, lambda x: NOT contains(block, lower(x))), '|') END AS names FROM c""",
    "lane_order": """
      WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS item_id, o_totalprice AS score,
          ['conferences', 'deadlines', 'mstp-labs', 'elsewhere'][o_orderkey % 4 + 1] AS lane FROM orders WHERE o_orderkey % 50 <> 0)
      SELECT CAST(date AS VARCHAR) AS date, lane, item_id, row_number() OVER (PARTITION BY date
        ORDER BY CASE lane WHEN 'deadlines' THEN 0 WHEN 'mstp-labs' THEN 1 WHEN 'conferences' THEN 2 ELSE 3 END, score DESC, item_id) AS rank FROM o""",
    "previous_openers": """
      WITH o AS (SELECT DISTINCT o_orderpriority AS archive, CAST(o_orderdate AS DATE) AS date FROM orders),
      w AS (SELECT *, archive || ' opens ' || CAST(date AS VARCHAR) AS opener FROM o WHERE (date - DATE '1970-01-01') % 5 <> 0),
      l AS (SELECT archive, date, opener, lag(opener, 1) OVER p AS two, lag(opener, 2) OVER p AS three FROM w WINDOW p AS (PARTITION BY archive ORDER BY date))
      SELECT o.archive, CAST(o.date AS VARCHAR) AS date, coalesce(opener, '') AS opener_1, coalesce(two, '') AS opener_2, coalesce(three, '') AS opener_3
      FROM o ASOF LEFT JOIN l ON o.archive = l.archive AND o.date > l.date""",
    "ledger_as_of": """
      WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
      b AS (SELECT user_id, sec AS bought, max(value) AS paid FROM e WHERE event_type = 'purchase' GROUP BY ALL)
      SELECT event_id, coalesce(paid, -1) AS paid, coalesce(bought, -1) AS bought
      FROM (SELECT * FROM e WHERE event_type <> 'purchase') x ASOF LEFT JOIN b ON x.user_id = b.user_id AND x.sec >= b.bought""",
    "input_blocks": """
      WITH r AS (SELECT CAST(o_orderdate AS DATE) AS date, *, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR)) AS rn FROM orders QUALIFY rn <= 12)
      SELECT CAST(date AS VARCHAR) AS date, left(sha256('Digest date: ' || CAST(date AS VARCHAR) || chr(10) || 'Items: ' || CAST(count(*) AS VARCHAR) || chr(10) || chr(10)
        || string_agg('- [' || o_orderstatus || '] (score ' || printf('%.2f', o_totalprice) || ') Order ' || CAST(o_orderkey AS VARCHAR) || chr(10) || '  '
          || CAST(o_orderkey % 9 AS VARCHAR) || ' days remaining. ' || o_orderpriority, chr(10) ORDER BY rn)), 16) AS digest FROM r GROUP BY date""",
    "registry_problems": "SELECT rule, CAST(sum(problems) AS BIGINT) AS problems FROM (("
    + _PROGRAM_RULES + ") UNION ALL (" + _CYC_AS_THEY_ARE + _CYCLE_RULES + ") UNION ALL (" + _STEP_RULES + ")) GROUP BY rule",
    "resolve_bad_zones": _BAD
    + f""", g AS (SELECT CASE WHEN o.status = 'ruled-out' THEN 'ruled-out' WHEN o.status = 'watch' AND DATE '{X.TODAY}' < o.watch_from THEN 'not-yet-watched'
          WHEN o.status = 'closed' THEN 'closed' WHEN f.time_zone = 'Mars/Olympus' THEN 'unknown-zone' ELSE 'resolved' END AS outcome
        FROM f JOIN obligations o ON o.key = f.key)
      SELECT outcome, count(*) AS programs FROM g GROUP BY outcome""",
    "cycle_problems": _CYC + _CYCLE_RULES,
    "step_problems": _STEP_RULES,
    "move_problems": """SELECT CASE WHEN l_quantity = 13 THEN 'move-not-finite' ELSE 'move-too-large' END AS rule, count(*) AS problems
      FROM lineitem WHERE l_quantity = 13 OR abs((l_extendedprice - 50000) / 700) >= 60 GROUP BY ALL""",
    "lane_references": """
      WITH o AS (SELECT o_orderkey AS k, ['deadlines', 'fellowships', 'conferences', 'elsewhere'][o_orderkey % 4 + 1] AS lane FROM orders)
      SELECT 'missing item' AS problem, lane, count(*) AS "references" FROM o WHERE k % 50 = 0 GROUP BY ALL
      UNION ALL SELECT 'listed twice', lane, count(*) FROM o WHERE k % 50 = 1 GROUP BY ALL
      UNION ALL SELECT 'unknown lane', lane, sum(CASE WHEN k % 50 IN (0, 1) THEN 2 ELSE 1 END)::BIGINT FROM o WHERE lane = 'elsewhere' GROUP BY ALL""",
    "silence_guard": """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, count(*) AS deadlines_tracked FROM orders
      GROUP BY CAST(o_orderdate AS DATE) HAVING count(*) FILTER (WHERE o_orderpriority = '1-URGENT') = 0""",
}
