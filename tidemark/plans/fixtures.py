"""Reference-shaped inputs derived from the driver's tables, on Spark and in SQL.

Every row of the base tables takes part; nothing is sampled, filtered or cut.
Keys only choose which *kind* of row each one becomes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.common import stage
from tidemark.operators.obligations import Clock
from tidemark.session import prepare

AS_OF = "1998-06-15 12:00:00"
TODAY = "1998-06-15"
CLOCK = Clock(AS_OF)

LANE_OF_SEGMENT = {
    "AUTOMOBILE": "deadlines",
    "BUILDING": "fellowships",
    "FURNITURE": "mstp-labs",
    "HOUSEHOLD": "conferences",
    "MACHINERY": "venture-founder",
}
ZONE_OF_REGION = {
    0: "Africa/Nairobi",
    1: "America/New_York",
    2: "Asia/Tokyo",
    3: "Europe/London",
    4: "Asia/Kolkata",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df if name in ("nation", "region") else spread(df)


def spread(df: DataFrame) -> DataFrame:
    """Give a small one-file table to every core.

    A scan of many files or row groups already has more partitions than cores
    and is left as it is, so nothing is shuffled where the data is large.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    partitions = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if partitions >= cores else df.repartition(cores)


def _case(expr: str, mapping: dict) -> str:
    whens = " ".join(
        f"WHEN {k!r} THEN {v!r}" if isinstance(k, str) else f"WHEN {k} THEN {v!r}" for k, v in mapping.items()
    )
    return f"CASE {expr} {whens} END"


# One statement of each derived column, valid in both engines.
K = "o_orderkey"
LABEL = (
    f"concat('Order ', CAST({K} AS STRING), CASE {K} % 4 WHEN 0 THEN ' Fellowship' WHEN 1 THEN ' Awards (US)' "
    "WHEN 2 THEN ': Program' ELSE '' END)"
)
STATUS = (
    f"CASE WHEN {K} % 37 = 0 THEN 'ruled-out' WHEN {K} % 41 = 1 THEN 'closed' "
    "WHEN o_orderstatus = 'P' THEN 'watch' ELSE 'active' END"
)
KIND = f"CASE WHEN {K} % 10 = 1 THEN 'rolling' WHEN {K} % 10 = 0 THEN 'unknown' END"
PRECISION = f"CASE WHEN {K} % 7 = 0 THEN 'month' ELSE NULL END"
TOD = f"CASE WHEN {K} % 3 = 0 THEN '17:00' ELSE NULL END"
PRIORITY = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'normal' END"
CADENCE = f"CASE WHEN {K} % 4 = 2 THEN 'thrice-yearly' WHEN {K} % 4 = 3 THEN 'biennial' ELSE 'annual' END"
URL = f"CASE WHEN {K} % 2 = 0 THEN concat('https://example.org/p/', CAST({K} AS STRING)) END"
LANE = _case("c_mktsegment", LANE_OF_SEGMENT)
ZONE = _case("n_regionkey", ZONE_OF_REGION)


OBLIGATION = (
    "program_id",
    f"{K} AS key",
    f"{LABEL} AS label",
    f"{LANE} AS lane",
    f"{STATUS} AS status",
    f"{PRIORITY} AS priority",
    f"{URL} AS url",
    f"{ZONE} AS time_zone",
    f"CASE WHEN {K} % 23 <> 0 THEN date_sub(DATE '{TODAY}', CAST({K} % 200 AS INT)) END AS verified_on",
    "90 AS verify_every",
    "CAST(o_orderdate AS DATE) AS due",
    "date_sub(CAST(o_orderdate AS DATE), 120) AS watch_from",
    f"{KIND} AS kind",
    "o_orderstatus = 'F' AS confirmed",
    f"{PRECISION} AS precision",
    f"{TOD} AS time_of_day",
    f"{CADENCE} AS cadence",
)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with what their customers add to them, few and narrow columns for the shuffles."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # 25 nations by definition of the data set
    people = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
    return joined.withColumn("program_id", F.col("o_orderkey").cast("string"))


def obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat row per order, before its cycles and steps are attached."""
    return _orders(spark, sf_dir).selectExpr(*OBLIGATION)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (order, line number). Lines are shuffled once, to where their programme's row is made."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("step_program"),
        "l_linenumber",
        (F.col("l_returnflag") == "R").alias("returned"),
        (F.col("l_linestatus") == "F").alias("filled"),
    )
    return lines.repartition("step_program").groupBy("step_program", "l_linenumber").agg(
        F.bool_or("returned").alias("gating"), F.bool_and("filled").alias("done")
    )


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry: nested cycles and steps. A line number is 1..7, so a row holds seven steps at most.

    Its rows come by ``program_id``, so what joins them by it moves to them.
    """
    s = (
        steps(spark, sf_dir)
        .groupBy("step_program")
        .agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "gating", "done"))).alias("raw_steps"))
    )
    df = _orders(spark, sf_dir).join(s, F.col("program_id") == F.col("step_program"), "left").selectExpr(*OBLIGATION, "raw_steps")
    step = lambda shift: f"""
        transform(coalesce(raw_steps, array()), s -> named_struct(
            'id', concat('s', CAST(s.l_linenumber AS STRING)),
            'label', concat('Step ', CAST(s.l_linenumber AS STRING)),
            'due', CASE WHEN s.l_linenumber = 1 AND key % 5 = 0 THEN NULL
                   ELSE CAST(date_sub(add_months(due, {shift}), 7 * s.l_linenumber) AS STRING) END,
            'time_of_day', CAST(NULL AS STRING),
            'precondition', CASE WHEN s.l_linenumber > 1 THEN concat('s', CAST(s.l_linenumber - 1 AS STRING)) END,
            'system', CAST(NULL AS STRING),
            'gating', s.gating,
            'status', CASE WHEN s.done THEN 'done' ELSE 'pending' END,
            'note', CAST(NULL AS STRING)))"""
    cycle = lambda shift: f"""
        named_struct(
            'year', year(add_months(due, {shift})),
            'deadline', CASE WHEN kind IS NULL THEN CAST(add_months(due, {shift}) AS STRING) END,
            'confirmed', confirmed, 'kind', kind,
            'time_of_day', CASE WHEN kind IS NULL THEN time_of_day END,
            'precision', precision,
            'verify_by', CASE WHEN kind IS NULL AND NOT confirmed THEN date_sub(add_months(due, {shift}), 60) END,
            'evidence', CAST(NULL AS STRING),
            'steps', {step(shift)}, 'note', CAST(NULL AS STRING))"""
    out = df.selectExpr(
        "program_id", "label", "CAST(NULL AS STRING) AS org", "lane", "status", "priority", "url", "time_zone",
        "verified_on", "verify_every", "watch_from",
        "CASE WHEN key % 3 = 0 THEN date_add(due, CAST(key % 500 - 50 AS INT)) END AS event_start",
        "CAST(NULL AS DATE) AS event_end", "CAST(NULL AS STRING) AS venue",
        "CASE WHEN status = 'ruled-out' AND key % 2 = 0 THEN named_struct('reason', 'not eligible', 'citation', CAST(NULL AS STRING)) END AS ruled_out",
        f"array({cycle(-12)}, {cycle(0)}, {cycle(12)}) AS cycles",
        "named_struct('cadence', cadence, 'anchor', date_format(due, 'MM-dd'), "
        "'anchors', array('04-08', '08-08', '12-08')) AS recurrence",
        "CAST(NULL AS STRUCT<notes: STRING>) AS eligibility", "CAST(NULL AS STRING) AS note",
    )
    # a filter on the cycles must not build them a second time
    return stage(out, {"cycles": F.col("cycles")}).select(*out.columns)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items from documents: every document, its whole text, its whole first line as title."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    q = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return d.join(q, "doc_id", "left").selectExpr(
        "doc_id", "source AS source_id",
        "concat('group', CAST(CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 7 AS STRING)) AS publisher_group",
        "CASE WHEN doc_id % 5 = 0 THEN 'jobs' WHEN doc_id % 5 = 1 THEN 'journal' WHEN doc_id % 5 = 2 THEN 'preprint' ELSE 'news' END AS source_kind",
        "0.5D + 0.25D * coalesce(quality, 0) AS authority",
        "map('tools-platforms', 0.2D, 'causal-genetics', 0.1D) AS lane_hints",
        "split_part(text, '\n', 1) AS title", "text AS body",
        "concat('https://news.example.org/', source, '/', CAST(doc_id AS STRING)) AS url",
        "CASE WHEN doc_id % 29 <> 0 THEN timestampadd(DAY, CAST(-(doc_id % 45) AS INT), TIMESTAMP '" + AS_OF + "') END AS published_at",
    )


SQL_ITEMS = f"""
items AS (
  SELECT d.doc_id, source AS source_id,
    'group' || CAST(CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 7 AS VARCHAR) AS publisher_group,
    CASE d.doc_id % 5 WHEN 0 THEN 'jobs' WHEN 1 THEN 'journal' WHEN 2 THEN 'preprint' ELSE 'news' END AS source_kind,
    0.5 + 0.25 * coalesce(quality, 0) AS authority, split_part(text, chr(10), 1) AS title, text AS body,
    'https://news.example.org/' || source || '/' || CAST(d.doc_id AS VARCHAR) AS url,
    CASE WHEN d.doc_id % 29 <> 0 THEN TIMESTAMP '{AS_OF}' - INTERVAL (d.doc_id % 45) DAY END AS published_at
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
)
"""


# ---- the same in SQL: long form, joins and windows instead of nested arrays ----

SQL_OBLIGATIONS = f"""
obligations AS (
  SELECT CAST({K} AS VARCHAR) AS program_id, {K} AS key, {LABEL} AS label, {LANE} AS lane, {STATUS} AS status,
         {PRIORITY} AS priority, {URL} AS url, {ZONE} AS time_zone,
         CASE WHEN {K} % 23 <> 0 THEN DATE '{TODAY}' - CAST({K} % 200 AS INTEGER) END AS verified_on,
         90 AS verify_every, CAST(o_orderdate AS DATE) AS due, CAST(o_orderdate AS DATE) - 120 AS watch_from,
         {KIND} AS kind, o_orderstatus = 'F' AS confirmed, {PRECISION} AS precision, {TOD} AS time_of_day,
         {CADENCE} AS cadence
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
today AS (SELECT DATE '{TODAY}' AS today, TIMESTAMP '{AS_OF}' AS now_utc)
"""

SQL_STEPS = """
steps AS (
  SELECT l_orderkey AS key, l_linenumber AS pos, bool_or(l_returnflag = 'R') AS gating,
         bool_and(l_linestatus = 'F') AS done
  FROM lineitem GROUP BY ALL
)
"""

# gate, all cycles, the active cycle, the resolved deadline, the effective target
SQL_RESOLVED = (
    SQL_OBLIGATIONS
    + ","
    + SQL_STEPS
    + f""",
gated AS (
  SELECT * FROM obligations
  WHERE status IN ('active', 'watch') AND NOT (status = 'watch' AND DATE '{TODAY}' < watch_from)
),
cycles AS (
  SELECT o.*, CAST(due + INTERVAL (shift) MONTH AS DATE) AS cdue, shift,
         CASE WHEN kind IS NULL THEN
           timezone(time_zone, CAST(CAST(due + INTERVAL (shift) MONTH AS DATE) AS TIMESTAMP)
             + CASE WHEN time_of_day IS NULL THEN INTERVAL '23 hours 59 minutes' ELSE INTERVAL '17 hours' END)
         END AS ends
  FROM gated o CROSS JOIN (VALUES (-12), (0), (12)) s(shift)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY
      CASE WHEN ends IS NULL THEN 1 WHEN ends + INTERVAL 2 DAY >= TIMESTAMPTZ '{AS_OF}+00' THEN 0 ELSE 2 END,
      CASE WHEN ends + INTERVAL 2 DAY >= TIMESTAMPTZ '{AS_OF}+00' THEN epoch(ends) END,
      CASE WHEN ends IS NOT NULL THEN -epoch(ends) END, shift) AS rn
  FROM cycles
),
active AS (
  SELECT *, ends IS NOT NULL AND ends + INTERVAL 2 DAY < TIMESTAMPTZ '{AS_OF}+00' AS rolled FROM ranked WHERE rn = 1
),
anchors AS (
  SELECT program_id, time_zone, a AS anchor FROM active, unnest(
    CASE WHEN cadence = 'annual' THEN [strftime(due, '%m-%d')]
         WHEN cadence = 'thrice-yearly' THEN ['04-08', '08-08', '12-08'] ELSE [] END) t(a)
  WHERE rolled
),
nexts AS (
  SELECT program_id, min(inst) AS next_at FROM (
    SELECT program_id, timezone(time_zone, try_strptime(CAST(y AS VARCHAR) || '-' || anchor, '%Y-%m-%d')
           + INTERVAL '23 hours 59 minutes') AS inst
    FROM anchors, (VALUES (1998), (1999), (2000)) v(y))
  WHERE inst > TIMESTAMPTZ '{AS_OF}+00' GROUP BY program_id
),
headline AS (
  SELECT a.*, year(cdue) + CASE WHEN rolled THEN 1 ELSE 0 END AS cycle_year,
    CASE WHEN rolled THEN CASE WHEN next_at IS NULL THEN 'unknown' ELSE 'projected' END
         WHEN kind IS NOT NULL THEN kind WHEN confirmed THEN 'confirmed' ELSE 'projected' END AS dkind,
    CASE WHEN rolled THEN CAST(timezone(time_zone, next_at) AS DATE) WHEN kind IS NULL THEN cdue END AS ddate,
    CASE WHEN rolled AND next_at IS NULL THEN NULL WHEN kind IS NULL THEN time_of_day END AS dtod,
    CASE WHEN rolled THEN CASE WHEN next_at IS NULL THEN 'unknown' WHEN time_of_day IS NULL THEN 'day' ELSE 'minute' END
         WHEN kind IS NOT NULL THEN 'unknown' WHEN precision = 'month' THEN 'month'
         WHEN time_of_day IS NULL THEN 'day' ELSE 'minute' END AS dprecision,
    CASE WHEN rolled THEN CAST(timezone(time_zone, next_at - INTERVAL (60 * 24) HOUR) AS DATE)
         WHEN kind IS NULL AND NOT confirmed THEN cdue - 60 END AS verify_by,
    CASE WHEN rolled THEN 'derived' ELSE 'yaml' END AS provenance
  FROM active a LEFT JOIN nexts USING (program_id)
),
live_steps AS (
  SELECT h.program_id, s.pos, s.gating, CASE WHEN rolled THEN FALSE ELSE s.done END AS done,
         CASE WHEN rolled OR (s.pos = 1 AND h.key % 5 = 0) THEN NULL ELSE cdue - 7 * s.pos END AS sdue
  FROM headline h JOIN steps s USING (key)
),
step_agg AS (
  SELECT program_id, bool_or(gating) AS any_gating,
         min(sdue) FILTER (WHERE gating AND NOT done) AS soonest,
         arg_min(pos, sdue) FILTER (WHERE gating AND NOT done AND sdue IS NOT NULL) AS soonest_pos,
         min(pos) FILTER (WHERE gating AND NOT done AND sdue IS NULL) AS undated_pos
  FROM live_steps GROUP BY program_id
),
next_steps AS (
  SELECT p.program_id, min(p.pos) AS next_pos, arg_min_null(p.sdue, p.pos) AS next_due
  FROM live_steps p LEFT JOIN live_steps d ON d.program_id = p.program_id AND d.pos = p.pos - 1 AND d.done
  WHERE NOT p.done AND (p.pos = 1 OR d.pos IS NOT NULL) GROUP BY p.program_id
),
targeted AS (
  SELECT h.*, coalesce(any_gating, FALSE) AS any_gating, soonest, undated_pos, next_pos, next_due,
    'Step ' || CAST(undated_pos AS VARCHAR) AS undated_gating,
    CASE WHEN soonest IS NOT NULL THEN
           'Step ' || CAST(soonest_pos AS VARCHAR) || CASE WHEN undated_pos IS NOT NULL
             THEN ' (but Step ' || CAST(undated_pos AS VARCHAR) || ' comes first)' ELSE '' END
         WHEN undated_pos IS NOT NULL AND ddate IS NULL THEN 'Step ' || CAST(undated_pos AS VARCHAR)
         WHEN undated_pos IS NOT NULL THEN 'Step ' || CAST(undated_pos AS VARCHAR) || ' (date unknown)'
         ELSE 'Application deadline' END AS target_label,
    CASE WHEN soonest IS NOT NULL OR (undated_pos IS NOT NULL AND ddate IS NULL) THEN TRUE
         ELSE coalesce(any_gating, FALSE) END AS gating,
    coalesce(soonest, ddate) AS tdate,
    CASE WHEN soonest IS NOT NULL THEN NULL ELSE dtod END AS ttod
  FROM headline h LEFT JOIN step_agg USING (program_id) LEFT JOIN next_steps USING (program_id)
),
resolved0 AS (
  SELECT *, timezone(time_zone, CAST(tdate AS TIMESTAMP)
      + CASE WHEN ttod IS NULL THEN INTERVAL '23 hours 59 minutes' ELSE INTERVAL '17 hours' END) AS inst,
    CASE WHEN soonest IS NOT NULL AND soonest IS DISTINCT FROM ddate
         THEN CASE WHEN precision = 'month' THEN 'month' ELSE 'day' END ELSE dprecision END AS fprecision
  FROM targeted
),
resolved AS (
  SELECT *, date_diff('day', CAST(timezone(time_zone, TIMESTAMPTZ '{AS_OF}+00') AS DATE),
                             CAST(timezone(time_zone, inst) AS DATE)) AS days_until,
    DATE '{TODAY}' - verified_on AS stale_days,
    CASE WHEN undated_pos IS NOT NULL THEN 'gating step without a date: ' || undated_gating
         WHEN dkind = 'unknown' THEN 'no date known'
         WHEN fprecision = 'month' THEN 'month known, day missing: no alert'
         WHEN verify_by <= DATE '{TODAY}' THEN 'to be confirmed by ' || CAST(verify_by AS VARCHAR) || ', which is past'
         WHEN DATE '{TODAY}' - verified_on > verify_every
           THEN 'not checked for ' || CAST(DATE '{TODAY}' - verified_on AS VARCHAR) || ' days'
         WHEN verified_on IS NULL AND dkind IN ('confirmed', 'projected') THEN 'never checked'
    END AS verify_reason
  FROM resolved0
)
"""
)

_HORIZON = "CASE lane WHEN 'conferences' THEN 240 WHEN 'venture-founder' THEN 180 ELSE 400 END"
_LEAD = (
    "CASE lane WHEN 'deadlines' THEN 45 WHEN 'fellowships' THEN 35 WHEN 'mstp-labs' THEN 60 "
    "WHEN 'conferences' THEN 21 ELSE 30 END"
)
SQL_SCORED = (
    SQL_RESOLVED
    + f""",
urgent AS (
  SELECT *, CASE WHEN dkind = 'rolling' THEN 0.25
                 WHEN dkind = 'unknown' OR days_until IS NULL THEN 0.35
                 ELSE (CASE WHEN days_until < 0 OR days_until > {_HORIZON} THEN 0
                            WHEN days_until = 0 THEN 1
                            ELSE 1 / (1 + power(CAST(days_until AS DOUBLE) / {_LEAD}, 2.2)) END)
                      * CASE WHEN dkind = 'projected' THEN 0.7 ELSE 1 END
                      * CASE WHEN fprecision = 'month' THEN 0.6 ELSE 1 END END AS urgency_raw,
    days_until BETWEEN 0 AND 7 AS e_imminent, days_until < 0 AS e_passed,
    verify_by <= DATE '{TODAY}' AS e_verify,
    date_diff('day', CAST(timezone(time_zone, TIMESTAMPTZ '{AS_OF}+00') AS DATE), next_due) <= 14 AS e_step
  FROM resolved
),
scored AS (
  SELECT *, floor(greatest(0, 30 * urgency_raw + CASE WHEN gating THEN 16 ELSE 0 END
      + 14 * CASE WHEN e_imminent THEN 1.0 WHEN e_verify THEN 0.9 WHEN e_step THEN 0.85 WHEN e_passed THEN 0.2 ELSE 0 END
      + CASE WHEN priority = 'high' THEN 14 ELSE 0 END
      - CASE WHEN dkind = 'rolling' THEN 0 WHEN dkind = 'unknown' OR days_until IS NULL THEN 4
             WHEN dkind = 'projected' THEN 3 ELSE 0 END) * 100 + 0.5) / 100 AS score
  FROM urgent
)
"""
)
