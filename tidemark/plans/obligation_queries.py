"""Registered queries over obligations, their strip, their alarms and their ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import scoring as S
from tidemark.functions.ids import calendar_uid, obligation_id
from tidemark.functions.text import subject_label
from tidemark.operators import ledgers as L
from tidemark.operators import news as N
from tidemark.operators import obligations as O
from tidemark.operators import reports as R
from tidemark.operators.ranking import ranked
from tidemark.plans import fixtures as X
from tidemark.session import checkpoint_root, materialize
from tidemark.sources.buckets import BucketedState

CLOCK = X.CLOCK
NOW = X.AS_OF


def _resolved(spark, sf):
    return O.resolve(X.programs(spark, sf), CLOCK)


def _scored(spark, sf):
    return O.score(O.add_events(O.add_urgency(_resolved(spark, sf)), CLOCK))


def _strip(spark, sf):
    return O.countdown_rows(_resolved(spark, sf), CLOCK)


def zone_days_until(spark, sf):
    o = X.obligations(spark, sf)
    zone = F.col("time_zone")
    parsed = D.parse_deadline(F.col("due").cast("string"), zone, CLOCK.at, F.col("time_of_day"), F.col("precision"))
    df = o.select("program_id", "time_zone", parsed.alias("p"))
    return df.select(
        "program_id",
        F.date_format("p.instant", "yyyy-MM-dd HH:mm:ss").alias("instant_utc"),
        F.col("p.precision").alias("precision"),
        D.days_until(F.col("p.instant"), F.col("time_zone"), CLOCK.at).cast("long").alias("days_until"),
        F.round(D.hours_until(F.col("p.instant"), CLOCK.at), 4).alias("hours_until"),
    )


def next_anchor(spark, sf):
    o = X.obligations(spark, sf)
    at = F.to_utc_timestamp(F.col("due").cast("timestamp"), F.col("time_zone"))
    df = o.select("program_id", "time_zone", at.alias("after"), F.date_format("due", "MM-dd").alias("anchor"))
    df = df.select(
        "program_id",
        D.next_anchor(F.col("anchor"), F.col("after"), F.col("time_zone")).alias("one"),
        D.next_of_anchors(
            F.array(F.lit("04-08"), F.lit("08-08"), F.lit("12-08")), F.col("after"), F.col("time_zone")
        ).alias("many"),
    )
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return df.select("program_id", text("one").alias("next_annual"), text("many").alias("next_of_three"))


def status_gate(spark, sf):
    gated = O.status_gate(X.programs(spark, sf), CLOCK)
    return gated.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome"), "status").agg(
        F.count("*").alias("programs")
    )


def active_cycle(spark, sf):
    gated = O.status_gate(X.programs(spark, sf), CLOCK).filter("drop_reason IS NULL")
    df = O.resolve_deadline(O.active_cycle(gated, CLOCK), CLOCK)
    d = F.col("deadline")
    return df.select(
        "program_id",
        "rolled",
        d["kind"].alias("kind"),
        d["date"].alias("deadline_date"),
        d["precision"].alias("precision"),
        d["cycle_year"].cast("long").alias("cycle_year"),
        d["cycle_year_confident"].alias("confident"),
        d["verify_by"].cast("string").alias("verify_by"),
        d["provenance"].alias("provenance"),
    )


def effective_target(spark, sf):
    return _resolved(spark, sf).select(
        "program_id",
        F.col("target.label").alias("target_label"),
        F.col("target.gating").alias("gating"),
        F.col("target.date").alias("target_date"),
        "undated_gating",
        F.col("deadline.precision").alias("precision"),
        F.date_format("instant", "yyyy-MM-dd HH:mm:ss").alias("instant_utc"),
    )


def next_step(spark, sf):
    df = _resolved(spark, sf).select("program_id", "steps", "next_index")
    step = F.get("steps", F.when(F.col("next_index") >= 0, F.col("next_index")))
    return df.select(
        "program_id", F.coalesce(step["id"], F.lit("none")).alias("next_step"), step["due"].alias("next_due")
    )


def verify_queue(spark, sf):
    rows = O.verify_rows(_resolved(spark, sf))
    return rows.select("program_id", "label", "reason", F.coalesce("stale_days", F.lit(0)).cast("long").alias("stale"), "url")


def verify_order(spark, sf):
    """Every row of the verify queue with its place: the longest unverified first."""
    rows = ranked(O.verify_rows(_resolved(spark, sf)), O.verify_order())
    return rows.select("program_id", "rank")


def urgency(spark, sf):
    return O.add_urgency(_resolved(spark, sf)).select(
        "program_id",
        F.round("urgency.raw", 6).alias("urgency"),
        F.array_join("urgency.penalties", ",").alias("penalties"),
    )


def score_obligations(spark, sf):
    return _scored(spark, sf).select(
        "program_id",
        "score",
        F.array_join("events", ",").alias("events"),
        S.why_line(F.col("factors")).alias("why"),
        F.size("penalties").cast("long").alias("penalties"),
    )


def countdown_strip(spark, sf):
    rows = _strip(spark, sf)
    return rows.select(
        "program_id", "label", "target", "date", F.col("days_until").cast("long").alias("days_until"), "kind",
        "precision", "gating", "needs_verification", "url",
    )


def binding_due_soon(spark, sf):
    """What is due within sixty days, what binds first, how urgent it is, what to verify."""
    df = O.add_urgency(_resolved(spark, sf))
    rows = df.filter(F.col("days_until").between(-2, 60))
    return rows.select(
        "program_id", "label", "lane", F.col("target.label").alias("target"),
        F.col("days_until").cast("long").alias("days_until"), F.round("urgency.raw", 6).alias("urgency"),
        F.col("target.gating").alias("gating"), F.coalesce("verify_reason", F.lit("")).alias("verify_reason"),
    ).orderBy("days_until", "label", "program_id")


def strip_selection(spark, sf):
    return R.select_strip(_strip(spark, sf)).select(
        F.col("rank").cast("long").alias("rank"), "program_id", F.col("days_until").cast("long").alias("days_until"), "gating", "label"
    )


def strip_fallback(spark, sf):
    """Nothing inside a horizon of minus ten days, so the nearest three are borrowed."""
    return R.select_strip(_strip(spark, sf), horizon=-10).select(
        F.col("rank").cast("long").alias("rank"), "program_id", F.col("days_until").cast("long").alias("days_until")
    )


def strip_summary(spark, sf):
    return R.strip_summary(_strip(spark, sf))


def escalation_pick(spark, sf):
    return R.escalation(_strip(spark, sf))


def escalation_loose(spark, sf):
    return R.escalation(_strip(spark, sf), strict=False)


def next_unverified(spark, sf):
    resolved = _resolved(spark, sf)
    return R.next_unverified(O.verify_rows(resolved), O.countdown_rows(resolved, CLOCK))


def verify_headline(spark, sf):
    return R.verify_headline(O.verify_rows(_resolved(spark, sf)))


def alert_eligibility(spark, sf):
    d = F.col("deadline")
    df = _resolved(spark, sf).select(
        d["kind"].alias("kind"), d["precision"].alias("precision"), d["provenance"].alias("provenance")
    )
    ok = S.can_alert(F.col("kind"), F.col("precision"), F.col("provenance"))
    return df.groupBy("kind", "precision", "provenance", ok.alias("can_alert")).agg(F.count("*").alias("rows"))


def obligation_stats(spark, sf):
    return R.obligation_stats(_scored(spark, sf))


def staleness_by_kind(spark, sf):
    d = F.col("deadline")
    df = _resolved(spark, sf)
    as_opportunity = N.is_stale(
        F.lit("opportunity"), d["kind"], F.col("days_until"), F.col("lane"), F.col("verified_on").cast("timestamp"), CLOCK.at
    )
    as_news = N.is_stale(
        F.lit("news"), d["kind"], F.col("days_until"), F.col("lane"), F.col("verified_on").cast("timestamp"), CLOCK.at
    )
    return df.groupBy("lane", d["kind"].alias("kind")).agg(
        F.count_if(as_opportunity).alias("stale_obligations"), F.count_if(as_news).alias("stale_news")
    )


def _ledgers(spark, sf):
    """Ledgers left by earlier runs: a rung for every other order, a delivery for every order, dated by its key."""
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    pid = F.col("o_orderkey").cast("string")
    rung = F.element_at(F.array(*[F.lit(r) for r in (365, 90, 30, 7, 0)]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rungs = o.select(
        pid.alias("program_id"), (F.year("o_orderdate") + (F.col("o_orderkey") % 2)).cast("int").alias("cycle_year"), rung.alias("rung")
    )
    rolling = o.select(
        pid.alias("program_id"), F.date_sub(F.lit(X.TODAY).cast("date"), (F.col("o_orderkey") % 90).cast("int")).alias("last_delivered")
    )
    return rungs, rolling


def _built(spark, sf):
    return O.build(X.programs(spark, sf), CLOCK, *_ledgers(spark, sf))


def keep_decisions(spark, sf):
    return _built(spark, sf).select(
        "program_id", F.coalesce(F.col("rung").cast("string"), F.lit("")).alias("rung"), "must_show",
        F.coalesce("drop_reason", F.lit("kept")).alias("outcome"),
    )


def rung_crossing(spark, sf):
    built = _built(spark, sf)
    return L.rungs_delivered(built).select(
        "program_id", F.col("cycle_year").cast("long").alias("cycle_year"), F.col("rung").cast("long").alias("rung")
    )


def rung_ledger_upsert(spark, sf):
    rungs, _ = _ledgers(spark, sf)
    now = materialize(L.rungs_delivered(_built(spark, sf)), "rungs-delivered")
    # a retried run reports twice, and once with a rung that has since been passed
    again = now.unionByName(now).unionByName(now.withColumn("rung", F.col("rung") - 1000))
    merged = L.upsert(rungs, again, ["program_id", "cycle_year"])
    return merged.select(
        "program_id", F.col("cycle_year").cast("long").alias("cycle_year"), F.col("rung").cast("long").alias("rung")
    )


def rung_ledger_buckets(spark, sf):
    """The same ledger kept in buckets: the old rungs, a first half of the run, and the whole run twice over."""
    rungs, _ = _ledgers(spark, sf)
    now = materialize(L.rungs_delivered(_built(spark, sf)), "rungs-delivered")
    keys = ["program_id", "cycle_year"]
    state = BucketedState(spark, f"{checkpoint_root(spark)}/rungs-{uuid.uuid4().hex}", "program_id string, cycle_year int, rung int", keys, 16)
    state.merge(rungs, "1998-06-13")
    state.merge(now.filter(F.col("program_id").cast("long") % 2 == 0), "1998-06-14")
    for _ in range(2):
        state.merge(now, "1998-06-15")
    return state.read().select("program_id", F.col("cycle_year").cast("long").alias("cycle_year"), F.col("rung").cast("long").alias("rung"))


def rung_replay(spark, sf):
    """Cards fired if every dated obligation ran daily to its end."""
    o = X.obligations(spark, sf).select(
        "program_id", D.days_until(
            D.wall_clock_to_utc(F.col("due"), 23, 59, F.col("time_zone")), F.col("time_zone"), CLOCK.at
        ).alias("d")
    )
    return o.select("program_id", L.replay_rungs(F.col("d")).cast("long").alias("cards"))


def rolling_cooldown(spark, sf):
    _, rolling = _ledgers(spark, sf)
    df = X.obligations(spark, sf).filter("kind = 'rolling'").join(rolling, "program_id")
    cooling = L.on_cooldown(F.col("last_delivered"), CLOCK.today)
    return df.groupBy("lane", cooling.alias("cooling")).agg(F.count("*").alias("programs"))


def display_when(spark, sf):
    df = _resolved(spark, sf).filter("instant IS NOT NULL")
    return df.select(
        "program_id",
        D.format_when(F.col("instant"), F.col("time_zone"), F.col("deadline.precision"), CLOCK.reader_zone).alias("shown"),
        D.countdown_phrase(F.col("days_until"), D.hours_until(F.col("instant"), CLOCK.at)).alias("phrase"),
        D.t_minus(F.col("days_until")).alias("t_minus"),
        F.coalesce(D.precision_note(F.col("deadline.precision")), F.lit("")).alias("note"),
        subject_label(F.col("label")).alias("short_label"),
    )


def obligation_ids(spark, sf):
    df = X.obligations(spark, sf).select("program_id", F.year("due").alias("y"), "key")
    step = F.when(F.col("key") % 2 == 0, F.concat(F.lit("Step #"), (F.col("key") % 7).cast("string")))
    return df.select(
        "program_id",
        obligation_id(F.col("program_id"), F.col("y")).alias("obligation_id"),
        obligation_id(F.col("program_id"), F.col("y"), step).alias("step_obligation_id"),
        calendar_uid(F.col("program_id"), F.col("y"), step).alias("uid"),
    )


def drop_accounting(spark, sf):
    gated = O.status_gate(X.programs(spark, sf), CLOCK).select("drop_reason")
    return N.drop_accounting(gated, _built(spark, sf).select("drop_reason"))


def gating_rows(spark, sf):
    df = _resolved(spark, sf)
    step = F.get("steps", F.when(F.col("next_index") >= 0, F.col("next_index")))
    gating = F.coalesce(step["gating"], F.exists("steps", lambda s: s["gating"]))
    return df.groupBy("lane", gating.alias("gating")).agg(F.count("*").alias("rows"))


QUERIES = {
    f.__name__: f
    for f in (
        zone_days_until, next_anchor, status_gate, active_cycle, effective_target, next_step, verify_queue, verify_order, urgency,
        score_obligations, countdown_strip, binding_due_soon, strip_selection, strip_fallback, strip_summary,
        escalation_pick, escalation_loose, next_unverified, verify_headline, alert_eligibility, obligation_stats,
        staleness_by_kind, keep_decisions, rung_crossing, rung_ledger_upsert, rung_ledger_buckets, rung_replay, rolling_cooldown,
        display_when, obligation_ids, drop_accounting, gating_rows,
    )
}

_RES = "WITH " + X.SQL_RESOLVED
_SCO = "WITH " + X.SQL_SCORED
_OBL = "WITH " + X.SQL_OBLIGATIONS
_STRIP = (
    _RES
    + """, strip AS (
  SELECT *, CAST(tdate AS VARCHAR) AS date FROM resolved WHERE inst IS NOT NULL AND days_until BETWEEN -2 AND 60
)"""
)
_WALL = "timezone(time_zone, CAST(due AS TIMESTAMP) + CASE WHEN time_of_day IS NULL THEN INTERVAL '23 hours 59 minutes' ELSE INTERVAL '17 hours' END)"
_TODAY_IN_ZONE = f"CAST(timezone(time_zone, TIMESTAMPTZ '{NOW}+00') AS DATE)"
_UTC = lambda c: f"strftime(timezone('UTC', {c}), '%Y-%m-%d %H:%M:%S')"
_SHORT = r"regexp_replace(regexp_replace(regexp_replace(label, '^(.+?) \(.*$', '\1'), '^(.+?): .*$', '\1'), '(?i)\s+(fellowships?|programs?|awards?)$', '')"
_EVENTS = (
    "concat_ws(',', CASE WHEN e_imminent THEN 'deadline-imminent' END, CASE WHEN e_passed THEN 'deadline-passed' END, "
    "CASE WHEN e_verify THEN 'verify-deadline' END, CASE WHEN e_step THEN 'step-due' END)"
)
_TOP_EVENT = (
    "CASE WHEN e_imminent THEN 'deadline-imminent' WHEN e_verify THEN 'verify-deadline' WHEN e_step THEN 'step-due' "
    "WHEN e_passed THEN 'deadline-passed' END"
)
_T = "CASE WHEN days_until < 0 THEN 'T+' || CAST(-days_until AS VARCHAR) ELSE 'T-' || CAST(days_until AS VARCHAR) END"
_BUILT = (
    _SCO
    + f""",
rungs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS program_id, year(o_orderdate) + o_orderkey % 2 AS cycle_year,
         CASE o_orderkey % 5 WHEN 0 THEN 365 WHEN 1 THEN 90 WHEN 2 THEN 30 WHEN 3 THEN 7 ELSE 0 END AS last_rung
  FROM orders
),
ladder AS (SELECT unnest([365, 180, 90, 60, 45, 30, 21, 14, 10, 7, 6, 5, 4, 3, 2, 1, 0]) AS r),
crossed AS (
  SELECT program_id, cycle_year, min(r) AS crossed FROM scored JOIN ladder ON r >= days_until
  WHERE days_until >= 0 GROUP BY ALL
),
laddered AS (
  SELECT s.*, last_rung,
    CASE WHEN days_until < 0 OR days_until IS NULL THEN NULL
         WHEN days_until <= 7 THEN CASE WHEN last_rung IS NULL OR last_rung > days_until THEN days_until END
         WHEN last_rung IS NULL OR last_rung > crossed THEN crossed END AS rung
  FROM scored s LEFT JOIN rungs USING (program_id, cycle_year) LEFT JOIN crossed USING (program_id, cycle_year)
),
built AS (
  SELECT *, priority = 'high' OR rung IS NOT NULL OR verify_reason IS NOT NULL
      OR coalesce(e_imminent, FALSE) OR coalesce(e_verify, FALSE) AS must_show
  FROM laddered
),
decided AS (
  SELECT *, CASE WHEN dkind = 'rolling' AND key % 90 < 45 THEN 'rolling-cooldown'
                 WHEN days_until < -2 THEN 'deadline-passed'
                 WHEN NOT must_show AND score < 22 THEN 'below-threshold'
                 WHEN NOT must_show AND dkind <> 'rolling' THEN 'no-rung' END AS drop_reason
  FROM built
)"""
)

_LEDGER = """ SELECT coalesce(d.program_id, r.program_id) AS program_id, coalesce(d.cycle_year, r.cycle_year) AS cycle_year,
        coalesce(d.rung, r.last_rung) AS rung
      FROM (SELECT program_id, cycle_year, rung FROM decided WHERE rung IS NOT NULL) d
      FULL JOIN rungs r ON r.program_id = d.program_id AND r.cycle_year = d.cycle_year"""

ORACLES = {
    "zone_days_until": _OBL
    + f""" SELECT program_id, {_UTC(_WALL)} AS instant_utc,
        CASE WHEN precision = 'month' THEN 'month' WHEN time_of_day IS NOT NULL THEN 'minute' ELSE 'day' END AS precision,
        date_diff('day', {_TODAY_IN_ZONE}, CAST(timezone(time_zone, {_WALL}) AS DATE)) AS days_until,
        round((epoch({_WALL}) - epoch(TIMESTAMPTZ '{NOW}+00')) / 3600, 4) AS hours_until
      FROM obligations""",
    "next_anchor": _OBL
    + """, tries AS (
      SELECT program_id, which, timezone(time_zone, CAST(due AS TIMESTAMP)) AS after,
             timezone(time_zone, try_strptime(CAST(year(due) + y AS VARCHAR) || '-' || a, '%Y-%m-%d')
               + INTERVAL '23 hours 59 minutes') AS t
      FROM obligations, (VALUES (0), (1), (2)) v(y),
           unnest([strftime(due, '%m-%d'), '04-08', '08-08', '12-08']) WITH ORDINALITY u(a, which))
      SELECT program_id,
        strftime(timezone('UTC', min(t) FILTER (WHERE which = 1 AND t > after)), '%Y-%m-%d %H:%M:%S') AS next_annual,
        strftime(timezone('UTC', min(t) FILTER (WHERE which > 1 AND t > after)), '%Y-%m-%d %H:%M:%S') AS next_of_three
      FROM tries GROUP BY program_id""",
    "status_gate": _OBL
    + f""" SELECT CASE WHEN status = 'ruled-out' THEN 'ruled-out'
        WHEN status = 'watch' AND DATE '{X.TODAY}' < watch_from THEN 'not-yet-watched'
        WHEN status = 'closed' THEN 'closed' ELSE 'kept' END AS outcome, status, count(*) AS programs
      FROM obligations GROUP BY ALL""",
    "active_cycle": _RES
    + """ SELECT program_id, rolled, dkind AS kind, CAST(ddate AS VARCHAR) AS deadline_date, dprecision AS precision,
        cycle_year, NOT rolled AS confident, CAST(verify_by AS VARCHAR) AS verify_by, provenance FROM headline""",
    "effective_target": _RES
    + f""" SELECT program_id, target_label, gating, CAST(tdate AS VARCHAR) AS target_date, undated_gating,
        fprecision AS precision, {_UTC("inst")} AS instant_utc FROM resolved""",
    "next_step": _RES
    + """ SELECT program_id, coalesce('s' || CAST(next_pos AS VARCHAR), 'none') AS next_step,
        CAST(next_due AS VARCHAR) AS next_due FROM resolved""",
    "verify_queue": _RES
    + """ SELECT program_id, label, verify_reason AS reason, coalesce(stale_days, 0) AS stale, url
      FROM resolved WHERE verify_reason IS NOT NULL""",
    "verify_order": _RES
    + """ SELECT program_id, row_number() OVER (ORDER BY coalesce(stale_days, 0) DESC, label, program_id) AS rank
      FROM resolved WHERE verify_reason IS NOT NULL""",
    "urgency": _SCO
    + """ SELECT program_id, round(urgency_raw, 6) AS urgency,
        CASE WHEN dkind = 'rolling' THEN '' WHEN dkind = 'unknown' OR days_until IS NULL THEN 'deadlineUnknown'
             WHEN dkind = 'projected' THEN 'deadlineProjected' ELSE '' END AS penalties FROM scored""",
    "score_obligations": _SCO
    + f""" SELECT program_id, score, {_EVENTS} AS events,
        'Deadline urgency' || coalesce(' · ' || CASE WHEN gating THEN 'Gating step'
          WHEN {_TOP_EVENT} IS NOT NULL THEN 'Event: ' || {_TOP_EVENT}
          WHEN priority = 'high' THEN 'High priority' END, '') AS why,
        CASE WHEN dkind = 'rolling' THEN 0 WHEN dkind IN ('unknown', 'projected') OR days_until IS NULL THEN 1 ELSE 0 END AS penalties
      FROM scored""",
    "countdown_strip": _STRIP
    + """ SELECT program_id, label, target_label AS target, date, days_until, dkind AS kind, fprecision AS precision,
        gating, verify_reason IS NOT NULL AS needs_verification, url FROM strip""",
    "binding_due_soon": _SCO
    + """ SELECT program_id, label, lane, target_label AS target, days_until, round(urgency_raw, 6) AS urgency, gating,
        coalesce(verify_reason, '') AS verify_reason FROM scored WHERE days_until BETWEEN -2 AND 60""",
    "strip_selection": _STRIP
    + """ SELECT row_number() OVER (ORDER BY days_until, gating DESC, label, program_id) AS rank, program_id,
        days_until, gating, label FROM strip QUALIFY rank <= 30""",
    "strip_fallback": _STRIP
    + """ SELECT row_number() OVER (ORDER BY days_until, gating DESC, label, program_id) AS rank, program_id, days_until
      FROM strip QUALIFY rank <= 3""",
    "strip_summary": _STRIP
    + """ SELECT least(count(*), 30) AS shown, count(*) - least(count(*), 30) AS not_shown, FALSE AS borrowed FROM strip""",
    "escalation_pick": _STRIP
    + f""" SELECT CASE WHEN count(a) > 0 THEN 'gating' WHEN any_value(c) > 0 THEN 'closing' ELSE 'nearest' END AS tier,
        CASE WHEN count(a) > 0 THEN min_by(t, ord) FILTER (WHERE a IS NOT NULL)
             WHEN any_value(c) > 0 THEN CAST(any_value(c) AS VARCHAR) || ' closing soon' ELSE 'next ' || min_by(t, ord) END AS headline,
        any_value(c) AS closing_soon
      FROM (SELECT *, CASE WHEN gating AND days_until <= 14 AND dkind IN ('confirmed', 'projected')
                AND fprecision IN ('day', 'minute') AND provenance = 'yaml' THEN 1 END AS a,
              {_T} || ' ' || {_SHORT} AS t, row_number() OVER (ORDER BY days_until, label, program_id) AS ord,
              count(*) FILTER (WHERE days_until BETWEEN 0 AND 14) OVER () AS c FROM strip)""",
    "escalation_loose": _STRIP
    + f""" SELECT CASE WHEN count(a) > 0 THEN 'gating' WHEN any_value(c) > 0 THEN 'closing' ELSE 'nearest' END AS tier,
        CASE WHEN count(a) > 0 THEN min_by(t, ord) FILTER (WHERE a IS NOT NULL)
             WHEN any_value(c) > 0 THEN CAST(any_value(c) AS VARCHAR) || ' closing soon' ELSE 'next ' || min_by(t, ord) END AS headline,
        any_value(c) AS closing_soon
      FROM (SELECT *, CASE WHEN gating AND days_until <= 14 THEN 1 END AS a,
              {_T} || ' ' || {_SHORT} AS t, row_number() OVER (ORDER BY days_until, label, program_id) AS ord,
              count(*) FILTER (WHERE days_until BETWEEN 0 AND 14) OVER () AS c FROM strip)""",
    "next_unverified": _RES
    + """ SELECT label || ' (stale ' || CAST(stale_days AS VARCHAR) || 'd)' AS next_unverified FROM resolved
      WHERE verify_reason IS NOT NULL AND stale_days IS NOT NULL ORDER BY stale_days DESC, program_id LIMIT 1""",
    "verify_headline": _RES
    + """ SELECT CASE WHEN count(stale_days) = count(*)
          THEN 'VERIFY: ' || CAST(count(*) AS VARCHAR) || ' deadlines unchecked for ' || CAST(min(stale_days) AS VARCHAR) || '+ days'
          ELSE 'VERIFY: ' || CAST(count(*) AS VARCHAR) || ' deadlines need a human' END AS headline, count(*) AS rows
      FROM resolved WHERE verify_reason IS NOT NULL""",
    "alert_eligibility": _RES
    + """ SELECT dkind AS kind, fprecision AS precision, provenance,
        dkind IN ('confirmed', 'projected') AND fprecision IN ('day', 'minute') AND provenance = 'yaml' AS can_alert,
        count(*) AS rows FROM resolved GROUP BY ALL""",
    "obligation_stats": _SCO
    + """ SELECT count(*) AS rows, count(*) FILTER (WHERE dkind NOT IN ('rolling', 'unknown')) AS deadlines_tracked,
        count(*) FILTER (WHERE stale_days <= 7) AS verified_last_7d, median(score) AS median_score FROM scored""",
    "staleness_by_kind": _RES
    + f""" SELECT lane, dkind AS kind,
        count(*) FILTER (WHERE dkind NOT IN ('rolling', 'unknown') AND days_until < -2) AS stale_obligations,
        count(*) FILTER (WHERE epoch(TIMESTAMP '{NOW}') - epoch(CAST(verified_on AS TIMESTAMP)) > 86400 *
          CASE lane WHEN 'mstp-labs' THEN 120 WHEN 'venture-founder' THEN 45 ELSE 3650 END) AS stale_news
      FROM resolved GROUP BY ALL""",
    "keep_decisions": _BUILT
    + """ SELECT program_id, coalesce(CAST(rung AS VARCHAR), '') AS rung, must_show,
        coalesce(drop_reason, 'kept') AS outcome FROM decided""",
    "rung_crossing": _BUILT + " SELECT program_id, cycle_year, rung FROM decided WHERE rung IS NOT NULL",
    "rung_ledger_upsert": _BUILT + _LEDGER,
    "rung_ledger_buckets": _BUILT + _LEDGER,
    "rung_replay": _OBL
    + f""", ladder AS (SELECT unnest([365, 180, 90, 60, 45, 30, 21, 14, 10, 7, 6, 5, 4, 3, 2, 1, 0]) AS r),
      starts AS (SELECT program_id, date_diff('day', {_TODAY_IN_ZONE}, due) AS d FROM obligations),
      bands AS (SELECT r, coalesce(lead(r) OVER (ORDER BY r DESC) + 1, 0) AS low FROM ladder)
      SELECT program_id, count(r) AS cards FROM starts LEFT JOIN bands ON d >= low AND d >= 0 GROUP BY program_id""",
    "rolling_cooldown": _OBL
    + """ SELECT lane, key % 90 < 45 AS cooling, count(*) AS programs FROM obligations WHERE kind = 'rolling' GROUP BY ALL""",
    "display_when": _RES
    + f""", named AS (
      SELECT *, timezone(time_zone, inst) AS here, timezone('America/New_York', inst) AS there,
        (epoch(timezone(time_zone, inst)) - epoch(timezone('UTC', inst))) / 60 AS off,
        (epoch(timezone('America/New_York', inst)) - epoch(timezone('UTC', inst))) / 60 AS noff
      FROM resolved WHERE inst IS NOT NULL),
      abbr AS (SELECT *, CASE WHEN time_zone = 'America/New_York' THEN CASE WHEN off = -240 THEN 'EDT' ELSE 'EST' END
          WHEN time_zone = 'Europe/London' THEN CASE WHEN off = 60 THEN 'BST' ELSE 'GMT' END
          WHEN time_zone = 'Asia/Tokyo' THEN 'GMT+9' WHEN time_zone = 'Asia/Kolkata' THEN 'GMT+5:30' ELSE 'GMT+3' END AS z,
          CASE WHEN noff = -240 THEN 'EDT' ELSE 'EST' END AS nz FROM named)
      SELECT program_id,
        CASE WHEN fprecision = 'month' THEN strftime(here, '%B %Y') || ' (day unknown)'
             WHEN fprecision = 'unknown' THEN 'date unknown'
             WHEN fprecision = 'day' AND time_zone = 'America/New_York' THEN strftime(here, '%-d %b %Y')
             WHEN fprecision = 'day' THEN strftime(here, '%-d %b %Y') || ' (' || replace(split_part(time_zone, '/', 2), '_', ' ') || ' time)'
             WHEN time_zone = 'America/New_York' THEN strftime(here, '%-d %b %Y, %H:%M') || ' ' || z
             ELSE strftime(here, '%-d %b %Y, %H:%M') || ' ' || z || ' (' || strftime(there, '%H:%M') || ' ' || nz || ')' END AS shown,
        CASE WHEN days_until < -1 THEN 'closed ' || CAST(-days_until AS VARCHAR) || ' days ago'
             WHEN days_until = -1 THEN 'closed yesterday' WHEN days_until = 1 THEN 'tomorrow'
             WHEN days_until <> 0 THEN 'in ' || CAST(days_until AS VARCHAR) || ' days'
             WHEN epoch(inst) <= epoch(TIMESTAMPTZ '{NOW}+00') THEN 'closed today'
             ELSE 'in ' || CAST(greatest(1, CAST(floor((epoch(inst) - epoch(TIMESTAMPTZ '{NOW}+00')) / 3600) AS BIGINT)) AS VARCHAR)
               || CASE WHEN epoch(inst) - epoch(TIMESTAMPTZ '{NOW}+00') < 7200 THEN ' hour' ELSE ' hours' END END AS phrase,
        {_T} AS t_minus,
        CASE fprecision WHEN 'month' THEN 'day unknown — check' WHEN 'unknown' THEN 'date unknown' ELSE '' END AS note,
        {_SHORT} AS short_label
      FROM abbr""",
    "obligation_ids": _OBL
    + """ SELECT program_id, left(sha256(program_id || '#' || CAST(year(due) AS VARCHAR)), 16) AS obligation_id,
        left(sha256(concat_ws('#', program_id, CAST(year(due) AS VARCHAR), CASE WHEN key % 2 = 0 THEN 'Step #' || CAST(key % 7 AS VARCHAR) END)), 16) AS step_obligation_id,
        program_id || '-' || CAST(year(due) AS VARCHAR) || '-' || CASE WHEN key % 2 = 0 THEN 'step-' || CAST(key % 7 AS VARCHAR) ELSE 'deadline' END
          || '-' || left(sha256(program_id || '|' || CAST(year(due) AS VARCHAR) || '|' || CASE WHEN key % 2 = 0 THEN 'Step #' || CAST(key % 7 AS VARCHAR) ELSE '' END), 8)
          || '@tidemark' AS uid
      FROM obligations""",
    "drop_accounting": _BUILT
    + f""", gate AS (
      SELECT CASE WHEN status = 'ruled-out' THEN 'ruled-out'
        WHEN status = 'watch' AND DATE '{X.TODAY}' < watch_from THEN 'not-yet-watched'
        WHEN status = 'closed' THEN 'closed' END AS drop_reason FROM obligations)
      SELECT drop_reason, count(*) AS dropped FROM (SELECT drop_reason FROM gate UNION ALL SELECT drop_reason FROM decided)
      WHERE drop_reason IS NOT NULL GROUP BY drop_reason""",
    "gating_rows": _RES
    + """, g AS (SELECT r.lane, coalesce(s.gating, r.any_gating) AS gating
        FROM resolved r LEFT JOIN live_steps s ON s.program_id = r.program_id AND s.pos = r.next_pos)
      SELECT lane, gating, count(*) AS rows FROM g GROUP BY ALL""",
}
