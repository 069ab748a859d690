"""Steps whose work must grow with the rows alone: what is shuffled, and how often it is made."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions.text import slug, title_key
from tidemark.operators import boilerplate as B
from tidemark.operators import calendar as C
from tidemark.operators import news as N
from tidemark.operators import obligations as O
from tidemark.operators import terms as T
from tidemark.operators.skew import lookup_join
from tidemark.plans import event_queries as E
from tidemark.plans import fixtures as X
from tidemark.plans import obligation_queries as Q
from tidemark.sources.schemas import CYCLE

E_RANKED = E.ranked


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def small_tables(spark, tmp_path):
    """Three orders with lines, as the registry's tables; joins are planned as for large ones."""
    when = datetime(1998, 7, 1)
    orders = [(k, 1, s, when, "1-URGENT") for k, s in ((11, "F"), (12, "O"), (21, "O"))]
    lines = [(k, n, "R", "O") for k in (11, 12, 21) for n in (1, 2)]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string"),
        "customer": ([(1, 5, "BUILDING")], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "nation": ([(5, 3)], "n_nationkey int, n_regionkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield str(tmp_path)
    for key in keys:
        spark.conf.unset(key)


def test_no_resolved_row_is_shuffled_for_the_ledgers(spark, small_tables):
    plan = _plan(Q._built(spark, small_tables))
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "cycle_year" in line]
    assert not wide
    # orders and either ledger come by programme once each
    assert sum("Exchange hashpartitioning(program_id" in line for line in plan.splitlines()) == 3


def test_ledgers_answer_by_cycle_and_keep_every_match(spark, small_tables):
    programs = X.programs(spark, small_tables).filter("program_id <> '21'")
    year = O.resolve(programs, X.CLOCK).select("deadline.cycle_year").first()[0]
    rungs = spark.createDataFrame(
        [("11", year, 90), ("11", year, 30), ("11", year - 1, 7), ("11", None, 0), (None, year, 0), ("12", year, None)],
        "program_id string, cycle_year int, rung int",
    )
    rolling = spark.createDataFrame([("12", date(1998, 6, 1)), ("12", None)], "program_id string, last_delivered date")
    rows = O.build(programs, X.CLOCK, rungs, rolling).select("program_id", "last_rung", "last_rolling").collect()
    assert sorted(map(tuple, rows), key=str) == [
        ("11", 30, None), ("11", 90, None), ("12", None, None), ("12", None, date(1998, 6, 1))
    ]


def test_delivered_rungs_are_made_once_for_the_upsert(spark, small_tables):
    plan = _plan(Q.rung_ledger_upsert(spark, small_tables))
    assert "rungs-delivered" in plan and "lineitem.parquet" not in plan


def test_calendar_problems_make_the_events_once(spark):
    rows = [("a", "day"), ("a", "day"), ("b", "unknown"), ("b", "unknown"), ("c", "day"), (None, "day"), (None, None)]
    events = spark.createDataFrame(rows, "uid string, precision string")
    found = C.calendar_problems(events)
    assert sorted(map(tuple, found.collect()), key=str) == [
        ("duplicate-uid", "a", "2"), ("duplicate-uid", "b", "2"), ("duplicate-uid", None, "2"),
        ("unknown-precision", "b", "cannot be placed"), ("unknown-precision", "b", "cannot be placed"),
    ]
    assert [tuple(r) for r in C.calendar_problems(events.limit(0)).collect()] == [("no-events", "calendar", "zero events")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and "LocalLimit 1" in plan


def test_instant_alone_is_the_parsed_instant(spark):
    days = ["2024-03-01", " 2024-03-01 ", "2024-02-30", "2024-03", "2024-13", "2024-3-1", "2040-01-01", "", None, "soon", "2024-03-01\n"]
    times = ["17:00", " 9:30 ", "24:00", "9", "", " ", None]
    df = spark.createDataFrame([(d, t) for d in days for t in times], "d string, t string")
    zone, now = F.lit("America/New_York"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    for args in ((), (F.col("t"),)):
        both = df.select(
            D.deadline_instant(F.col("d"), zone, now, *args).alias("a"), D.parse_deadline(F.col("d"), zone, now, *args)["instant"].alias("b")
        )
        assert both.filter("NOT a <=> b").count() == 0
        assert both.filter("a IS NOT NULL").count() > 0


@pytest.fixture()
def shuffled(spark):
    """Joins are planned as for large tables, and partitions stay as they were dealt."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lookup_join_scatters_heavy_and_null_keys(spark, shuffled):
    left = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "heavy").alias("k"))
    right = spark.createDataFrame([("heavy", 200, "x"), ("rare", 1, "y")], "k string, n long, v string")
    got = lookup_join(left, right, ["k"], "n", F.col("id"))
    assert {(r.k, r.v) for r in got.select("k", "v").distinct().collect()} == {("heavy", "x"), (None, None)}
    tasks = got.select("k", F.spark_partition_id().alias("task")).groupBy("k").agg(F.countDistinct("task").alias("n"), F.count("*").alias("rows"))
    assert {(r.k, r.n, r.rows) for r in tasks.collect()} == {("heavy", 8, 200), (None, 8, 200)}


def test_items_of_a_source_without_boilerplate_are_spread(spark, shuffled):
    body = F.concat(F.lit("A sentence of this one item and of no other, number "), F.col("id").cast("string"), F.lit("."))
    items = spark.range(200).select(F.col("id").cast("string").alias("item_id"), F.lit("s").alias("source_id"), body.alias("body"))
    items = items.unionByName(items.select("item_id", F.lit(None).cast("string").alias("source_id"), "body"))
    out = B.strip_boilerplate(B.with_sentences(items))
    assert out.filter("stripped <=> body").count() == 400
    tasks = out.select("source_id", F.spark_partition_id().alias("task")).groupBy("source_id").agg(F.countDistinct("task").alias("n"))
    assert {(r.source_id, r.n) for r in tasks.collect()} == {("s", 8), (None, 8)}


def test_title_key_cleans_the_first_words_only(spark):
    titles = [
        "", " ", None, "One", "  a-b  c\td  é e f' g h i j k", "ÉCOLE K ß x", "!! ?? a !! b", "a b c d e f g h", "a b c d e f g h i",
        "-a- .b. ,c, d\ne f g h i j k l", "İstanbul 1 2 3 4 5 6 7 8 9", " ".join("w%d !" % i for i in range(30)), "日本 語 a",
    ]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    plain = F.regexp_replace(F.lower("title"), "[^a-z0-9 ]", "")
    whole = F.array_join(F.slice(F.filter(F.split(plain, r"\s+"), lambda t: t != ""), 1, 8), " ")
    rows = df.select(title_key(F.col("title")).alias("key"), whole.alias("whole"))
    assert rows.filter("NOT key <=> whole").count() == 0
    assert "{0,8}" in _plan(rows.select("key"))


def test_event_rules_run_where_their_words_are(spark):
    texts = [
        "Raises  $3m", "RAISE $1", "series D", "series e", "Financing", "refinancing", "seed round", "Acquired", "acquire", "to buy", "into buys",
        "FDA CLEARS it", "fda clearing", "approvals", "Approved", "met the primary", "missed the primary", "the primary", "Topline", "", None,
    ]
    df = spark.createDataFrame([(k, t, b) for k in ("jobs", "news") for t in texts for b in ("x", "buy a K", None, "a merger")], "source_kind string, title string, body string")
    text = F.concat(F.col("title"), F.lit(" "), F.coalesce("body", F.lit("")))
    plain = F.array_compact(F.array(F.when(F.col("source_kind") == "jobs", "personnel"), *[F.when(text.rlike("(?i)" + r), n) for n, r, _ in N.EVENT_RULES]))
    rows = df.select(N.detect_events().alias("events"), plain.alias("plain"))
    assert rows.filter("NOT events <=> plain").count() == 0
    assert "contains(" in _plan(rows.select("events")).lower()


def test_dates_read_in_columns_are_the_parsed_ones(spark):
    days = ["2024-03-01", " 2024-03-01 ", "2024-02-30", "2024-03", "2024-13", "2024-3-1", "2040-01-01", "", None, "soon", "2024-03-01\n"]
    times = ["17:00", " 9:30 ", "24:00", "9", "", " ", None]
    hints = ["month", "unknown", "day", None]
    df = spark.createDataFrame([(d, t, h) for d in days for t in times for h in hints], "d string, t string, h string")
    zone, now = F.lit("America/New_York"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    df = D.with_instant(df, F.col("d"), zone, F.col("t"))
    at = F.when(F.col("_at") <= D.latest(now), F.col("_at"))
    precision = D.precision_of(F.col("_raw"), at, F.coalesce(F.col("_tod") != "", F.lit(False)), F.col("h"))
    whole = D.parse_deadline(F.col("d"), zone, now, F.col("t"), F.col("h"))
    rows = df.select(at.alias("at"), precision.alias("p"), whole.alias("w"))
    assert rows.filter("NOT at <=> w.instant OR NOT p <=> w.precision").count() == 0
    assert rows.filter("p = 'minute'").count() > 0 and rows.filter("p = 'month'").count() > 0


def test_calendar_events_of_odd_cycles(spark):
    """A headline gives way to a gating step of its day, and unknown dates have no event."""
    step = lambda i, due, gating=True, status="open", tod=None: (i, "S" + i, due, tod, None, "portal", gating, status, None)
    cycle = lambda year, deadline, kind=None, precision=None, steps=None, confirmed=True: (
        year, deadline, confirmed, kind, "17:00", precision, None, None, steps, None
    )
    cycles = [
        cycle(1, "1998-07-01", steps=[step("a", "1998-07-01"), step("b", "1998-06-20", False), step("c", None), step("d", "soon")]),
        cycle(2, "1998-08-01", precision="month", steps=[step("a", "1998-08-01", status="done"), step("b", "1998-07-15", status=None), step("c", "1998-07", tod="9:00")]),
        cycle(3, "1998-09-01", precision="unknown", steps=[step("a", "1998-09-01"), step("b", "2040-01-01"), step("c", "1998-08-20", None)]),
        cycle(4, "1998-10-01", kind="rolling", steps=[step("a", "1998-10-01", tod="9:00")]),
        cycle(5, None, confirmed=False), cycle(6, "1998-11-01", confirmed=None, steps=[]), cycle(7, "1998-12-01", steps=[None, step("a", "1998-11-30", None)]),
    ]
    programs = spark.range(1).select(
        F.lit("P 1").alias("program_id"), F.lit("L").alias("label"), F.lit("active").alias("status"), F.lit("UTC").alias("time_zone"),
        *[F.lit(None).cast("string").alias(c) for c in ("org", "lane", "url", "note")],
        F.lit(None).cast("date").alias("watch_from"), F.lit(None).cast("struct<notes:string>").alias("eligibility"),
    )
    made = spark.createDataFrame([(cycles,)], f"cycles array<{CYCLE}>")
    events = C.calendar_events(programs.crossJoin(made), X.CLOCK).select("cycle_year", "step_id", "precision", "alarm", "placement", "gating", "uid")
    assert sorted(((r[0], r[1] or "-", *r[2:6]) for r in events.collect()), key=str) == [
        (1, "a", "day", True, "19980701", True), (2, "a", "month", False, "19980801", True), (2, "b", "day", None, "19980715", True),
        (2, "c", "month", True, "19980701", True), (4, "a", "minute", True, "19981001T090000Z", True), (6, "-", "minute", True, "19981101T170000Z", False),
        (7, "-", "minute", True, "19981201T170000Z", False),
    ]
    assert all(r.uid.startswith(f"p-1-{r.cycle_year}-") for r in events.collect())
    # no date is read inside a lambda, which is interpreted
    assert all("try_cast" not in line for line in _plan(events).splitlines() if "lambdafunction" in line)


def test_calendar_order_makes_narrow_events_once(spark, small_tables, monkeypatch):
    """Dealing out by ranges reads its rows twice: they must lie ready, and without what has no part in the order."""
    seen = []
    monkeypatch.setattr(E, "ranked", lambda df, by: (seen.append(df), E_RANKED(df, by))[1])
    rows = E.calendar_order(spark, small_tables).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1)) and rows
    assert "lineitem.parquet" not in _plan(seen[0])
    assert set(seen[0].columns) == {"program_id", "cycle_year", "step_id", "placement", "uid"}


def test_lines_are_shuffled_once_for_the_registry(spark, small_tables):
    plan = _plan(X.programs(spark, small_tables))
    lines = [line for line in plan.splitlines() if "Exchange hashpartitioning(l_orderkey" in line or "Exchange hashpartitioning(step_program" in line or "_groupingexpression" in line and "Exchange" in line]
    assert len(lines) == 1


def test_slug_of_plain_text_is_itself(spark):
    texts = ["a", "A b", "s1", "s1\n", "\ns1", "-x-", "", " ", None, "É1", "İ", "1999", "a_b", "ab--c "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.regexp_replace(F.regexp_replace(F.lower("t"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    assert df.select(slug(F.col("t")).alias("s"), whole.alias("w")).filter("NOT s <=> w").count() == 0


TERM_TEXTS = [
    (1, "In the seed round", "a Seed  round, seed round. MR mr seed\nround"), (2, None, "seedround seed"), (3, "", None),
    (4, "MR", "x-y x-y-z x y 10x genomics"), (None, "seed round", "MR"), (5, "no", "none of it"),
]


def test_few_terms_shuffle_no_places(spark):
    docs = spark.createDataFrame(TERM_TEXTS, "id long, title string, body string")
    rows = [("a", "seed round", 1.0, False), ("a", "seed round", 2.0, False), ("b", "seed", 1.0, False), ("a", "x-y", 1.0, False), ("a", "MR", 1.0, True), ("b", "10x", 3.0, False)]
    terms = spark.createDataFrame(rows, T.TERMS)
    few, many = T.term_hits(docs, terms, "id", "title", "body"), T.term_hits(docs, terms, "id", "title", "body", most_sent=0)
    got = sorted(map(tuple, few.collect()), key=str)
    assert got == sorted(map(tuple, many.collect()), key=str)
    assert got == sorted([
        (1, "a", "seed round", 2.0, 2, True), (1, "b", "seed", 1.0, 4, True), (1, "a", "MR", 1.0, 1, False), (2, "b", "seed", 1.0, 1, False),
        (4, "a", "MR", 1.0, 1, True), (4, "a", "x-y", 1.0, 2, False), (4, "b", "10x", 3.0, 1, False),
        (None, "a", "seed round", 2.0, 1, True), (None, "b", "seed", 1.0, 1, True), (None, "a", "MR", 1.0, 1, False),
    ], key=str)
    assert "BroadcastHashJoin" in _plan(few) and "SortMergeJoin" not in _plan(few)
    one = spark.createDataFrame([("a", "seed", 1.0, False)], T.TERMS)
    assert T.term_hits(docs, one, "id", "title", "body").count() == 3 and T.term_hits(docs, one.limit(0), "id", "title", "body").count() == 0
