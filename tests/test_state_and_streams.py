"""Snapshots, digests and streams survive being run twice."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import accounting as A
from tidemark.operators import monitoring as M
from tidemark.operators import obligations as O
from tidemark.operators.asof import as_of
from tidemark.operators.ledgers import replay_rungs, upsert
from tidemark.operators.monitoring import page_history
from tidemark.operators.ranking import ranked
from tidemark.sources import digests, state
from tidemark.sources.buckets import BucketedState
from tidemark.sources.dims import attach, enabled, job_boards, sources
from tidemark.streaming import ledgers as SL
from tidemark.streaming.late import newest, split_counts, split_sink

RUNGS = "program_id string, cycle_year int, rung int"


def test_missing_state_is_empty_and_a_dead_write_is_ignored(spark, tmp_path):
    root = str(tmp_path / "rungs")
    assert state.read_state(spark, root, RUNGS).count() == 0
    state.write_state(spark.createDataFrame([("a", 2026, 30)], RUNGS), root, "2026-01-01")
    (tmp_path / "rungs" / "v=2026-01-02").mkdir()
    assert state.snapshots(spark, root) == ["2026-01-01"]
    assert state.read_state(spark, root, RUNGS).count() == 1
    assert state.read_state(spark, root, RUNGS, before="2026-01-01").count() == 0


def test_a_day_is_written_once_unless_forced(spark, tmp_path):
    root = str(tmp_path / "digests")
    parts = lambda n: {"items": spark.range(n).toDF("item_id"), "stats": spark.range(1).toDF("kept")}
    assert digests.write_digest(spark, parts(3), root, "2026-01-01")
    assert not digests.write_digest(spark, parts(5), root, "2026-01-01")
    assert digests.write_digest(spark, parts(2), root, "2026-01-02")
    assert digests.read_part(spark, root, "items", "2026-01-01").count() == 3
    assert digests.write_digest(spark, parts(4), root, "2026-01-01", force=True)
    assert digests.read_part(spark, root, "items", "2026-01-01").count() == 4
    assert digests.read_part(spark, root, "items", "2026-01-02").count() == 2
    assert digests.previous_date(spark, root, "2026-01-02") == "2026-01-01"
    assert digests.window_start(spark, root, "2026-01-01") == "2026-01-01"


def test_source_defaults_and_attach(spark):
    dim = sources(spark, [{"source_id": "a"}, {"source_id": "b", "enabled": False, "max_items": 5}])
    dim = dim.unionByName(job_boards(spark, [{"source_id": "j", "vendor": "lever"}]))
    got = {r.source_id: r for r in dim.collect()}
    assert got["a"].max_items == 40 and got["b"].max_items == 5 and got["j"].source_kind == "jobs"
    assert [r.source_id for r in enabled(dim, ["a", "b"]).collect()] == ["a"]
    items = spark.createDataFrame([("a",), ("j",), ("zz",)], "source_id string")
    assert {r.source_id: r.source_problem for r in attach(items, dim).collect()} == {"a": None, "j": None, "zz": "unknown-source"}


def test_verify_order(spark):
    rows = spark.createDataFrame([("p1", "b", None), ("p2", "a", 0), ("p3", "z", 90), ("p4", "y", 90)], "program_id string, label string, stale_days int")
    placed = ranked(rows.repartition(3), O.verify_order()).orderBy("rank")
    assert [r.program_id for r in placed.collect()] == ["p4", "p3", "p2", "p1"]


def test_upsert_with_repeated_keys(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 5)], "k string, v int, at int")
    new = spark.createDataFrame([("a", 9, 6), ("a", 2, 7), ("c", 3, 1), ("c", 3, 1)], "k string, v int, at int")
    assert sorted(map(tuple, upsert(old, new, ["k"], "at").collect())) == [("a", 2, 7), ("b", 1, 5), ("c", 3, 1)]
    assert upsert(upsert(old, new, ["k"]), new, ["k"]).count() == 3


def run(df, name, mode="append", **options):
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode)
    for key, value in options.items():
        writer = writer.option(key, value)
    q = writer.start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def each_batch(df, write, checkpoint):
    q = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


@pytest.fixture
def stream(spark, tmp_path):
    SL.use_state_store(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    made = []

    def add(batches, schema, path):
        for rows in batches:
            # one file per batch, in the order of their names' times
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    def make(batches, schema, name="in"):
        path = str(tmp_path / name)
        add(batches, schema, path)
        made.append(path)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    make.add = add
    yield make
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


DAY = lambda i: dt.date(2026, 1, 1) + dt.timedelta(days=i)


def test_rung_stream_fires_seventeen_cards(spark, stream):
    batches = [[("p", 2026, DAY(400 - d), d) for d in range(hi, hi - 101, -1) if d >= 0] for hi in (400, 299, 198, 97)]
    run(SL.rungs(stream(batches, "program_id string, cycle_year int, date date, days_until int")), "rungs")
    assert sorted(r.rung for r in spark.table("rungs").collect()) == sorted(
        [365, 180, 90, 60, 45, 30, 21, 14, 10, 7, 6, 5, 4, 3, 2, 1, 0]
    )


def test_rung_stream_equals_the_replay_of_the_batch_rule(spark, stream):
    starts = {f"p{i}": i * 7 for i in range(12)}
    rows = [(p, 2026, DAY(100 - d), d) for p, s in starts.items() for d in range(s, -3, -1)]
    batches = [[r for r in rows if lo <= (r[2] - DAY(0)).days < lo + 40] for lo in range(0, 120, 40)]
    run(SL.rungs(stream(batches, "program_id string, cycle_year int, date date, days_until int")), "rungs_replayed")
    fired = {r["program_id"]: r["count"] for r in spark.table("rungs_replayed").groupBy("program_id").count().collect()}
    df = spark.createDataFrame(list(starts.items()), "program_id string, d int")
    assert fired == {r.program_id: r.n for r in df.select("program_id", replay_rungs(F.col("d")).alias("n")).collect()}


def test_page_stream(spark, stream):
    rows = [
        [("p", DAY(0), "a", 3000, None)],
        [("p", DAY(1), "a", 3000, None), ("q", DAY(1), None, None, None)],
        [("p", DAY(2), "b", 2900, "Cloudflare challenge page"), ("q", DAY(2), "x", 10, None)],
        [("p", DAY(3), "b", 100, None)],
    ]
    schema = "program_id string, date date, text_hash string, text_length int, challenge string"
    run(SL.page_changes(stream(rows, schema)), "pages_changed")
    got = [(r.program_id, (r.date - DAY(0)).days, r.change) for r in spark.table("pages_changed").collect()]
    assert sorted(got) == [("p", 0, "new"), ("p", 2, "failed"), ("p", 3, "suspicious"), ("q", 1, "failed"), ("q", 2, "new")]
    seen = [(*r[:2], None if r[4] else r[2], r[3]) for batch in rows for r in batch]
    batch = page_history(spark.createDataFrame(seen, "program_id string, date date, text_hash string, text_length int"))
    want = [(r.program_id, (r.date - DAY(0)).days, r.change) for r in batch.filter("change IS NOT NULL").collect()]
    assert sorted(got) == sorted(want)


def test_first_seen_stream(spark, stream):
    t = dt.datetime(2026, 1, 5)
    batches = [[("a", t), ("a", t - dt.timedelta(days=2))], [("a", t), ("b", t)]]
    run(SL.first_seen(stream(batches, "item_id string, seen_at timestamp")), "seen_once")
    assert sorted((r.item_id, r.first_seen) for r in spark.table("seen_once").collect()) == [("a", dt.date(2026, 1, 3)), ("b", dt.date(2026, 1, 5))]


def test_a_key_past_its_time_to_live_is_gone(spark, stream, tmp_path):
    schema, t = "item_id string, seen_at timestamp", dt.datetime(2026, 1, 5)
    source = stream([[("a", t)], [("a", t)]], schema)
    seen = SL.first_seen(source, keep_days=8 / 86_400)
    out = str(tmp_path / "seen")
    write = lambda batch, _: batch.write.mode("append").parquet(out)
    each_batch(seen, write, str(tmp_path / "check"))
    assert spark.read.parquet(out).count() == 1
    time.sleep(9)
    stream.add([[("a", t)]], schema, str(tmp_path / "in"))
    each_batch(seen, write, str(tmp_path / "check"))
    assert spark.read.parquet(out).count() == 2


def daily(n_sources=4, n_days=45):
    r = random.Random(11)
    rows = []
    for s in range(n_sources):
        for d in range(n_days):
            n = r.choice([0, 3, 20, 21, 22, 23, 40])
            kept = 0 if r.random() < 0.15 else n // r.choice([1, 1, 1, 6])
            filtered = n if kept == 0 and r.random() < 0.5 else 0
            rows.append((f"s{s}", DAY(d), n, kept, filtered, r.random() < 0.15, "timeout" if r.random() < 0.1 else None))
    return rows


HISTORY = "source_id string, date date, parsed long, kept long, filtered long, not_modified boolean, error string"
#: Moves the watermark past every other day; its own key is left out of comparisons.
CLOSING = [("closing", DAY(400), 1, 1, 0, False, None)]


def test_source_history_stream_equals_the_batch_rules_over_a_restart(spark, stream, tmp_path):
    rows = daily()
    r = random.Random(2)
    batches = [[x for x in rows if lo <= (x[1] - DAY(0)).days < lo + 9] for lo in range(0, 45, 9)]
    # days at the edges of batches come out of order, within the delay
    for a, b in zip(batches, batches[1:]):
        early = [x for x in b if (x[1] - b[0][1]).days == 0 and r.random() < 0.5]
        late = [x for x in a if x[1] == max(y[1] for y in a) and r.random() < 0.5]
        a[:] = [x for x in a if x not in late] + early
        b[:] = [x for x in b if x not in early] + late
    out = str(tmp_path / "judged")
    write = lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/b={i}")
    judged = SL.source_history(stream(batches[:2], HISTORY), history=10, delay="3 days")
    each_batch(judged, write, str(tmp_path / "check"))
    stream.add([*batches[2:], CLOSING, CLOSING], HISTORY, str(tmp_path / "in"))
    each_batch(judged, write, str(tmp_path / "check"))
    got = spark.read.option("basePath", out).parquet(f"{out}/*").filter("source_id <> 'closing'")
    days = spark.createDataFrame(rows, HISTORY)
    want = M.failure_streaks(M.volume_status(days, history=10))
    shape = lambda df: sorted(
        (x.source_id, x.date, x.status, x.streak, x.last_success, x.median_before if x.status != "not-modified" else None) for x in df.collect()
    )
    # a failed day that was not modified either has no history to be judged by
    plain = lambda rs, skip: [x for x in rs if (x[0], x[1]) not in skip]
    skip = {(x[0], x[1]) for x in rows if x[5] and x[6]}
    assert [x[:5] for x in shape(got)] == [x[:5] for x in shape(want)]
    assert plain(shape(got), skip) == plain(shape(want), skip)
    last = {x.source_id: list(x.recent_counts) for x in got.filter(F.col("date") == DAY(44)).collect()}
    assert last == {x.source_id: list(x.recent_counts) for x in M.stored_counts(days, history=10).collect()}


def test_cooldown_stream(spark, stream):
    offers = {"p": [0, 10, 44, 45, 46, 89, 90, 91, 200], "q": [3, 3, 60]}
    rows = sorted(((p, DAY(d)) for p, ds in offers.items() for d in ds), key=lambda x: x[1])
    batches = [rows[i : i + 3] for i in range(0, len(rows), 3)] + [[("closing", DAY(600))], [("closing", DAY(601))]]
    run(SL.rolling_cooldown(stream(batches, "program_id string, date date"), days=45), "cooled")
    got = sorted((r.program_id, (r.date - DAY(0)).days) for r in spark.table("cooled").filter("program_id <> 'closing'").collect())
    want = []
    for p, ds in offers.items():
        last = None
        for d in ds:
            if last is None or d - last >= 45:
                last = d
                want.append((p, d))
    assert got == sorted(want)


def test_late_and_future_rows_are_set_aside_and_counted(spark, stream, tmp_path):
    at = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    batches = [[("a", at(0)), ("b", at(5))], [("c", at(4)), ("d", at(1)), ("e", at(60)), ("f", None)], [("g", at(6)), ("h", at(2))]]
    root, kept = str(tmp_path / "split"), []
    handle = lambda rows, i: kept.extend(r.k for r in rows.collect())
    write = split_sink(root, "at", "2 days", F.lit(at(30)), handle)
    frames = [spark.createDataFrame(b, "k string, at timestamp") for b in batches]
    for i, rows in enumerate(frames):
        write(rows, i)
    write(frames[2], 2)  # replayed
    rows = {(r.k, r.outcome) for r in spark.read.parquet(f"{root}/rows").collect()}
    assert rows == {("a", "on-time"), ("b", "on-time"), ("c", "on-time"), ("d", "late"), ("e", "future"), ("f", "on-time"), ("g", "on-time"), ("h", "late")}
    counts = [tuple(r)[2:] for r in split_counts(spark, root).orderBy("batch").collect()]
    assert counts == [(2, 0, 0), (2, 1, 1), (1, 1, 0)]
    assert sorted(kept) == ["a", "b", "c", "f", "g", "g"]
    assert newest(spark, root) == at(6)


def test_replayed_batch_gives_the_same_snapshot(spark, tmp_path):
    root = str(tmp_path / "ledger")
    keys = ["program_id", "cycle_year"]
    write = SL.snapshot_sink(root, RUNGS, keys, buckets=4)
    write(spark.createDataFrame([("a", 2026, 30)], RUNGS), 0)
    second = spark.createDataFrame([("a", 2026, 21), ("b", 2026, 90)], RUNGS)
    write(second, 1)
    write(second, 1)
    got = sorted(map(tuple, SL.latest_snapshot(spark, root, RUNGS, keys).collect()))
    assert got == [("a", 2026, 21), ("b", 2026, 90)]


def test_a_merge_writes_only_the_buckets_it_touches(spark, tmp_path):
    state = BucketedState(spark, str(tmp_path / "state"), "k long, v string, at int", ["k"], buckets=16)
    assert state.read().count() == 0
    assert state.merge(spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("at")), "1") == 16
    few = spark.createDataFrame([(3, "x", 5), (3, "new", 9), (2000, "new", 1)], "k int, v string, at int")
    assert state.merge(few, "2", order="at") == len(list((tmp_path / "state" / "data" / "v=2").glob("bucket=*"))) <= 2
    assert state.merge(few, "2", order="at") <= 2  # run again
    again = BucketedState(spark, str(tmp_path / "state"), "k long, v string, at int", ["k"], buckets=99)
    got = {r.k: r.v for r in again.read().collect()}
    assert len(got) == 1001 and sorted(k for k, v in got.items() if v == "new") == [3, 2000] and again.buckets == 16
    assert again.read(before="2").filter("v = 'old'").count() == 1000
    # a merge that died: files without a manifest do not count
    (tmp_path / "state" / "data" / "v=3").mkdir()
    assert again.read().count() == 1001 and again.versions() == ["1", "2"]
    assert again.prune(keep=1) >= 1 and again.read().count() == 1001 and again.versions() == ["2"]


def test_days_filed_by_batch_are_there_once(spark, stream, tmp_path):
    root = str(tmp_path / "days")
    write = SL.day_sink(root)
    rows = lambda *ks: spark.createDataFrame([(k, DAY(0)) for k in ks], "k string, date date")
    write(rows("a", "b"), 0)
    write(rows("c"), 1)
    write(rows("c"), 1)
    assert sorted(r.k for r in spark.read.parquet(root).collect()) == ["a", "b", "c"]


def test_a_run_that_dies_shows_nothing_and_a_repeated_one_counts_once(spark, tmp_path):
    root, rows = str(tmp_path / "archive"), lambda n: spark.range(n).toDF("item_id")
    digests.write_digest(spark, {"items": rows(3), "stats": rows(1)}, root, "2026-01-01", run="7")

    def dies(batch):
        def fail(iterator):
            yield from iterator
            raise ValueError("lost")

        return batch.mapInPandas(fail, batch.schema)

    with pytest.raises(Exception, match="lost"):
        digests.write_digest(spark, {"items": rows(5), "stats": dies(rows(1))}, root, "2026-01-02", run="8")
    assert digests.digest_dates(spark, root) == ["2026-01-01"]
    assert digests.read_part(spark, root, "items").count() == 3
    for _ in range(2):
        digests.write_digest(spark, {"items": rows(5), "stats": rows(1)}, root, "2026-01-02", force=True, run="8")
        digests.append_run_status(spark.createDataFrame([("ok",)], "outcome string"), f"{root}/status", "8")
    assert digests.read_part(spark, root, "items").count() == 8
    assert [(r.run_id, r.outcome) for r in digests.read_run_status(spark, f"{root}/status").collect()] == [("8", "ok")]
    # a run that is forced counts from its commit on
    digests.stage_part(rows(9), root, "items", "2026-01-01", "9")
    assert digests.read_part(spark, root, "items", "2026-01-01").count() == 3
    digests.commit_day(spark, root, "2026-01-01", "9")
    assert digests.read_part(spark, root, "items", "2026-01-01").count() == 9


def test_counts_come_from_the_write(spark, tmp_path):
    counts = A.drop_counts(("late", "early"))
    rows = spark.createDataFrame([(1, None), (2, "late"), (3, "late"), (4, "odd")], "k int, drop_reason string")
    table, found = A.materialize_counted(rows.repartition(3), "counted", counts)
    assert table.count() == 4 and found == {"rows": 4, "kept": 1, "drop:late": 2, "drop:early": 0, "drop:other": 1}
    assert A.drops(found, found) == {"late": 4, "other": 2}
    _, none = A.materialize_counted(rows.filter("k > 9"), "counted", counts)
    assert none == {"rows": 0, "kept": 0, "drop:late": 0, "drop:early": 0, "drop:other": 0}


def test_places_come_without_one_task_for_all(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v"), F.when(F.col("id") % 3 > 0, "hot").alias("g"))
    placed = ranked(rows.repartition(6), [F.col("v").desc(), F.col("id")], rank="place")
    assert [r.id for r in placed.orderBy("place").collect()] == [r.id for r in rows.orderBy(F.desc("v"), "id").collect()]
    assert "SinglePartition" not in placed._jdf.queryExecution().executedPlan().toString()
    by_group = ranked(rows, [F.col("v"), F.col("id")], ["g"], size="n").collect()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.v, r.id)):
        want.setdefault(r.g, []).append(r.id)
    assert {(r.id, r["rank"], r.n) for r in by_group} == {(i, p, len(ids)) for ids in want.values() for p, i in enumerate(ids, 1)}
    assert ranked(rows.filter("id < 0"), [F.col("v")]).count() == 0


def test_as_of(spark):
    r = random.Random(4)
    left = [(i, r.choice(["a", "b", None]), r.choice([None, *range(60)])) for i in range(300)]
    right = [(r.choice(["a", "b", None]), r.choice([None, *range(60)]), f"v{i:03d}") for i in range(60)]
    a, b = spark.createDataFrame(left, "i int, k string, at int"), spark.createDataFrame(right, "k string, since int, v string")
    for strict in (False, True):
        for width in (1, 7, 1000):
            got = as_of(a, b, ["k"], "at", "since", ["v"], width, strict, matched_at="found")
            want = []
            for i, k, t in left:
                known = [(s, v) for g, s, v in right if None not in (k, t, s) and g == k and (s < t if strict else s <= t)]
                s, v = max(known, default=(None, None))
                want.append((i, k, t, v, s))
            assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert as_of(a, b.filter("v = ''"), ["k"], "at", "since", ["v"], 7).filter("v IS NOT NULL").count() == 0


def test_partition_count_does_not_change_results(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    rows = lambda: sorted(map(str, entry.queries()["news_ranked"](spark, sf).collect()))
    before = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert F.lit(1) is not None
