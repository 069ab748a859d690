"""The keyed state machines as streams.

Each machine is a processor with typed state per key. State that is looked up by
key leaves by itself: a time to live drops keys that no row has named for that
long, and where a rule speaks of days an event-time timer acts when the
watermark reaches them. The machines need Spark's RocksDB state store, which
keeps state on disk and not in the executor's heap: ``use_state_store`` sets it.

A time to live makes Spark look for expired state in batches without rows.
Where such a stream is to come to rest, turn off
``spark.sql.streaming.noDataMicroBatches.enabled``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.config import WEIGHTS, Weights
from tidemark.sources.buckets import BucketedState

DAY_MS = 86_400_000
#: How long a key stays that no row names; a year and a half covers a yearly cycle.
KEEP_DAYS = 550
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> SparkSession:
    """Choose the state store that these machines need, for streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return spark


def _days(at: str) -> Column:
    return F.unix_date(F.to_date(at)).alias("day")


class _FirstSeen(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.day = handle.getValueState("day", "day int", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        days = [r.day for r in rows if r.day is not None]
        known = self.day.get() if self.day.exists() else None
        if known is None and days:
            self.day.update((min(days),))
            yield Row(key=key[0], day=min(days))
        elif known is not None:
            self.day.update(known)

    def close(self) -> None:
        pass


def first_seen(items: DataFrame, key: str = "item_id", at: str = "seen_at", keep_days: float = KEEP_DAYS) -> DataFrame:
    """``(key, first_seen)``, each id once, in the first batch that carries it: the earliest of its dates there.

    An id that no row has named for ``keep_days`` is forgotten, and new if it comes back.
    """
    rows = items.select(F.col(key).alias("key"), _days(at))
    kind = items.schema[key].dataType.simpleString()
    out = rows.groupBy("key").transformWithState(_FirstSeen(int(keep_days * DAY_MS)), f"key {kind}, day int", "append", "ProcessingTime")
    return out.select(F.col("key").alias(key), F.date_from_unix_date("day").alias("first_seen"))


class _Rungs(StatefulProcessor):
    def __init__(self, ladder: list[int], floor: int, keep_ms: int):
        self.ladder, self.floor, self.keep_ms = ladder, floor, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "rung int", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        for day, days in sorted({(r.day, r.days_until) for r in rows if r.days_until is not None}):
            rung = days if days <= self.floor else next((r for r in self.ladder if r >= days), None)
            if days >= 0 and rung is not None and (last is None or last > rung):
                last = rung
                yield Row(program_id=key[0], cycle_year=key[1], day=day, rung=rung)
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


def rungs(observations: DataFrame, w: Weights = WEIGHTS, keep_days: float = KEEP_DAYS) -> DataFrame:
    """Cards as days pass: ``(program_id, cycle_year, date, days_until)`` in, crossed rungs out.

    The state of a cycle is the last rung delivered. A missed day still fires the
    rung it crossed, once.
    """
    rows = observations.select("program_id", F.col("cycle_year").cast("int").alias("cycle_year"), _days("date"), F.col("days_until").cast("int").alias("days_until"))
    step = _Rungs(sorted(w.rungs), w.rung_floor_days, int(keep_days * DAY_MS))
    out = rows.groupBy("program_id", "cycle_year").transformWithState(
        step, "program_id string, cycle_year int, day int, rung int", "append", "ProcessingTime"
    )
    return out.select("program_id", "cycle_year", F.date_from_unix_date("day").alias("date"), "rung")


class _Pages(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "hash string, length int", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.known.get() if self.known.exists() else None
        for r in sorted(rows, key=lambda r: r.day):
            if r.text_hash is None:
                change = "failed"
            elif known is None:
                change = "new"
            elif known[0] == r.text_hash:
                change = None
            else:
                change = "suspicious" if known[1] > 2000 and r.text_length / known[1] < 0.4 else "changed"
            if change:
                yield Row(program_id=key[0], day=r.day, change=change)
            if r.text_hash is not None:
                known = (r.text_hash, r.text_length)
        if known is not None:
            self.known.update(tuple(known))

    def close(self) -> None:
        pass


def page_changes(observations: DataFrame, keep_days: float = KEEP_DAYS) -> DataFrame:
    """``(program_id, date, text_hash, text_length)`` in, changes out; state is the last hash and length fetched.

    A null hash is a failed fetch: it is reported and leaves the state alone. So
    is a page with a ``challenge``, where that column is given.
    """
    got = F.col("text_hash")
    if "challenge" in observations.columns:
        got = F.when(F.col("challenge").isNull(), got)
    rows = observations.select("program_id", _days("date"), got.alias("text_hash"), F.col("text_length").cast("int").alias("text_length"))
    out = rows.groupBy("program_id").transformWithState(
        _Pages(int(keep_days * DAY_MS)), "program_id string, day int, change string", "append", "ProcessingTime"
    )
    return out.select("program_id", F.date_from_unix_date("day").alias("date"), "change")


class _InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed their day, then steps through them in order of days."""

    row_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", self.row_schema)

    def step(self, key, day: int, row: tuple) -> Iterator[Row]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            at = int(r.day) * DAY_MS
            row = tuple(r[c.split()[0]] for c in self.row_schema.split(", "))
            known = self.waiting.getValue((at,)) if self.waiting.containsKey((at,)) else None
            # of several rows of a day the greatest counts, in whatever order they come
            if known is None or self._order(tuple(known)) < self._order(row):
                self.waiting.updateValue((at,), row)
            self.handle.registerTimer(at)
        yield from ()

    @staticmethod
    def _order(row: tuple) -> tuple:
        return tuple((v is not None, v if v is not None else 0) for v in row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.waiting.containsKey((at,)):
            row = tuple(self.waiting.getValue((at,)))
            self.waiting.removeKey((at,))
            yield from self.step(key, at // DAY_MS, row)

    def close(self) -> None:
        pass


class _SourceHistory(_InOrder):
    row_schema = "parsed long, kept long, filtered long, not_modified boolean, error string"

    def __init__(self, history: int):
        self.history = history

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getListState("counts", "kept long")
        self.run = handle.getValueState("run", "streak int, last_success int")

    def step(self, key, day: int, row: tuple) -> Iterator[Row]:
        parsed, kept, filtered, not_modified, error = row
        counts = [c[0] for c in self.counts.get()] if self.counts.exists() else []
        median = None
        if counts:
            ordered, half = sorted(counts), len(counts) // 2
            median = float(ordered[half]) if len(counts) % 2 else (ordered[half - 1] + ordered[half]) / 2
        status = self.judge(parsed, kept, filtered, median)
        if error is not None:
            status = "failed"
        elif not_modified:
            status, median = "not-modified", None
        streak, last = self.run.get() if self.run.exists() else (0, None)
        good = status in ("ok", "not-modified")
        streak, last = (0, day) if good else (streak + 1, last)
        self.run.update((streak, last))
        if not not_modified:
            counts = [*counts, kept][-self.history :]
            self.counts.put([(c,) for c in counts])
        yield Row(source_id=key[0], day=day, kept=kept, median_before=median, status=status, streak=streak, last_success=last, recent_counts=counts)

    @staticmethod
    def judge(parsed: int, kept: int, filtered: int, median: float | None) -> str:
        if parsed == 0 or (kept == 0 and filtered < parsed):
            return "degraded"
        if kept and median is not None and median >= 5 and kept < median * 0.3:
            return "degraded"
        return "ok"


def source_history(days: DataFrame, history: int = 30, delay: str = "2 days") -> DataFrame:
    """Daily counts of sources in, each judged against the ``history`` counts before it.

    ``days``: source_id, date, parsed, kept, filtered, not_modified, error. A day
    is judged once the watermark, ``delay`` behind the newest date, has passed
    it, so days that come out of order within ``delay`` are judged in order.
    The state of a source is its last counts, its streak of failures and its
    last success; ``recent_counts`` shows the counts for the next run.
    """
    at = F.to_timestamp("date").alias("at")
    rows = days.select("source_id", at, _days("date"), *[F.col(c).cast("long").alias(c) for c in ("parsed", "kept", "filtered")], "not_modified", "error")
    out = rows.withWatermark("at", delay).groupBy("source_id").transformWithState(
        _SourceHistory(history),
        "source_id string, day int, kept long, median_before double, status string, streak int, last_success int, recent_counts array<long>",
        "append",
        "EventTime",
    )
    date = lambda c: F.date_from_unix_date(c)
    return out.select("source_id", date("day").alias("date"), "kept", "median_before", "status", "streak", date("last_success").alias("last_success"), "recent_counts")


class _Cooldown(_InOrder):
    row_schema = "day int"

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.delivered = handle.getValueState("delivered", "day int")

    def step(self, key, day: int, row: tuple) -> Iterator[Row]:
        if not self.delivered.exists():
            self.delivered.update((day,))
            self.handle.registerTimer((day + self.days) * DAY_MS)
            yield Row(program_id=key[0], day=day)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # the day on which a cooldown ends is free again
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS
        if self.delivered.exists() and self.delivered.get()[0] + self.days <= day:
            self.delivered.clear()
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)


def rolling_cooldown(offers: DataFrame, days: int = WEIGHTS.rolling_redelivery_days, delay: str = "2 days") -> DataFrame:
    """``(program_id, date)`` on which a rolling programme may be shown in, the days it is shown out.

    After a delivery a timer of event time ends the cooldown and clears the
    state; a programme that is not offered again leaves nothing behind.
    """
    rows = offers.select("program_id", F.to_timestamp("date").alias("at"), _days("date"))
    out = rows.withWatermark("at", delay).groupBy("program_id").transformWithState(_Cooldown(days), "program_id string, day int", "append", "EventTime")
    return out.select("program_id", F.date_from_unix_date("day").alias("date"))


def snapshot_sink(root: str, schema: str, keys: list[str], buckets: int = 64, version: str | None = None):
    """A ``foreachBatch`` function that upserts each batch into bucketed snapshots.

    The batch number is the version: a batch that is replayed after a failure
    starts from the snapshot before it and writes the same one again. Only
    buckets that hold a key of the batch are written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        BucketedState(batch.sparkSession, root, schema, keys, buckets).merge(batch, f"{batch_id:012d}", version)

    return write


def latest_snapshot(spark: SparkSession, root: str, schema: str, keys: list[str]) -> DataFrame:
    return BucketedState(spark, root, schema, keys).read()


def day_sink(root: str):
    """A ``foreachBatch`` function that files rows by date; a replayed batch replaces its own rows only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.withColumn("batch", F.lit(f"b-{batch_id:012d}")).write.mode("overwrite")
        out.option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(root)

    return write
