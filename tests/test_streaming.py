"""Streams equal their batch forms."""

from __future__ import annotations

import shutil
from functools import reduce

from pyspark.sql import functions as F

from leadloom.operators.lifecycle import first_failures
from leadloom.sources.fixtures import table
from leadloom.streaming import events as S
from leadloom.streaming import states as T

SF = "/root/testdata/sf0.001"


def run(df, name, mode, tmp_path, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "in" / "events.parquet")
    return S.read_events(spark, str(tmp_path / "in"))


def test_tumbling_days_equal_batch(spark, tmp_path):
    got = {(str(r.day), r.status, r.n) for r in run(S.tumbling_days(source(spark, tmp_path)), "days", "complete", tmp_path, spark).collect()}
    e = table(spark, SF, "events")
    want = {(f"{r.day} 00:00:00", r.event_type, r.n) for r in e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_sessions_and_week_close(spark, tmp_path):
    src = source(spark, tmp_path)
    n = table(spark, SF, "events").count()
    got = run(S.cooldown_sessions(src), "cool", "append", tmp_path, spark)
    assert 0 < got.agg(F.sum("trips")).first()[0] <= n
    assert run(S.sliding_week(src), "week", "complete", tmp_path, spark).agg(F.sum("n")).first()[0] == 7 * n


def test_append_once_sink_is_idempotent(spark, tmp_path):
    batch = table(spark, SF, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("profile"), F.col("event_type").alias("status"))
    sink = S.append_once_sink(str(tmp_path / "ledger"), "profile")
    for i in range(3):
        sink(batch, i)
    led = spark.read.parquet(str(tmp_path / "ledger"))
    assert led.count() == led.select("profile").distinct().count() == batch.select("profile").distinct().count()


def test_late_rows_are_set_aside(spark, tmp_path):
    rows = lambda *ts: spark.createDataFrame([(t,) for t in ts], "ts string").select(F.col("ts").cast("timestamp").alias("ts"))
    sink = S.late_rows_sink(str(tmp_path / "seen"), str(tmp_path / "late"))
    sink(rows("2024-01-10 00:00:00", "2024-01-01 00:00:00"), 0)
    for _ in range(2):
        sink(rows("2024-01-09 00:00:00", "2024-01-08 23:59:59", None), 1)
    sink(rows("2024-01-20 00:00:00"), 2)
    assert [str(r.ts) for r in spark.read.schema("ts timestamp").parquet(str(tmp_path / "late")).collect()] == ["2024-01-08 23:59:59"]


FACTS = "ts string, profile long, status string, event_id long, listed boolean, degree int"


class Feed:
    """A folder of facts, a file for each call of add, and the query over it, run until all is read."""

    def __init__(self, spark, path, ledger=None, **rules):
        self.spark, self.path, self.ledger, self.rules = spark, str(path), ledger, rules
        self.n = 0

    def add(self, *rows):
        full = [(*r, *(None,) * (6 - len(r))) for r in rows]
        one = self.spark.createDataFrame(full, FACTS).withColumn("ts", F.col("ts").cast("timestamp"))
        one.coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        return self

    def run(self):
        facts = self.spark.readStream.schema(FACTS.replace("ts string", "ts timestamp")).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        q = T.started(T.lifecycle_updates(facts, self.ledger, **self.rules), self.path, 2)
        q.awaitTermination()
        return {r.profile: (r.status, str(r.since)) for r in T.current(self.spark, self.path).collect()}

    def updates(self):
        return {(r.profile, r.status) for r in self.spark.read.schema(T.UPDATES).parquet(f"{self.path}/updates/*").collect()}


def test_lifecycle_timers_restart_and_order(spark, tmp_path):
    ledger = T.ledger_facts(None, spark.createDataFrame([(1,), (4,)], "profile long"), spark.createDataFrame([(2, 1), (5, None)], "profile long, degree int"))
    feed = Feed(spark, tmp_path, ledger, late="1 day")
    feed.add(("2024-01-01 10:00:00", 1, "attempting", 1), ("2024-01-01 10:00:00", 3, "attempting", 2)).add(("2024-01-01 10:01:00", 1, "sent", 3), ("2024-01-01 09:00:00", 2, "sent", 4))
    got = feed.run()
    assert got == {1: ("sent", "2024-01-01 10:01:00"), 2: ("accepted", "2024-01-01 09:00:00"), 3: ("attempting", "2024-01-01 10:00:00")}
    # the query starts anew from its checkpoint; 3 is unknown by its timer, 1 withdrawn by its own, 4 comes late and in no order
    feed.add(("2024-01-03 00:00:00", 4, "accepted", 6), ("2024-01-02 12:00:00", 4, "sent", 5)).add(("2024-02-01 00:00:00", None))
    got = feed.run()
    assert got == {1: ("withdrawn", "2024-01-01 10:01:00"), 2: ("accepted", "2024-01-01 09:00:00"), 3: ("unknown", "2024-01-01 10:00:00"), 4: ("accepted", "2024-01-03 00:00:00")}
    # an event moves on what a timer had ended, and none moves it back
    feed.add(("2024-02-01 00:00:01", 3, "sent", 7), ("2024-02-01 00:00:01", 4, "attempting", 8), ("2024-02-01 00:00:01", 5, "sent", 9, True, 2))
    got = feed.run()
    assert got[3] == ("expired", "2024-02-01 00:00:01") and got[4][0] == "accepted" and got[5][0] == "sent"


def test_lifecycle_ledger_is_shown_and_forgotten(spark, tmp_path):
    old = spark.createDataFrame([(7, "2024-01-01 00:00:00", 1, "sent"), (7, "2024-01-02 00:00:00", 2, "dm_sent"), (8, "2024-01-05 00:00:00", 3, "failed")], "profile long, ts string, event_id long, status string")
    ledger = T.ledger_facts(old.withColumn("ts", F.col("ts").cast("timestamp")))
    feed = Feed(spark, tmp_path, ledger, late="1 hour", forget_days=30)
    feed.add(("2024-01-06 00:00:00", None)).add(("2024-01-06 02:00:00", 9, "sent", 4))
    assert feed.run() == {7: ("dm_sent", "2024-01-02 00:00:00"), 8: ("failed", "2024-01-05 00:00:00"), 9: ("expired", "2024-01-06 02:00:00")}
    # beyond 30 days the state of 7 is gone, so an attempt is its first event again
    feed.add(("2024-03-01 00:00:00", None)).add(("2024-03-01 00:00:01", 7, "attempting", 5))
    assert feed.run()[7] == ("attempting", "2024-03-01 00:00:01")
    assert {(7, "dm_sent"), (7, "attempting")} <= feed.updates()


class Calls:
    """A handle and its list state that count the calls."""

    def __init__(self):
        self.rows, self.n, self.timers = [], 0, []

    def getListState(self, name, schema):
        return self

    def get(self):
        self.n += 1
        return iter(self.rows)

    def put(self, rows):
        self.n, self.rows = self.n + 1, rows

    def clear(self):
        self.n, self.rows = self.n + 1, []

    def registerTimer(self, at):
        self.n += 1
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return max(self.timers, default=0)


def test_profiles_of_a_bucket_share_their_state_calls():
    calls, one = Calls(), T.Lifecycle(5, 21, None)
    one.init(calls)
    fact = lambda i, status: {"profile": i, "status": status, "since": 1_000_000 * i, "event_id": i, "listed": None, "degree": None}
    one.handleInitialState((0,), {"facts": [fact(i, "attempting") for i in range(100)] + [fact(i, "failed") for i in range(100, 200)]}, calls)
    rows = list(one.handleInputRows((0,), iter([fact(i, "sent") for i in range(50)]), calls))
    assert {(r.profile, r.status) for r in rows} == {(i, "expired") for i in range(50)}
    # the first of the 50 attempts left is unknown by then, the others are shown and have the next timer
    rows = list(one.handleExpiredTimer((0,), calls, None))
    assert len(rows) == 150 and [r.profile for r in rows if r.status == "unknown"] == [50] and calls.timers == [1, 350_000, 351_000]
    assert calls.n <= 8 and len(calls.rows) == 200


def test_lifecycle_in_one_bucket(spark, tmp_path):
    old = spark.createDataFrame([(i, "2024-01-01 00:00:00", i, "attempting") for i in range(1, 4)], "profile long, ts string, event_id long, status string")
    feed = Feed(spark, tmp_path, T.ledger_facts(old.withColumn("ts", F.col("ts").cast("timestamp"))), late="1 hour", forget_days=30, buckets=1)
    feed.add(("2024-01-01 00:01:00", 1, "sent", 9), ("2024-01-20 00:00:00", 4, "accepted", 8), ("2024-01-20 00:00:00", None))
    feed.add(("2024-02-10 00:00:00", None)).add(("2024-02-10 00:00:01", 2, "attempting", 10))
    start, later = "2024-01-01 00:00:00", "2024-02-10 00:00:01"
    assert feed.run() == {1: ("expired", "2024-01-01 00:01:00"), 2: ("attempting", later), 3: ("unknown", start), 4: ("accepted", "2024-01-20 00:00:00")}
    assert (2, "unknown") in feed.updates()


def test_failures_are_noted_once(spark, tmp_path):
    e = lambda *rows: spark.createDataFrame(rows, "event_id long, ts string, address string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    days = [
        e((1, "2024-01-01", "a", "failed"), (2, "2024-01-01", "b", "sent")), e((3, "2024-01-02", "a", "failed"), (4, "2024-01-02", "b", "failed"), (9, "2024-01-02", None, "failed")),
        e((5, "2024-03-01", "c", "failed")), e((8, "2024-03-01", "b", "sent")), e((7, "2024-03-20", "c", "sent")), e((6, "2024-03-21", "a", "failed")),
    ]
    for day in days:
        day.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(days[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # state alone forgets a after a week and would note it again; the ledger does not
    alone = run(S.first_in_watermark(src.where("address is not null"), "7 days", ("address",)), "alone", "append", tmp_path, spark)
    assert sorted(r.event_id for r in alone.collect()) == [1, 2, 5, 6]
    for _ in range(2):
        S.sync_failures(src, str(tmp_path / "ledger"), str(tmp_path / "sync")).awaitTermination()
    got = {(r.address, r.event_id) for r in spark.read.parquet(str(tmp_path / "ledger")).collect()}
    batch = reduce(type(days[0]).union, days).where("address is not null")
    assert got == {(r.address, r.event_id) for r in first_failures(batch).collect()} == {("a", 1), ("b", 4), ("c", 5)}
