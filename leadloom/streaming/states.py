"""The lifecycle of profiles as a stream with typed state, event-time timers and a batch ledger to begin with."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leadloom.functions import constants as K
from leadloom.operators.lifecycle import STAGE, furthest_events

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: One thing known of a profile: an event (status, since in microseconds, event_id), or what a snapshot says (listed, degree).
FACT = ("profile", "status", "since", "event_id", "listed", "degree")
STATE = "profile long, status string, since long, event_id long, listed boolean, degree int, shown string, shown_since long, version long"
UPDATES = "profile long, status string, since timestamp, version long"
NAMES = [c.split()[0] for c in STATE.split(", ")]
#: Profiles that one state should hold: each access to a state is a call to the JVM, so a call serves all of them.
PER_STATE = 200


class Lifecycle(StatefulProcessor):
    """The profiles of one bucket: the furthest status and when first, in any order of arrival, and what it stands for as time goes on.

    A bucket's state is a list of profiles, read and written at once. Only facts are kept, and the outcome is derived from them and the watermark; so an event that comes late changes
    the outcome to what it would have been. A timer is set for the next moment at which time alone changes one of a bucket.
    """

    def __init__(self, minutes: int, days: int, forget_days: int | None):
        self.attempt, self.pending = minutes * 60_000_000, days * 86_400_000_000
        self.forget = None if forget_days is None else forget_days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getListState("profiles", STATE)

    def outcome(self, fact: dict, now: int) -> str | None:
        status, since = fact["status"], fact["since"]
        if status == "attempting":
            return "unknown" if since <= now - self.attempt else status
        if status != "sent":
            return status
        if fact["listed"]:
            return "withdrawn" if since < now - self.pending else status
        return "accepted" if fact["degree"] == 1 else "expired"

    def over(self, fact: dict, now: int) -> bool:
        return self.forget is not None and fact["since"] is not None and fact["since"] + self.forget <= now

    @staticmethod
    def new(profile: int) -> dict:
        return dict.fromkeys(NAMES) | {"profile": profile, "version": 0}

    def read(self) -> dict[int, dict]:
        return {r[0]: dict(zip(NAMES, r)) for r in self.state.get()}

    def write(self, facts: dict[int, dict]) -> None:
        if facts:
            self.state.put([tuple(f[c] for c in NAMES) for f in facts.values()])
        else:
            self.state.clear()

    @staticmethod
    def take(fact: dict, rows) -> None:
        """Facts of rows: the higher stage, then the earlier time, then the smaller event; snapshots as they come."""
        rank = lambda x: (STAGE[x["status"]], -x["since"], -(x["event_id"] or 0))
        for r in rows:
            if r["status"] in STAGE and r["since"] is not None and (fact["status"] is None or rank(r) > rank(fact)):
                fact.update({c: r[c] for c in ("status", "since", "event_id")})
            fact.update({c: r[c] for c in ("listed", "degree") if r[c] is not None})

    def timer(self, facts: dict[int, dict], now: int) -> None:
        """Set for the next moment; the ones behind it are looked for when it has come."""
        due = []
        for f in facts.values():
            if f["since"] is not None:
                wait = {"attempting": self.attempt, "sent": self.pending + 1000 if f["listed"] else None}.get(f["status"])
                due += [f["since"] + at for at in (wait, self.forget) if at is not None and f["since"] + at > now]
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))

    def show(self, fact: dict, now: int) -> Iterator[Row]:
        """Gives the outcome where it is a new one."""
        new = self.outcome(fact, now), fact["since"]
        if new[0] is not None and new != (fact["shown"], fact["shown_since"]):
            # by the watermark, so that versions go on rising where a state was forgotten
            fact.update(shown=new[0], shown_since=new[1], version=max(fact["version"] + 1, now // 1000))
            yield Row(profile=fact["profile"], status=new[0], since=new[1], version=fact["version"])

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        facts = {r["profile"]: self.new(r["profile"]) for r in initialState["facts"]}
        for r in initialState["facts"]:
            self.take(facts[r["profile"]], [r])
        self.write(facts)
        if any(f["status"] is not None for f in facts.values()):
            self.handle.registerTimer(1)  # nothing can be shown here, so the ledger's outcome is shown as soon as time moves

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:  # rows without a profile only move the time
            return
        facts, now = self.read(), 1000 * max(timerValues.getCurrentWatermarkInMs(), 0)
        mine: dict[int, list] = {}
        for r in rows:
            mine.setdefault(r["profile"], []).append(r)
        out = []
        for profile, some in mine.items():
            fact = facts.get(profile)
            if fact is None or self.over(fact, now):  # a batch's rows come before its timers
                fact = facts[profile] = self.new(profile)
            self.take(fact, some)
            out += self.show(fact, now)
        self.write(facts)
        self.timer(facts, now)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = 1000 * timerValues.getCurrentWatermarkInMs()
        facts = {k: f for k, f in self.read().items() if not self.over(f, now)}
        out = [row for f in facts.values() for row in self.show(f, now)]
        self.write(facts)
        self.timer(facts, now)
        yield from out


def ledger_facts(events: DataFrame | None, snapshot: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """(profile, status, since, event_id, listed, degree): what batch tables know of each profile, as a stream begins with.

    events (profile, ts, event_id, status) are cut to each profile's furthest one; snapshot (profile) lists the pending ones;
    people: (profile, degree).
    """
    parts = []
    if events is not None:
        parts.append(furthest_events(events).select("profile", "status", F.unix_micros("ts").alias("since"), "event_id"))
    if snapshot is not None:
        parts.append(snapshot.select("profile").distinct().withColumn("listed", F.lit(True)))
    if people is not None:
        parts.append(people.select("profile", F.col("degree").cast("int").alias("degree")))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "profile", "full")
    kinds = dict(zip(FACT, ("long", "string", "long", "long", "boolean", "int")))
    return out.where("profile is not null").select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def lifecycle_updates(facts: DataFrame, ledger: DataFrame | None = None, minutes: int = 5, days: int = K.PENDING_DAYS, late: str = "7 days", forget_days: int | None = None, buckets: int = 1024) -> DataFrame:
    """(profile, status, since, version): a row whenever a profile's outcome changes, the last version holds.

    facts: a stream of (ts, profile, status, event_id, listed, degree); rows without a profile only move the time, rows
    without a status bring what a snapshot says. ledger: ledger_facts to begin with, read in the first batch. By the watermark, an
    attempt is unknown after minutes and a listed sent one withdrawn after days; a sent one that is not listed is
    accepted at degree 1 and else expired. Rows over late behind the newest are lost. With forget_days a profile's state ends
    so long after its status began (a time to live in event time; Spark's own counts processing time).
    Profiles are dealt to buckets by hash, and a bucket's are one state: for n profiles, about n / PER_STATE buckets cost least. A
    query that starts again from its checkpoint needs the number it began with. The state store has to be ROCKSDB when the query starts: see started.
    """
    bucket = F.when(F.col("profile").isNotNull(), F.pmod(F.xxhash64("profile"), F.lit(buckets)))
    f = facts.withWatermark("ts", late).select("ts", "profile", "status", F.unix_micros("ts").alias("since"), "event_id", "listed", "degree")
    f = f.withColumn("bucket", bucket)
    initial = None if ledger is None else ledger.groupBy(bucket.alias("bucket")).agg(F.collect_list(F.struct(*FACT)).alias("facts")).groupBy("bucket")
    out = f.groupBy("bucket").transformWithState(Lifecycle(minutes, days, forget_days), "profile long, status string, since long, version long", "update", "eventTime", initial)
    return out.withColumn("since", F.timestamp_micros("since"))


def started(updates: DataFrame, folder: str, partitions: int | None = None, **trigger):
    """The query that writes updates to folder/updates, a part for each batch, which a batch that is run again replaces.

    The session's state store is RocksDB while the query starts; it keeps its own settings in folder/checkpoint from then on.
    """
    spark = updates.sparkSession
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB} | ({} if partitions is None else {"spark.sql.shuffle.partitions": str(partitions)})
    before = {k: spark.conf.get(k, None) for k in settings}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return updates.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """(profile, status, since): the last version of each profile that started has written to folder."""
    u = spark.read.schema(UPDATES).parquet(f"{folder}/updates/*")
    return u.groupBy("profile").agg(F.max_by(F.struct("status", "since"), "version").alias("b")).select("profile", "b.*")
