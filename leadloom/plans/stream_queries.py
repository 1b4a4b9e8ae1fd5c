"""Queries that replay the events as streams and return what the streams leave behind, with the SQL of their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators.neardup import shared_folder
from leadloom.sources import fixtures as X
from leadloom.streaming import events as S
from leadloom.streaming import states as T

from . import oracle_parts as O
from . import record_queries as R
from .delivery_queries import ORACLE_SQL as BATCH

QUERIES, ORACLE_SQL = {}, {}
FACTS = "ts timestamp, profile long, status string, event_id long, listed boolean, degree int"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(BATCH["lifecycle_outcomes"])
def lifecycle_stream(s, d):
    """lifecycle_outcomes by a stream: the first half of the time is the ledger, the rest comes in files without order.

    A last row without a profile moves the watermark to the newest event, as of which the outcomes are.
    """
    e = X.send_events(s, d)
    listed = X.table(s, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("profile"))
    people = X.people(s, d).select(F.col("person_id").alias("profile"), "degree")
    half, profiles = e.agg(F.percentile_approx(F.unix_micros("ts"), 0.5), F.approx_count_distinct("profile")).first()
    half, buckets = half or 0, 1 + (profiles + X.table(s, d, "customer").count()) // T.PER_STATE
    folder = shared_folder(s, "lifecycle-stream")
    none = {"listed": F.lit(None).cast("boolean"), "degree": F.lit(None).cast("int")}
    newer = F.unix_micros("ts") > half
    e.where(newer).withColumns(none).selectExpr(*[c.split()[0] for c in FACTS.split(", ")]).repartition(4, F.xxhash64("event_id")).write.parquet(f"{folder}/in")
    tick = e.agg((F.max("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts")).select("ts", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in FACTS.split(", ")[1:]])
    tick.write.mode("append").parquet(f"{folder}/in")
    facts = s.readStream.schema(FACTS).option("maxFilesPerTrigger", 3).parquet(f"{folder}/in")
    T.started(T.lifecycle_updates(facts, T.ledger_facts(e.where(~newer), listed, people), late="1000 days", buckets=buckets), folder, int(s.conf.get("spark.sql.shuffle.partitions"))).awaitTermination()
    return R._ntz(T.current(s, folder), "since")


@query(f"WITH {O.SEND_EVENTS} SELECT address, count(*) AS failures, 1::BIGINT AS noted FROM send_events WHERE status = 'failed' GROUP BY 1")
def failure_event_stream(s, d):
    """Each address with a failure, how many there are, and how often the stream noted it: once."""
    e = X.send_events(s, d).select("event_id", "ts", "address", "status")
    folder = shared_folder(s, "failure-stream")
    e.write.parquet(f"{folder}/in")
    S.sync_failures(s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), f"{folder}/ledger", f"{folder}/checkpoint").awaitTermination()
    noted = s.read.schema(e.schema).parquet(f"{folder}/ledger").groupBy("address").agg(F.count("*").alias("noted"))
    return e.where("status = 'failed'").groupBy("address").agg(F.count("*").alias("failures")).join(noted, "address", "left")
