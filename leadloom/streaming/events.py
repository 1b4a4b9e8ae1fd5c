"""Streams of delivery events: windows with watermarks, first events, states with timers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, **options) -> DataFrame:
    """A parquet folder of events as a stream; times are UTC, so they can carry a watermark."""
    s = spark.readStream.schema(EVENTS).options(**options).parquet(path)
    return s.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("profile"), F.col("event_type").alias("status"))


def tumbling_days(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "status", "n")


def sliding_week(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("starts"), F.col("window.end").alias("ends"), "n")


def cooldown_sessions(events: DataFrame, gap: str = "48 hours", late: str = "1 day") -> DataFrame:
    e = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "profile").agg(F.count("*").alias("trips"))
    return e.select("profile", F.col("session_window.start").alias("starts"), F.col("session_window.end").alias("ends"), "trips")


def first_in_watermark(events: DataFrame, late: str = "7 days", keys: tuple[str, ...] = ("profile", "status")) -> DataFrame:
    """The first event of each key to arrive; a key is forgotten once the watermark is late past it, so state stays bounded."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def sync_failures(events: DataFrame, ledger_path: str, checkpoint: str, late: str = "7 days"):
    """A query that appends the first failure of each address to the ledger, and runs until what there is has been read.

    Repeats within the watermark go by state and never reach the ledger join; those after it meet the ledger, which
    never forgets. events: (event_id, ts, address, status).
    """
    first = first_in_watermark(events.where("status = 'failed' and address is not null"), late, ("address",))
    sink = append_once_sink(ledger_path, "address")
    return first.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once_sink(ledger_path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that appends the first row of each key that the ledger lacks; it never forgets, and a batch that is run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        from leadloom.operators.candidates import append_once

        spark = batch.sparkSession
        old = spark.read.schema(batch.schema).option("ignoreMissingFiles", "true")
        try:
            ledger = old.parquet(ledger_path).select(key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            ledger = batch.limit(0).select(key)
        append_once(ledger, batch, [key], ["ts", "event_id"]).write.mode("append").parquet(ledger_path)

    return write


def late_rows_sink(seen_path: str, late_path: str, ts: str = "ts", late: str = "1 day") -> Callable[[DataFrame, int], None]:
    """A foreachBatch that writes to late_path the rows that lie more than late before the newest row of earlier batches.

    Each batch's newest time is kept in seen_path. Both folders have a part for each batch, which a batch that is run
    again replaces, so nothing is written twice. Rows without a time are not late.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = None
        try:
            newest = spark.read.schema("newest timestamp, batch long").parquet(seen_path).where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        batch.agg(F.max(ts).cast("timestamp").alias("newest")).write.mode("overwrite").parquet(f"{seen_path}/batch={number}")
        if newest is not None:
            rows = batch.where(F.col(ts) < F.lit(newest) - F.expr(f"INTERVAL {late}"))
            rows.write.mode("overwrite").parquet(f"{late_path}/batch={number}")

    return write
