"""Ledgers as stored tables: months as partitions, keys in buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


def month_of(day: Column) -> Column:
    """The month of a date as a partition; a row without a date is in none, which every window reads."""
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("none"))


def save_ledger(rows: DataFrame, name: str, key: str, day: str = "entry_date", buckets: int = BUCKETS, mode: str = "append") -> None:
    """Appends rows to the table name: a partition for each month of day, in buckets by key, sorted by it.

    Windows over days read their months alone, and joins by key find the table dealt and sorted. Rows are dealt to buckets before they
    are written, so a month has one file a bucket and not one a task.
    """
    placed = rows.withColumn("month", month_of(F.col(day))).repartition(buckets, key)
    placed.write.mode(mode).partitionBy("month").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def read_window(spark: SparkSession, name: str, run_id: str, today, days: int | None, day: str = "entry_date") -> DataFrame:
    """Rows of other runs that are at most days old, a missing date counting as new; only months that can hold such are read."""
    t = spark.table(name).where(F.col("run_id") != run_id)
    if days is None:
        return t.drop("month")
    since = F.date_sub(F.lit(today).cast("date"), days)
    return t.where((F.col("month") >= F.date_format(since, "yyyy-MM")) | (F.col("month") == "none")).where(F.col(day).isNull() | (F.col(day) >= since)).drop("month")


def append_unseen(rows: DataFrame, name: str, key: str, order: list, day: str = "entry_date", buckets: int = BUCKETS) -> DataFrame:
    """Appends the first row of each key, by order, that the table name lacks, and returns them as appended, with the table's columns.

    The anti-join is on the table's own buckets, so the ledger is neither shuffled nor sorted, however long it is.
    """
    from leadloom.operators.neardup import settled

    table = rows.sparkSession.table(name)
    new = settled(unseen(rows, table, key, order).select(*[c for c in table.columns if c != "month"]), "unseen")
    save_ledger(new, name, key, day, buckets)
    return new


def unseen(rows: DataFrame, ledger: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key, by order, that ledger lacks. Null keys are no keys: such rows are all new."""
    s = F.struct(*order, *rows.columns)
    place = F.struct(*order)
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(s, place).alias("b")).select(*[F.col(f"b.{c}").alias(c) for c in rows.columns])
    return first.join(ledger.select(key).hint("merge"), key, "left_anti").unionByName(rows.where(F.col(key).isNull()))
