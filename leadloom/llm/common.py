"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="leadloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def stored(df: DataFrame, tag: str, **options) -> DataFrame:
    """df, written once to the shared folder, with the writer's options, and read again: a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/leadloom/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row, whatever the lambdas in body do with it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def with_field(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of df with one more column."""
    return StructType([*df.schema.fields, StructField(name, DataType.fromDDL(kind))])


def doc_crc(col: str = "doc_id") -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b: long); component is the smallest node reachable.

    Alternates large-star and small-star steps. Each round writes its edges to the shared folder, joins
    are on the node with both sides shuffled, so adaptive execution can split a hub, and the minima are
    combined before they are shuffled. Nulls and loops are ignored; no edges, no rows.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "cc")
    before = None
    while True:
        n, mark = e.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if n == 0 or (n, mark) == before:
            return e.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(
                e.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
            )
        before = n, mark
        both = e.select("v", "m").union(e.select("m", "v")).toDF("u", "w")
        least = stored(both.groupBy("u").agg(F.min("w").alias("x")).select("u", F.least("u", "x").alias("x")), "cc")
        large = stored(both.join(least, "u").where("w > u").select(F.col("w").alias("v"), F.col("x").alias("m")).distinct(), "cc")
        least = stored(large.groupBy("v").agg(F.min("m").alias("x")), "cc")
        small = large.join(least, "v").where("m <> x").select(F.col("m").alias("v"), F.col("x").alias("m"))
        e = stored(small.union(least.select("v", F.col("x").alias("m"))).distinct(), "cc")


def local_labels(n: int, a, b):
    """For n items and links a[i] - b[i] (numpy), the smallest index each item reaches."""
    import numpy as np

    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new
