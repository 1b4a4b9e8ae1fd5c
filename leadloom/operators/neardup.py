"""Near-duplicate messages, and the choice of the first of each by order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of ids that are broadcast at most, so that sets need no shuffle to meet them.
BROADCAST_ROWS = 1 << 20


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder of the session; a temporary folder only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leadloom-checkpoint-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/leadloom-ops/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder of the session and read again."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def greedy_keep_first(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id) kept when ids are taken by rising id and one is dropped if it is paired with one kept before. pairs: a < b.

    Each round keeps every undecided id without a smaller undecided partner and drops the partners of what it
    keeps; the result is that of the sequential loop.
    """
    undecided, kept = settled(nodes.select("id").distinct(), "greedy"), None
    pairs = settled(pairs.select("a", "b").distinct(), "greedy")
    while not undecided.isEmpty():
        waiting = pairs.select(F.col("b").alias("id")).distinct()
        now = settled(undecided.join(waiting, "id", "left_anti"), "greedy")
        lost = pairs.join(now.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        kept = now if kept is None else kept.union(now)
        gone = settled(now.union(lost), "greedy")
        undecided = settled(undecided.join(gone, "id", "left_anti"), "greedy")
        pairs = settled(pairs.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"), "greedy")
    return kept if kept is not None else nodes.select("id")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row; a lambda would evaluate it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column, n: int) -> Column:
    """Distinct n-word shingles of lower-case words; a shorter text is one shingle."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) < n, F.array(F.concat_ws(" ", w))).otherwise(F.array_distinct(many))

    return _let(words(text), of)


def message_body(text: Column) -> Column:
    """A message without its first and last three lines, where it has more than four."""
    return _let(F.split(text, "\n"), lambda ls: F.when(F.size(ls) > 4, F.array_join(F.slice(ls, 2, F.greatest(F.size(ls) - 4, F.lit(0))), "\n")).otherwise(text))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of lower-case text with white space as single spaces; a shorter text is one."""

    def of(c: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))
        return F.when(F.size(c) < 3, F.array(F.concat_ws("", c))).otherwise(F.array_distinct(many))

    return _let(F.split(F.regexp_replace(F.lower(text), r"\s+", " "), ""), of)


def equal_sets(sets: DataFrame) -> DataFrame:
    """(id, rep, features) of sets (id, items: array): items as sorted 64-bit hashes, and the smallest id with the same ones."""
    f = stored_sets(sets)
    rep = f.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = settled(f.select("id", "h1", "h2").join(rep, ["h1", "h2"]).where("id <> rep"), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    return f.join(copies, ["id", "h1", "h2"], "left").select("id", F.coalesce("rep", "id").alias("rep"), "features")


def stored_sets(sets: DataFrame) -> DataFrame:
    """(id, features, h1, h2) of sets (id, items: array), stored: items as sorted 64-bit hashes, and 128 bits that name them."""
    f = sets.select("id", F.array_sort(F.array_distinct(F.transform("items", lambda x: F.xxhash64(x)))).alias("features")).withColumns({"h1": F.xxhash64("features"), "h2": F.xxhash64(F.lit(1), "features")})
    return settled(f, "sets")


def first_ids(sets: DataFrame) -> DataFrame:
    """(id), stored: the smallest id of each different set of stored_sets; no features are shuffled."""
    return settled(sets.groupBy("h1", "h2").agg(F.min("id").alias("id")).select("id").distinct(), "first")


def counted_pairs(met: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs met (a, b) whose sets (id, features) have a Jaccard index above least."""
    both = met.join(sets.select(F.col("id").alias("a"), F.col("features").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("features").alias("y")), "b")
    c = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", c.alias("c"), (F.size("x") + F.size("y") - c).alias("u"))
    return both.where(F.col("c") / F.col("u") > least).select("a", "b", F.round(F.col("c") / F.col("u"), 3).alias("similarity"))


def similar_pairs(classes: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of representatives whose sets have a Jaccard index above least; a < b. classes: equal_sets.

    Copies stand behind their representative, so a group of copies gives no pairs and no hot features. Two sets
    above the index share one of each set's rarest features (prefix filter), so only those are joined, as numbers;
    the index is then counted on the sets of the candidates, in cells, so a set is not sent once for each of its pairs. Adaptive execution splits a feature that many share.
    """
    from pyspark.sql import Window

    from .sketches import counted_in_cells

    f = classes.where("id = rep").select("id", "features")
    flat = f.select("id", F.size("features").alias("n"), F.explode("features").alias("feature"))
    # counted where a feature's rows meet, so they are shuffled once for it
    often = flat.withColumn("df", F.count("*").over(Window.partitionBy("feature"))).where("df > 1")
    # a feature of one set comes first in that set's order and joins nothing: only how many there are counts
    ranked = often.withColumn("shared", F.count("*").over(Window.partitionBy("id"))).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "feature")))
    most = F.col("n") - F.ceil(least * F.col("n")) + 1
    prefix = settled(ranked.where(F.col("rank") + F.col("n") - F.col("shared") <= most).select("id", "feature", "n"), "similar")
    other = prefix.select("feature", F.col("id").alias("b"), F.col("n").alias("m"))
    pairs = prefix.withColumnRenamed("id", "a").join(other, "feature").where("a < b").where(F.least("n", "m") >= least * F.greatest("n", "m")).select("a", "b").distinct()
    return counted_in_cells(settled(pairs, "met"), f, least)


def all_links(classes: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity): similar_pairs of the representatives, and each copy (b) with its representative (a) at 1.0. classes: equal_sets.

    Two ids have an index above least if they have one representative, or their representatives are a pair here; none is left out.
    """
    copies = classes.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return similar_pairs(classes, least).union(copies)


def message_errors(text: Column, most: int) -> Column:
    """What is wrong with a message: empty, too long, a placeholder left."""
    return F.array_compact(F.array(F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty"), F.when(F.char_length(text) > most, "too long"), F.when(text.rlike(r"\{[a-z_]+\}|\[[A-Z ]+\]"), "placeholder")))
