"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then seeded blocks of each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS = (5, 2, 1)
#: Words of a block, fewer where the smallest target would have under 64 blocks.
BLOCK_WORDS = 64
#: Words of a shard at least, and shards of a source at most: beyond, shards grow, each still one task's sort.
SHARD_WORDS, MAX_SHARDS = 1 << 17, 1 << 16


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, key, source_size, target): shares of total times all words by weight, none above most times its source.

    Sources take the weights in turn by code point, null last. The cap is found in one pass: by rising
    most * size / weight, a source is capped while the level that would fill the rest is above that ratio.
    Windows run over one row for each source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    s = s.withColumn("place", place).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    by = Window.orderBy("ratio", "place")
    before, everywhere = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0.0)
    s = (
        s.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
        .withColumn("all", total * F.sum("source_size").over(everywhere))
        .withColumn("level", (F.col("all") - F.coalesce(F.sum(most * F.col("source_size")).over(before), zero)) / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), zero)))
        .withColumn("rank", F.row_number().over(by))
        .withColumn("stop", F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.col("rank"))).over(everywhere), F.lit(1 << 30)))
        .withColumn("fill", F.max(F.when(F.col("rank") == F.col("stop"), F.col("level"))).over(everywhere))
    )
    target = F.when(F.col("rank") < F.col("stop"), most * F.col("source_size")).otherwise(F.col("fill") * F.col("weight"))
    return s.select("source", source_key().alias("key"), "source_size", target.cast("double").alias("target"))


def source_key() -> Column:
    """The source as a key that is never null."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def sainte_lague(rows: DataFrame, group: list[str], weight: str, seats: str, order: list[str]) -> DataFrame:
    """rows with quota: the seats of each group (a column, equal in a group) go to the highest weight / (2k - 1).

    A row's quota is rounded from its share at a divisor within half a seat a row of the mean one, so only the
    seats between those two bounds are ranked, about two for each row.
    """
    w = Window.partitionBy(*group)
    share = lambda sign: F.col(weight) / F.nullif(F.col("__sum"), F.lit(0.0)) * F.greatest(F.col(seats) + sign * F.col("__n") / 2, F.lit(0.0))
    d = rows.withColumns({"__sum": F.sum(weight).over(w), "__n": F.count("*").over(w)})
    d = d.withColumns({"__lo": F.greatest(F.floor(share(-1) - 0.5), F.lit(0)), "__hi": F.ceil(share(1) + 0.5)}).fillna(0, ["__lo", "__hi"])
    tries = d.withColumn("__k", F.explode(F.sequence("__lo", F.greatest("__hi", "__lo"))))  # the first stands for the lower bound
    rank = F.row_number().over(Window.partitionBy(*group).orderBy((F.col("__k") == F.col("__lo")).desc(), (F.col(weight) / (2 * F.col("__k") - 1)).desc(), "__k", *order))
    kept = tries.withColumn("__r", rank).withColumn("__base", F.sum(F.when(F.col("__k") == F.col("__lo"), F.col("__lo"))).over(w))
    won = (F.col("__k") > F.col("__lo")) & (F.col("__r") <= F.col("__n") + F.col(seats) - F.col("__base")) & (F.col(weight) > 0)
    names = rows.columns
    return kept.groupBy(*names).agg((F.max("__lo") + F.count_if(won)).alias("quota")).select(*names, F.col("quota").cast("long").alias("quota"))


def mix(docs: DataFrame, weights=WEIGHTS, total: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, source, text).

    size counts words (null text: 0). Each source gets an integer quota of blocks, each of its shards an
    integer part of that; a shard's documents, in seeded order, are one stream of words cut into blocks, and
    the quota takes every block of it as often as it fits, then a seeded choice of blocks once more. taken is
    the words of the document inside blocks taken, at most twice its size for most = 2. Reruns agree; rows that
    repeat a doc_id count each; a null source is a source; without words all is 0; an empty table gives no rows.
    """
    sizes = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("doc_id", "text", F.lit(seed)).alias("draw"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    targets = stored(source_targets(sizes, weights, total, most), "mix-targets")
    words, least = targets.agg(F.sum("target"), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    block = int(max(1, min(BLOCK_WORDS, (least or 0) // 64)))
    quotas = sainte_lague(targets.withColumn("seats", F.lit(round((words or 0) / block)).cast("long")), [], "target", "seats", ["key"])
    quotas = stored(
        quotas.withColumnRenamed("quota", "seats_of_source").drop("seats").withColumn("shards", F.greatest(F.lit(1), F.least(F.lit(MAX_SHARDS), F.ceil(F.col("source_size") / SHARD_WORDS)))), "mix-quotas"
    )
    dealt = (
        sizes.withColumn("key", source_key()).drop("source").join(quotas.drop("source"), "key")
        .withColumn("shard", F.pmod("draw", "shards"))
    )
    shards = stored(dealt.groupBy("key", "shard", "seats_of_source").agg(F.sum("size").alias("shard_size")), "mix-shards")
    shards = stored(
        sainte_lague(shards.withColumn("w", F.col("shard_size").cast("double")), ["key"], "w", "seats_of_source", ["shard"]).select("key", "shard", "shard_size", "quota"), "mix-shard-quotas"
    )
    order = Window.partitionBy("key", "shard").orderBy(F.xxhash64("draw"), "doc_id", "size")
    n = F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1))
    shards = shards.withColumn("n", n).withColumn("q", F.least("quota", 2 * F.col("n"))).withColumns({"full": F.floor(F.col("q") / F.col("n")), "once": (F.col("q") % F.col("n")).cast("int")})
    # the blocks taken once more are those whose hash is up to that of the last of them in hash order
    drawn = F.sort_array(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda k: F.xxhash64("key", "shard", k, F.lit(seed))))
    shards = stored(shards.withColumn("last", F.when(F.col("once") > 0, F.get(drawn, F.col("once") - 1))), "mix-draws")
    placed = dealt.withColumn("end", F.sum("size").over(order)).join(shards, ["key", "shard"]).withColumn("begin", F.col("end") - F.col("size"))

    def inside(k: Column) -> Column:
        words = F.least(F.col("end"), (k + 1) * block) - F.greatest(F.col("begin"), k * block)
        return F.when(F.xxhash64("key", "shard", k, F.lit(seed)) <= F.col("last"), words).otherwise(F.lit(0).cast("long"))

    more = F.aggregate(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)), F.lit(0).cast("long"), lambda a, k: a + inside(k))
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("full") * F.col("size") + more).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Whole documents as often as the mix takes them: taken / size copies, the fraction by a seeded draw.

    Columns as given, whatever their names; documents without words are taken by no mix and go. Rows that repeat a doc_id share the
    draw of the first. A row without doc_id is a document of its own: its source and text are its key.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("source", "text")).alias("mix_key")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"), key)
    taken = mix(rows.select(F.col("mix_key").alias("doc_id"), "mix_row.source", "mix_row.text"), seed=seed).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).where("taken > 0")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed + 2)), F.lit(1 << 20)) / (1 << 20)
    copies = stored(taken.select(F.col("doc_id").alias("mix_key"), F.floor(F.col("taken") / F.col("size") + draw).cast("int").alias("copies")).where("copies > 0"), "mix-copies")
    return rows.join(copies, "mix_key").select("mix_row", F.explode(F.sequence(F.lit(1), "copies"))).select("mix_row.*")
