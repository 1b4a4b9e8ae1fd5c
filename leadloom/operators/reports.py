"""Reports over leads, pages and drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def traffic_report(scored: DataFrame) -> DataFrame:
    """(vertical, traffic_tier, n, percent): by tier, and by vertical and tier; a null vertical is all."""
    g = scored.groupingSets([["traffic_tier"], ["vertical", "traffic_tier"]], "vertical", "traffic_tier").agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("vertical")), 2))


def signal_frequency(scored: DataFrame) -> DataFrame:
    return scored.select(F.explode("traffic_signals").alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


def ratio(n: Column, of: Column) -> Column:
    """n over of as doubles; over nothing it is infinite, and nothing over nothing is NaN."""
    return F.when(of == 0, F.when(n == 0, F.lit(float("nan"))).when(n > 0, F.lit(float("inf")))).otherwise(F.try_divide(n, of))


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(step, stage, n, ratio): rows of each stage, and over the stage before; see ratio for an empty one."""
    counts = None
    for i, (name, df) in enumerate(stages):
        one = df.agg(F.count("*").alias("n")).select(F.lit(i).cast("long").alias("step"), F.lit(name).alias("stage"), "n")
        counts = one if counts is None else counts.union(one)
    return counts.withColumn("ratio", F.round(ratio(F.col("n"), F.lag("n").over(Window.orderBy("step"))), 4))


def page_yield(candidates: DataFrame, sites: DataFrame) -> DataFrame:
    """(domains, with_pages, share, warn): warn below two fifths."""
    d = candidates.select("domain").distinct().join(sites.select("domain", F.lit(1).alias("has")), "domain", "left")
    return d.agg(F.count("*").alias("domains"), F.count("has").alias("with_pages")).withColumn("share", F.round(ratio(F.col("with_pages"), F.col("domains")), 4)).withColumn("warn", F.col("share") < 0.4)


def target_shortfall(qualified_share: DataFrame, target: int) -> DataFrame:
    """(n_in, n_kept, needed, short) for a target of good leads. qualified_share: one row of n_in and n_kept.

    Where no lead was kept, no number of leads is known to be enough: needed is null, and they are short.
    """
    needed = F.ceil(F.try_divide(F.lit(target) * F.col("n_in"), F.col("n_kept"))).cast("long")
    return qualified_share.select("n_in", "n_kept", needed.alias("needed")).withColumn("short", F.coalesce(F.col("n_in") < F.col("needed"), F.lit(True)))


def funnel_by_run(flags: DataFrame, stages: list[str]) -> DataFrame:
    """(run, step, stage, n, ratio): rows of flags (run, and a boolean for each stage) that are in a stage, and over the stage before."""
    n = flags.groupBy("run").agg(*[F.count_if(F.col(c)).alias(c) for c in stages])
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("step"), F.lit(c).alias("stage"), F.col(c).alias("n")) for i, c in enumerate(stages)])
    long = n.select("run", F.inline(steps))
    before = F.lag("n").over(Window.partitionBy("run").orderBy("step"))
    return long.withColumn("ratio", F.round(F.col("n") / F.nullif(before, F.lit(0)), 4))


def target_plan(counts: DataFrame, target: int, survival: float, quota: int) -> DataFrame:
    """(n_kept, needed, candidates, short): good leads that a target of sends needs, three candidates for each of them
    (quota at least), and whether n_kept of counts is too few."""
    needed = F.ceil(F.lit(target) / F.lit(survival)).cast("long")
    return counts.select("n_kept", needed.alias("needed"), F.greatest(F.lit(quota).cast("long"), 3 * needed).alias("candidates"), (F.col("n_kept") < needed).alias("short"))


def score_survival(scored: DataFrame) -> DataFrame:
    """(n, survived, correlation) of traffic_score and whether a lead was kept (drop_reason is null).

    The correlation is null without leads, and NaN where the scores or the verdicts are all one value.
    """
    score = F.col("traffic_score").cast("double")
    kept = F.when(score.isNotNull(), F.col("drop_reason").isNull().cast("double"))
    c = F.coalesce(F.try_divide(F.covar_pop(score, kept), F.stddev_pop(score) * F.stddev_pop(kept)), F.when(F.count(score) > 0, F.lit(float("nan"))))
    return scored.agg(F.count("*").alias("n"), F.count_if(F.col("drop_reason").isNull()).alias("survived"), F.round(c, 4).alias("correlation"))
