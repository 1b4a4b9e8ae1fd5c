"""Candidates out of nested search results, result files, place lists; whose page a page is; sinks and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions import constants as K
from leadloom.functions.exprs import norm_domain, usable_domain

ELEMENTS = "array<struct<id:long,tags:map<string,string>>>"
PLACES = "array<struct<id:string,displayName:struct<text:string>,websiteUri:string>>"
RESULT = T.StructType([T.StructField(n, T.BooleanType() if n == "found" else T.StringType()) for n in ("lead_id", "found", "first_name", "last_name", "email", "reason")])


def split_found(rows: DataFrame, blocked: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows (group, name, domain, order) with outcome: no name, unresolved (no domain), repeat, seen (blocked domain) or linked.

    Of one domain in a group the first row by order counts. blocked: domain.
    """
    first = F.row_number().over(Window.partitionBy(*group, "domain").orderBy(*order))
    usable = rows.where((F.coalesce("name", F.lit("")) != "") & F.col("domain").isNotNull()).withColumn("nth", first)
    usable = usable.join(blocked.select(F.col("domain").alias("norm"), F.lit(True).alias("known")).distinct(), norm_domain(F.col("domain")) == F.col("norm"), "left")
    usable = usable.withColumn("outcome", F.when(F.col("nth") > 1, "repeat").when(F.col("known"), "seen").otherwise("linked")).drop("nth", "norm", "known")
    rest = rows.where((F.coalesce("name", F.lit("")) == "") | F.col("domain").isNull())
    return usable.unionByName(rest.withColumn("outcome", F.when(F.coalesce("name", F.lit("")) == "", "no name").otherwise("unresolved")))


def flatten_map_elements(responses: DataFrame, blocked: DataFrame) -> DataFrame:
    """(call_id, pos, name, domain, outcome) of each element of JSON responses (call_id, body).

    A body is {"elements": [{"id", "tags"}]}; the first usable of website and contact:website is the domain. A body
    that is no such JSON has no elements.
    """
    body = F.from_json("body", f"elements {ELEMENTS}")
    e = responses.select("call_id", F.posexplode(body["elements"]).alias("pos", "e"))
    name = F.trim(F.coalesce(F.col("e.tags")["name"], F.lit("")))
    domain = F.coalesce(usable_domain(F.col("e.tags")["website"]), usable_domain(F.col("e.tags")["contact:website"]))
    return split_found(e.select("call_id", "pos", name.alias("name"), domain.alias("domain")), blocked, ["call_id"], ["pos"])


def flatten_place_results(responses: DataFrame, blocked: DataFrame) -> DataFrame:
    """(call_id, pos, place_id, name, domain, outcome) of each place of JSON responses (call_id, body), a place once over all calls.

    A body is {"places": [{"id", "displayName": {"text"}, "websiteUri"}]}; places without id count each.
    """
    p = responses.select("call_id", F.posexplode(F.from_json("body", f"places {PLACES}")["places"]).alias("pos", "p")).select("call_id", "pos", "p.*")
    known = p.where("coalesce(id, '') <> ''").groupBy("id").agg(F.min_by(F.struct("call_id", "pos", "displayName", "websiteUri"), F.struct("call_id", "pos")).alias("r")).select("r.call_id", "r.pos", "id", "r.displayName", "r.websiteUri")
    every = known.unionByName(p.where("coalesce(id, '') = ''"))
    rows = every.select("call_id", "pos", F.col("id").alias("place_id"), F.trim(F.coalesce("displayName.text", F.lit(""))).alias("name"), usable_domain(F.col("websiteUri")).alias("domain"))
    return split_found(rows, blocked, [], ["call_id", "pos"])


def scan_results(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, audit) of JSON texts (file, line): the last file's result of each lead_id, and counts of bad lines and of lines without lead_id."""
    parsed = lines.select("file", F.from_json("line", T.StructType([*RESULT.fields, T.StructField("_corrupt_record", T.StringType())]), {"mode": "PERMISSIVE"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    blank = F.coalesce(F.col("r.lead_id"), F.lit("")) == ""
    audit = parsed.agg(F.count_if(broken).alias("bad"), F.count_if(~broken & blank).alias("no_id"), F.count("*").alias("n"))
    good = parsed.where(~broken & ~blank).select("file", *[f"r.{n}" for n in RESULT.names])
    last = good.groupBy("lead_id").agg(F.max_by(F.struct("file", *[n for n in RESULT.names if n != "lead_id"]), "file").alias("x"))
    return last.select("lead_id", "x.*"), audit


def load_places(spark: SparkSession, path: str) -> DataFrame:
    """(place, country, lat, lon, half) of lines City|ISO2|lat|lon|half width; blank and # lines are left out, a bad line fails the job."""
    return parse_places(spark.read.text(path).withColumnRenamed("value", "line"))


def parse_places(lines: DataFrame) -> DataFrame:
    p = F.split(F.trim("line"), r"\|")
    rows = lines.where((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    checked = F.when(F.size(p) == 5, p).otherwise(F.raise_error(F.concat(F.lit("not City|ISO2|lat|lon|half width: "), "line")))
    return rows.select(checked.alias("p")).select(
        F.trim(F.col("p")[0]).alias("place"), F.upper(F.trim(F.col("p")[1])).alias("country"), *[F.trim(F.col("p")[i]).cast("double").alias(n) for i, n in ((2, "lat"), (3, "lon"), (4, "half"))]
    )


def write_table(df: DataFrame, path: str, run_column: str = "run_id") -> None:
    """df as Parquet, a folder for each run; a rerun replaces its own runs and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run_column).parquet(path)


def top_n_per_group(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group by order, with rn. A group's tail leaves each task before the shuffle (window group limit)."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rn", rn.cast("long")).where(F.col("rn") <= n)


def identity_tokens(name: Column) -> Column:
    """Words of three letters or more, in lower case, that tell one business from another."""
    words = F.transform(F.regexp_extract_all(name, F.lit("[A-Za-z؀-ۿ][A-Za-z0-9؀-ۿ]{2,}"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*K.IDENTITY_STOP)))


def page_text(html: Column) -> Column:
    """A page in lower case without scripts, styles and tags."""
    html = F.lower(html)
    for tag in ("script", "style"):
        html = F.regexp_replace(html, rf"(?s)<{tag}.*?</{tag}>", " ")
    return F.regexp_replace(html, "<[^>]+>", " ")


def verify_entity_pages(names: DataFrame, pages: DataFrame, hits: DataFrame, least: int = 2, directory: str | None = None, key: str = "host") -> DataFrame:
    """hits (name_id, pos, host) with verdict: directory, generic (too few words), no page, unproven, or verified.

    names: name_id, name; pages: host, html. A page proves a name if least of its identity words stand in the visible
    text and one in the title or the host. Of a name's hits the first verified by pos has best true; a host that
    is best for several names is kept for the smallest name_id (kept). A hit's page is that of its host, or of another key
    that both tables have.
    """
    p = pages.select(key, page_text(F.col("html")).alias("text"), F.regexp_extract(F.lower("html"), r"(?s)<title[^>]*>(.*?)</title>", 1).alias("title"))
    d = hits.join(names.select("name_id", identity_tokens(F.col("name")).alias("tokens")), "name_id").join(p, key, "left")
    shown = F.size(F.filter("tokens", lambda t: F.contains("text", t)))
    strong = F.exists("tokens", lambda t: F.contains("title", t) | F.contains("host", t))
    verdict = F.when(F.col("host").rlike(directory), "directory") if directory else F.when(F.lit(False), "directory")
    verdict = verdict.when(F.size("tokens") < least, "generic").when(F.col("text").isNull(), "no page").when((shown >= least) & strong, "verified").otherwise("unproven")
    d = d.select("name_id", "pos", "host", verdict.alias("verdict"))
    first = d.where("verdict = 'verified'").groupBy("name_id").agg(F.min_by(F.struct("pos", "host"), F.struct("pos", "host")).alias("b")).select("name_id", "b.pos", "b.host", F.lit(True).alias("best"))
    owner = first.groupBy("host").agg(F.min("name_id").alias("owner"))
    d = d.join(first, ["name_id", "pos", "host"], "left").join(owner, "host", "left")
    best = F.coalesce("best", F.lit(False))
    return d.select("name_id", "pos", "host", "verdict", best.alias("best"), (best & (F.col("owner") == F.col("name_id"))).alias("kept"))
