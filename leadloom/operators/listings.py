"""Businesses listed on directory pages, by patterns that are rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import constants as K
from leadloom.functions.exprs import url_host
from leadloom.functions.references import unescape


def _all(text: Column, pattern: Column, group: int) -> Column:
    return F.regexp_extract_all(text, F.concat(F.lit("(?is)"), pattern), F.lit(group))


def listed_names(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, page, at, name, domain, kind, country, vertical, city) of each name, once for a source, in the order of page and place.

    pages: source_id, page, url, html. sources: source_id, row, name, link, skip_hosts, country, vertical, city. row cuts a page into
    entries (null: the page is one), name has one group for a name in an entry, link (may be null) one for its link; case is folded
    and a point meets line ends. Names lose tags, are decoded, and fold white space; shorter ones than two characters go. A
    link that leads back to the directory (its page's host or skip_hosts) or to an aggregator is none. kind: candidate for the first
    name of a domain, repeat for a later one, unresolved without a domain. The patterns are columns, so each page is
    read by its own source's in one projection.
    """
    p = pages.join(sources, "source_id")
    entries = F.when(F.col("row").isNull(), F.array("html")).otherwise(_all(F.col("html"), F.col("row"), 0))
    e = p.select("source_id", "page", url_host(F.col("url")).alias("own"), "name", "link", "skip_hosts", "country", "vertical", "city", F.posexplode(entries).alias("entry_at", "entry"))
    link = F.when(F.col("link").isNotNull(), F.get(_all(F.col("entry"), F.col("link"), 1), F.lit(0)))
    e = e.withColumns({"host": F.nullif(url_host(link), F.lit("")), "names": _all(F.col("entry"), F.col("name"), 1)})
    n = e.select("source_id", "page", "own", "host", "skip_hosts", "country", "vertical", "city", "entry_at", F.posexplode("names").alias("name_at", "name"))
    clean = F.trim(F.regexp_replace(unescape(F.regexp_replace("name", "<[^>]+>", " ")), r"[\s ]+", " "))
    bad = F.lit(False)
    for a in K.AGGREGATORS:
        bad = bad | F.contains("host", F.lit(a))
    own = (F.col("host") == F.col("own")) | F.coalesce(F.array_contains("skip_hosts", F.col("host")), F.lit(False)) | bad
    n = n.withColumns({"name": clean, "domain": F.when(~F.coalesce(own, F.lit(False)), F.col("host"))}).where(F.char_length("name") >= 2)
    place = F.struct("page", "entry_at", "name_at")
    rest = ("name", "domain", "country", "vertical", "city")
    first = n.groupBy("source_id", F.lower("name").alias("folded")).agg(F.min_by(F.struct(place.alias("place"), *rest), place).alias("b")).select("source_id", "b.*")
    owner = first.where("domain is not null").groupBy("source_id", "domain").agg(F.min("place").alias("owner"))
    k = first.join(owner, ["source_id", "domain"], "left")
    kind = F.when(F.col("domain").isNull(), "unresolved").when(F.col("place") == F.col("owner"), "candidate").otherwise("repeat")
    at = (F.col("place.entry_at") * 1000 + F.col("place.name_at")).cast("long")
    return k.select("source_id", F.col("place.page").alias("page"), at.alias("at"), "name", "domain", kind.alias("kind"), "country", "vertical", "city")
