"""Pages found for names by an inverted index of their words, to be proven afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entities import identity_tokens, page_text, verify_entity_pages
from .neardup import settled

WORD = "[A-Za-z؀-ۿ][A-Za-z0-9؀-ۿ]{2,}"


def page_words(html: Column, host: Column) -> Column:
    """Distinct words of three letters or more in a page's visible text and its host, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.concat(page_text(html), F.lit(" "), host), F.lit(WORD), F.lit(0)))


def propose_pages(names: DataFrame, pages: DataFrame, least: int = 2, most: int = 8, directory: str | None = None) -> DataFrame:
    """(name_id, pos, page_id, host, shared): for each name the first most pages by how many of its identity words they hold, least of them at least.

    names: name_id, name; pages: page_id, host, html; hosts that match directory propose nothing. An index of (word, page) is made of
    the words that names use. A page with least of a name's words holds one of all but least - 1 of them, so only a name's
    rarest words look pages up; a page's words are then counted whole. Names with fewer words than least, on no page, or null find none.
    """
    n = names.select("name_id", identity_tokens(F.col("name")).alias("tokens")).where(F.size("tokens") >= least)
    used = n.select("name_id", F.explode("tokens").alias("word"))
    p = pages.where(~F.col("host").rlike(directory)) if directory else pages
    words = p.select("page_id", "host", F.explode(page_words(F.col("html"), F.col("host"))).alias("word"))
    index = settled(words.join(used.select("word").distinct(), "word", "left_semi"), "index")
    df = index.groupBy("word").agg(F.count("*").alias("df"))
    w = Window.partitionBy("name_id")
    ranked = used.join(df, "word").withColumns({"there": F.count("*").over(w), "rank": F.row_number().over(w.orderBy("df", "word"))})
    probes = ranked.where(F.col("rank") <= F.col("there") - least + 1).select("name_id", "word")
    met = probes.join(index, "word").select("name_id", "page_id", "host").distinct()
    held = index.groupBy("page_id").agg(F.collect_list("word").alias("words"))
    both = met.join(n, "name_id").join(held, "page_id").select("name_id", "page_id", "host", F.size(F.array_intersect("tokens", "words")).alias("shared")).where(F.col("shared") >= least)
    pos = F.row_number().over(Window.partitionBy("name_id").orderBy(F.desc("shared"), "page_id"))
    return both.withColumn("pos", pos.cast("int")).where(F.col("pos") <= most).select("name_id", "pos", "page_id", "host", F.col("shared").cast("long").alias("shared"))


def search_entities(names: DataFrame, pages: DataFrame, least: int = 2, most: int = 8, directory: str | None = None) -> DataFrame:
    """(name_id, pos, page_id, host, shared, verdict, best, kept): proposed pages with what verify_entity_pages says of them."""
    hits = settled(propose_pages(names, pages, least, most, directory), "hits")
    proven = verify_entity_pages(names, pages, hits, least, directory, key="page_id")
    return hits.select("name_id", "pos", "page_id", "shared").join(proven, ["name_id", "pos"])
